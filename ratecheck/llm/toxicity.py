"""Toxicity: a bidirectional gated recurrent network with attention pooling, written in numpy.

A word enters as an embedding of its own, if enough training texts have it, beside those of its
character trigrams and first characters, so unseen forms of a known stem still say something. The network reads windows of
``WINDOW`` words that overlap; attention pools the states of a window into one logit, and a
document scores as its worst window. All windows of all texts are scored, in Spark tasks; only
training runs on the driver, on a sample of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 64
STRIDE = 48
HIDDEN = 8
EMBED = 8
MOST_WORDS = 1 << 14
LEAST_TEXTS = 5
LEAST_SHARE = 0.005
CHAR_SLOTS = 1 << 12
PREFIX_BYTES = 5
# The training sample: at most so many documents of each label, each of at most so many bytes.
SAMPLE_PER_LABEL = 1500
SAMPLE_BYTES = 6000
STEPS = 250
BATCH = 64
RATE = 0.01
EMBED_RATE = 4.0
HARDEST = 3
SEED = 11
THRESHOLD = 0.5
KNOWN_WORDS = 200_000
CHUNK_WORDS = 200_000
CHUNK_WINDOWS = 2048
EDGES = b".,;:!?\"'()[]{}<>*_-"


def bare(word: bytes) -> bytes:
    return word.strip(EDGES) or word


def codes(words: list[bytes], known: dict[bytes, int]
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words: of the word, of its trigrams (flat, with starts), of its first bytes."""
    plain = [bare(w) for w in words]
    word = np.array([known.get(w, 0) for w in plain], np.int64)
    framed = [b"\x01" + w + b"\x02" for w in plain]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    flat = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(flat)) - np.repeat(begin, sizes)
    powers = np.random.default_rng(3).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
    first = np.where(place < PREFIX_BYTES, (flat + np.uint64(7)) * powers[place % 64], 0)
    prefix = (np.add.reduceat(first.astype(np.uint64), begin) >> np.uint64(41)) % np.uint64(CHAR_SLOTS)
    inner = np.repeat(sizes, sizes) - place > 2
    at = np.flatnonzero(inner)
    grams = (flat[at] * powers[1] + flat[at + 1] * powers[2] + flat[at + 2] * powers[3])
    grams = (grams >> np.uint64(42)) % np.uint64(CHAR_SLOTS)
    starts = np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))
    return word, grams.astype(np.int64), starts, prefix.astype(np.int64)


def window_starts(n: int, window: int, stride: int) -> list[int]:
    """Starts of all windows of a text; the last one ends with the text."""
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


class Network:
    """Parameters, the forward pass, and its gradient."""

    def __init__(self, seed: int = SEED, vocabulary: list[bytes] = ()):
        self.known = {w: i for i, w in enumerate(vocabulary, 1)}
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        # Embeddings start at zero: what training never met has no say. Row 0 is for words that
        # have none of their own.
        self.p = {
            "word": np.zeros((len(self.known) + 1, EMBED), np.float32),
            "char": np.zeros((CHAR_SLOTS, EMBED), np.float32),
            "prefix": np.zeros((CHAR_SLOTS, EMBED), np.float32),
            "w": draw(2, 2 * EMBED, 3 * HIDDEN, scale=0.25),
            "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": draw(2, HIDDEN, 3 * HIDDEN, scale=0.3), "v": draw(2 * HIDDEN, scale=0.3),
            "o": draw(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        slots = codes(words, self.known)
        word, grams, starts, prefix = slots
        counts = np.diff(np.append(starts, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], starts) / np.sqrt(counts)[:, None]
        x = np.hstack([self.p["word"][word], chars + self.p["prefix"][prefix]])
        return x.astype(np.float32), slots

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The inputs' share of all gates, for both directions; the last row is for padding."""
        both = np.einsum("ni,dij->ndj", x, self.p["w"]) + self.p["b"]
        return np.concatenate([both, np.zeros((1, *both.shape[1:]))]).astype(np.float32)

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows: ``at`` has a row of word numbers per window, -1 where it is padded."""
        p, (n, steps), h = self.p, at.shape, HIDDEN
        padded = bool((at[:, -1] < 0).any())
        real = (at >= 0).astype(np.float32) if padded or keep else None
        state = np.zeros((2, n, h), np.float32)
        states, tape = np.zeros((steps, n, 2 * h), np.float32), []
        for t in range(steps):
            back = steps - 1 - t
            a = np.stack([gates[at[:, t], 0], gates[at[:, back], 1]])
            u = np.matmul(state, p["u"])
            zr = 0.5 + 0.5 * np.tanh(0.5 * (a[..., :2 * h] + u[..., :2 * h]))
            z, r, un = zr[..., :h], zr[..., h:], u[..., 2 * h:]
            new = np.tanh(a[..., 2 * h:] + r * un)
            following = new + z * (state - new)
            if real is not None:
                m = np.stack([real[:, t], real[:, back]])[..., None]
                following = state + m * (following - state)
            if keep:
                tape.append((state, z, r, un, new))
            state = following
            states[t, :, :h] = state[0]
            states[back, :, h:] = state[1]
        focus = states @ p["v"]
        if real is not None:
            focus = np.where(real.T > 0, focus, -1e9)
        focus = np.exp(focus - focus.max(0))
        focus /= focus.sum(0)
        pooled = np.einsum("tn,tnh->nh", focus, states)
        logits = pooled @ p["o"] + p["c"]
        return (logits, (real, states, focus, pooled, tape)) if keep else logits

    def gradient(self, at: np.ndarray, kept: tuple, slope: np.ndarray, n_words: int) -> dict:
        """Gradients by parameter, and of the gates of each word, from those of the logits."""
        p, h = self.p, HIDDEN
        real, states, focus, pooled, tape = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["c"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * p["o"]
        d_focus = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = focus * (d_focus - (focus * d_focus).sum(0))
        g["v"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = focus[..., None] * d_pooled + d_score[..., None] * p["v"]
        d_gates = np.zeros((n_words + 1, 2, 3 * h), np.float32)
        steps = len(tape)
        d_state = np.zeros((2, len(at), h), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            state, z, r, un, new = tape[t]
            d_state[0] += d_states[t, :, :h]
            d_state[1] += d_states[back, :, h:]
            m = np.stack([real[:, t], real[:, back]])[..., None]
            d = d_state * m
            dz = d * (state - new) * z * (1 - z)
            dn = d * (1 - z) * (1 - new * new)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], -1)
            da = np.concatenate([dz, dr, dn], -1)
            g["u"] += np.matmul(state.transpose(0, 2, 1), du)
            d_state = d_state * (1 - m) + d * z + np.matmul(du, p["u"].transpose(0, 2, 1))
            np.add.at(d_gates[:, 0], at[:, t], da[0])
            np.add.at(d_gates[:, 1], at[:, back], da[1])
        g["gates"] = d_gates[:-1]
        return g

    def spread(self, g: dict, x: np.ndarray, slots: tuple) -> dict:
        """Carry the gradients of the gates on to weights and embeddings."""
        word, grams, starts, prefix = slots
        d = g.pop("gates")
        g["w"], g["b"] = np.einsum("ni,ndj->dij", x, d), d.sum(0)
        dx = np.einsum("ndj,dij->ni", d, self.p["w"])
        counts = np.diff(np.append(starts, len(grams)))
        np.add.at(g["word"], word, dx[:, :EMBED])
        g["word"][0] = 0
        np.add.at(g["prefix"], prefix, dx[:, EMBED:])
        np.add.at(g["char"], grams,
                  np.repeat(dx[:, EMBED:] / np.sqrt(counts)[:, None], counts, axis=0))
        return g


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def vocabulary_of(texts: list[list[bytes]]) -> list[bytes]:
    """Words that get an embedding: those in enough of the training texts, the most frequent."""
    counts = Counter(w for words in texts for w in {bare(w) for w in words})
    least = max(LEAST_TEXTS, LEAST_SHARE * len(texts))
    ranked = sorted((-n, w) for w, n in counts.items() if n >= least)
    return [w for _, w in ranked[:MOST_WORDS]]


def windows_of(rows: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """A matrix of word numbers, one line per window, padded with -1."""
    if len(rows) < window:
        rows = np.concatenate([rows, np.full(window - len(rows), -1, rows.dtype)])
    return rows[np.array(window_starts(len(rows), window, stride))[:, None] + np.arange(window)]


def train(sample: list[tuple[str, int]], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit the network: a document is as toxic as its worst window.

    Each step takes the worst window of every document of a batch, and of clean ones the next
    worst as well, and moves all parameters by Adam on the balanced log loss. The sample is gone
    through in whole passes until ``steps`` are done.
    """
    texts = [(words_of(t), y) for t, y in sample]
    texts = [(w, y) for w, y in texts if w]
    net = Network(seed, vocabulary_of([w for w, _ in texts]))
    if len({y for _, y in texts}) < 2:
        net.p["o"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    share = np.mean([y for _, y in texts])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            batch = [texts[i] for i in order[a:a + BATCH]]
            met = sorted({w for words, _ in batch for w in words})
            number = {w: i for i, w in enumerate(met)}
            x, slots = net.inputs(met)
            gates = net.gates(x)
            cut = [windows_of(np.array([number[w] for w in words])) for words, _ in batch]
            logits = np.split(net.forward(gates, np.concatenate(cut)),
                              np.cumsum([len(c) for c in cut])[:-1])
            rows, target, weight = [], [], []
            for c, l, (_, y) in zip(cut, logits, batch):
                worst = np.argsort(-l)[:1 if y else HARDEST]
                rows.append(c[worst])
                target += [y] * len(worst)
                weight += [(0.5 / share if y else 0.5 / (1 - share)) / len(worst)] * len(worst)
            at, y = np.concatenate(rows), np.array(target, np.float32)
            logit, kept = net.forward(gates, at, keep=True)
            slope = (1 / (1 + np.exp(-logit)) - y) * np.array(weight, np.float32) / len(batch)
            g = net.spread(net.gradient(at, kept, slope.astype(np.float32), len(met)), x, slots)
            step += 1
            rate = RATE * max(0.1, 1 - 0.9 * step / steps)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                square = g[k] ** 2
                if k in ("word", "char", "prefix"):
                    # Embeddings lean to one step size, so what many texts agree on moves most.
                    square = np.sqrt(square * square.max())
                s[k] = 0.99 * s[k] + 0.01 * square
                up = (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
                fast = EMBED_RATE if k in ("word", "char", "prefix") else 1.0
                net.p[k] = (net.p[k] - fast * rate * up).astype(np.float32)
    return net


class Scorer:
    """Scores texts with a trained network; remembers the gates of words it has met."""

    def __init__(self, net: Network):
        self.net, self.number = net, {}
        self.gates = net.gates(np.zeros((0, 2 * EMBED), np.float32))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > KNOWN_WORDS:
            self.__init__(self.net)
        new = list(set(words) - self.number.keys())
        if new:
            fresh = self.net.gates(self.net.inputs(new)[0])
            start = len(self.gates) - 1
            self.gates = np.concatenate([self.gates[:-1], fresh])
            self.number.update(zip(new, range(start, start + len(new))))
        number = self.number
        return np.array([number[w] for w in words], np.int64)

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """The worst window's logit of each text; of a text without words, that of no input."""
        rows = self.numbers([w for words in texts for w in words])
        ends = np.cumsum([len(words) for words in texts])
        cut = [windows_of(r) for r in np.split(rows, ends[:-1])]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        at = np.concatenate(cut)
        found = np.empty(len(at), np.float32)
        # Whole windows need no mask, so they are scored apart from the padded ones.
        for kind in (np.flatnonzero(at[:, -1] >= 0), np.flatnonzero(at[:, -1] < 0)):
            for a in range(0, len(kind), CHUNK_WINDOWS):
                part = kind[a:a + CHUNK_WINDOWS]
                found[part] = self.net.forward(self.gates, at[part])
        worst = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(worst, owner, found)
        return worst

    def scores(self, texts: pd.Series) -> np.ndarray:
        out, held, size = [], [], 0
        for text in texts:
            words = words_of(text)
            held.append(words)
            size += len(words)
            if size >= CHUNK_WORDS:
                out.append(self.logits(held))
                held, size = [], 0
        if held:
            out.append(self.logits(held))
        logits = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logits.astype(float), -50, 50)))


def score_column(net: Network, text: Column) -> Column:
    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for batch in batches:
            yield pd.Series(scorer.scores(batch))

    return compute(text.cast("string"))


def held_out(id_column: Column, folds: int = 5, fold: int = 0) -> Column:
    """Rows that are kept from learning: the checksum of the id as text picks the fold."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str,
           label_column: str, per_label: int = SAMPLE_PER_LABEL) -> list[tuple[str, int]]:
    """The training sample, picked by a hash of the id: the same rows on every run.

    At most ``per_label`` ids of each label are looked up, so what is broadcast and what comes to
    the driver are bounded by parameters.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull()
                         & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    lot = F.xxhash64("id", F.lit("sample"))
    picked = known.filter("label = 0").orderBy(lot).limit(per_label).union(
        known.filter("label = 1").orderBy(lot).limit(per_label))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    found = texts.filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "id")
    rows = found.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return [(r["text"], int(r["label"])) for r in rows.orderBy(F.xxhash64("id")).collect()]


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
             text_column: str = "text", label_column: str = "toxic",
             threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text of a table: ``doc_id, held_out, score, predicted``, a row per row.

    Learns from a bounded sample of labelled rows that are not held out; labels other than 0
    and 1, null ids and null texts teach nothing, and with rows of one label only every score is
    one half. A null or empty text scores as a window without words. Repeated rows score alike;
    an empty table gives no rows; other columns are never inputs.
    """
    net = train(sample(docs, labels, id_column, text_column, label_column))
    scored = docs.select(F.col(id_column).alias("doc_id"),
                         score_column(net, F.col(text_column)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
