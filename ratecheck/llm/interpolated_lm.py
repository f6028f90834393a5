"""A language model by deleted interpolation, counted over a whole corpus.

The probability of a word after another is a mixture of the pair's share of the context, the word's
share of all words, and a uniform share for words never seen. The mixture depends on how
often the context was seen: contexts fall into buckets by the logarithm of their count, and the weights of each bucket are learned
by expectation-maximisation on held-out counts: every ``PARTS``-th training text, by a checksum of the text, lends its
pairs to the weights while its counts are left out. The final model counts all training texts.

Texts are dealt into pieces by checksum. A piece counts its words and pairs once (each as a 64-bit hash), sends
the sorted counts to the buckets of the hashes, and gets back the totals in the same order, so
a pair that a third of all texts hold travels once per piece. No table of counts is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ratecheck.llm.common import stage

PIECE_BYTES = 16 << 20
LEAST_PIECES = 16
BUCKET_BYTES = 48 << 20
PARTS = 10
ROUNDS = 12
# Counts of contexts fall into buckets by their binary logarithm; the last one takes the rest.
BUCKETS = 40
FLOOR = 1e-6
KNOWN_WORDS = 1 << 19
LEVEL = 3
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Hashes of the end token and of the place before the first word; no word has an empty text or a space.
END = xxhash.xxh64_intdigest(b"", 1)
BEGIN = xxhash.xxh64_intdigest(b" ", 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(32)


def held_out(id_column: Column, folds: int = 5, fold: int = 1) -> Column:
    """Rows that are kept from learning: the checksum of the id as text picks the fold."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


class Tokens:
    """Hashes of the tokens of texts; the hashes of recent words are kept."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        """The begin mark, the words with ASCII letters in lower case, and the end."""
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = [BEGIN]
        for word in text.translate(LOWER).split():
            value = known.get(word)
            if value is None:
                value = known[word] = digest(word)
            out.append(value)
        out.append(END)
        return np.array(out, np.uint64)


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it."""
    mixed = (tokens[:-1] ^ (tokens[:-1] >> HALF)) * MIX
    mixed = (mixed ^ tokens[1:]) * MIX
    return mixed ^ (mixed >> HALF)


class Piece:
    """Distinct words and pairs of a set of texts, and where each token's count stands."""

    def __init__(self, texts: list[bytes]):
        reader = Tokens()
        rows = [reader.of(t) for t in texts]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        pairs = pairs_of(flat)[~first[1:]] if len(flat) else flat
        # Words come with the lowest bit off, pairs with it on.
        both = np.concatenate([flat & ~np.uint64(1), pairs | np.uint64(1)])
        self.keys, place = np.unique(both, return_inverse=True)
        self.words, self.pairs = place[:len(flat)], place[len(flat):]
        self.first = first

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How often each key occurs in the marked texts."""
        marked = np.repeat(rows, self.sizes)
        used = np.concatenate([self.words[marked], self.pairs[marked[~self.first]]])
        return np.bincount(used, minlength=len(self.keys))


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed; small values take little room."""
    head = np.array([len(columns[0])], "<i8").tobytes()
    return zstandard.compress(head + b"".join(
        np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), LEVEL)


def expand(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    (n,), at, out = np.frombuffer(data, "<i8", 1), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        turned = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.ascontiguousarray(turned).view(kind).reshape(n))
        at += n * width
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def rows_of(texts: DataFrame, pieces: int) -> DataFrame:
    """``piece, held, lends, id, packed``: texts dealt by a checksum, compressed for the way."""
    kind = dict(texts.dtypes)["id"]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = texts.select(
        F.pmod(F.xxhash64(F.col("id").cast("string"), body), F.lit(pieces)).cast("int").alias("piece"),
        held_out(F.col("id")).alias("held"),
        (F.pmod(F.xxhash64(body), F.lit(PARTS)) == 0).alias("lends"), "id", body.alias("text"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(LEVEL).compress
        for batch in batches:
            packed = pa.array([compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], packed], names=["piece", "held", "lends", "id", "packed"])

    return marked.mapInArrow(press, f"piece int, held boolean, lends boolean, id {kind}, packed binary")


def piece_of(table: pa.Table) -> tuple[Piece, np.ndarray, np.ndarray]:
    """The texts of a piece in an order of their own, and which are held out and which lend."""
    unpack = zstandard.ZstdDecompressor().decompress
    piece = Piece([unpack(p.as_py()) for p in table.column("packed")])
    held, lends = (table.column(c).to_numpy() for c in ("held", "lends"))
    return piece, held, lends & ~held


def counted(texts: DataFrame, pieces: int, buckets: int) -> DataFrame:
    """One row per text: its tokens and the totals of its words and pairs.

    ``kind`` 0 rows hold a text's counts (``packed``): of its words, from the begin mark on, and its pairs; a text that
    lends has the totals without lenders as well. ``kind`` 1 rows hold sums over words: ``known`` distinct ones, ``total``
    occurrences, and ``total_rest`` without lenders.
    """
    kind = dict(texts.dtypes)["id"]
    dealt = rows_of(texts, pieces).repartition(pieces, "piece")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        piece, held, lends = piece_of(table)
        rest, lent = piece.counts(~held & ~lends), piece.counts(lends)
        place = (piece.keys >> np.uint64(1)) % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(buckets + 1))
        out = []
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[bucket]:edges[bucket + 1]]
            out.append((bucket, squeeze(steps(piece.keys[own]), rest[own].astype("<u4"),
                                        lent[own].astype("<u4"))))
        columns = list(zip(*out)) or [(), ()]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()),
                         pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())],
                        names=["piece", "bucket", "asked"])

    asked = dealt.groupBy("piece").applyInArrow(ask, "piece int, bucket int, asked binary")

    def total(key: tuple, table: pa.Table) -> pa.Table:
        parts = [expand(p.as_py(), "<u8", "<u4", "<u4") for p in table.column("asked")]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        rest, lent = (np.bincount(place, np.concatenate([p[i] for p in parts]), len(distinct)).astype("<i8")
                      for i in (1, 2))
        answers, at = [], 0
        for own, part in zip(keys, parts):
            here = place[at:at + len(own)]
            at += len(own)
            # Only what lenders of this piece hold is asked for without the lenders' counts.
            answers.append(squeeze(rest[here] + lent[here], np.where(part[2] > 0, rest[here], 0)))
        words = ((distinct & np.uint64(1)) == 0) & (distinct != np.uint64(BEGIN & ~1))
        both = rest + lent
        sums = [int((both[words] > 0).sum()), int(both[words].sum()), int(rest[words].sum())]
        n = len(parts)
        return pa.table(
            [pa.concat_arrays([table.column("piece").combine_chunks().cast(pa.int32()), pa.array([-1], pa.int32())]),
             pa.array([key[0].as_py()] * (n + 1), pa.int32()), pa.array([*answers, None], pa.binary()),
             *[pa.array([None] * n + [s], pa.int64()) for s in sums]],
            names=["piece", "bucket", "answer", "known", "total", "total_rest"])

    answered = asked.groupBy("bucket").applyInArrow(
        total, "piece int, bucket int, answer binary, known long, total long, total_rest long")

    def meet(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        none = [pa.nulls(0, t) for t in (pa.int64(),) * 3]
        names = ["kind", "id", "held", "lends", "n_tokens", "packed", "known", "total", "total_rest"]
        if key[0].as_py() < 0:
            n = answers.num_rows
            return pa.table(
                [pa.array([1] * n, pa.int32()), pa.nulls(n, table.schema.field("id").type), pa.nulls(n, pa.bool_()),
                 pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                 *[answers.column(c) for c in names[-3:]]], names=names)
        piece, held, lends = piece_of(table)
        place = (piece.keys >> np.uint64(1)) % np.uint64(buckets)
        all_, rest = np.zeros(len(piece.keys), np.int64), np.zeros(len(piece.keys), np.int64)
        for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()):
            own = np.flatnonzero(place == bucket)
            all_[own], rest[own] = expand(data, "<i8", "<i8")
        ends = np.cumsum(piece.sizes)
        packed, pair_end = [], np.cumsum(piece.sizes - 1)
        for i, size in enumerate(piece.sizes.tolist()):
            words = piece.words[ends[i] - size:ends[i]]
            pairs = piece.pairs[pair_end[i] - size + 1:pair_end[i]]
            found = np.concatenate([all_[words], all_[pairs]])
            if lends[i]:
                found = np.concatenate([found, rest[words], rest[pairs]])
            packed.append(squeeze(found))
        n = table.num_rows
        return pa.table(
            [pa.array([0] * n, pa.int32()), table.column("id"), table.column("held"), pa.array(lends),
             pa.array(piece.sizes - 1), pa.array(packed, pa.binary()), *[pa.nulls(n, pa.int64())] * 3], names=names)

    met = dealt.groupBy("piece").cogroup(answered.groupBy("piece")).applyInArrow(
        meet, f"kind int, id {kind}, held boolean, lends boolean, n_tokens long, packed binary, "
              "known long, total long, total_rest long")
    return stage(met, "token-counts")


# ---- mixture weights ---------------------------------------------------------------------


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    """Buckets of context counts by binary logarithm; 0 for contexts never seen."""
    return np.minimum(np.frexp(contexts.astype(np.float64))[1], BUCKETS - 1)


def estimates(words: np.ndarray, pairs: np.ndarray, total: int, known: int) -> np.ndarray:
    """Three probabilities of each token: by pair, by word, uniform."""
    context = words[:-1]
    by_pair = np.divide(pairs, context, out=np.zeros(len(pairs)), where=context > 0)
    by_word = words[1:] / max(total, 1)
    return np.stack([by_pair, by_word, np.full(len(pairs), 1 / (known + 1))])


def lent_counts(rows: DataFrame) -> DataFrame:
    """``context, word, pair, n``: the counts of held-out tokens, equal ones together."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, n in zip(batch.column("packed"), batch.column("n_tokens").to_pylist()):
                (flat,) = expand(data.as_py(), "<i8")
                words, pairs = flat[2 * n + 1:3 * n + 2], flat[3 * n + 2:]
                found.append(np.stack([words[:-1], words[1:], pairs]))
            distinct, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*distinct, n]],
                                             names=["context", "word", "pair", "n"])

    lenders = rows.filter("kind = 0 AND lends").select("n_tokens", "packed")
    return lenders.mapInArrow(read, "context long, word long, pair long, n long").groupBy(
        "context", "word", "pair").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, total: int, known: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per bucket and estimate, by expectation-maximisation over the counts that texts lend.

    A round is one aggregate: for each bucket the shares that each estimate has in the probability of its
    tokens. Buckets that no lent token falls into take the weights of all tokens.
    """
    if total == 0:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    context = F.col("context")
    logarithm = F.when(context > 0, F.length(F.bin(context))).otherwise(0)
    lent = stage(lent_counts(rows).select(
        F.least(logarithm, F.lit(BUCKETS - 1)).alias("bucket"), "n",
        F.when(context > 0, F.col("pair") / context).otherwise(0.0).alias("by_pair"),
        (F.col("word") / total).alias("by_word"), F.lit(1 / (known + 1)).alias("even")), "lent-counts")
    names = ("by_pair", "by_word", "even")
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        own = [F.element_at(F.lit(weights[:, k].tolist()), F.col("bucket") + 1) * F.col(c)
               for k, c in enumerate(names)]
        whole = own[0] + own[1] + own[2]
        sums = lent.groupBy("bucket").agg(*[F.sum(F.col("n") * x / whole).alias(c)
                                            for x, c in zip(own, names)]).collect()
        shares = np.zeros((BUCKETS, 3))
        for row in sums:
            shares[row.bucket] = [row[c] for c in names]
        if not shares.sum():
            break
        seen = shares.sum(axis=1) > 0
        shares[~seen] = shares.sum(axis=0)
        weights = np.maximum(shares / shares.sum(axis=1, keepdims=True), FLOOR)
        # A context never seen says nothing about the next word.
        weights[0, 0] = 0
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


# ---- scores ------------------------------------------------------------------------------


def score(texts: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Scores are sums of decimal logarithms over the words of the whole text and its end. ``base_score``
    adds a half to the counts of single words; ``score`` is the model's. A null text is empty and has one token, its
    end; a null id counts as the empty one for the fold. Where there is nothing to learn from, both scores are
    zero, as one class of words is left. Repeated rows are rows like others; an empty table gives no rows; other columns are
    not read. Rows equal in id and text share a piece.
    """
    source = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    size = source.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    pieces = max(LEAST_PIECES, -(-size // PIECE_BYTES))
    rows = counted(source, pieces, max(LEAST_PIECES, -(-size * 2 // BUCKET_BYTES)))
    sums = rows.filter("kind = 1").agg(F.sum("known"), F.sum("total"), F.sum("total_rest")).first()
    known, total, total_rest = (int(s or 0) for s in sums)
    weights = learn(rows, total_rest, known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, n in zip(batch.column("packed"), batch.column("n_tokens").to_pylist()):
                (flat,) = expand(data.as_py(), "<i8")
                words, pairs = flat[:n + 1], flat[n + 1:2 * n + 1]
                counts = words[1:]
                base = np.log10((counts + 0.5) / (total + 0.5 * (known + 1))).sum()
                mixed = (weights[bucket_of(words[:-1])].T * estimates(words, pairs, total, known)).sum(axis=0)
                out.append((int((counts > 0).sum()), total, float(base), float(np.log10(mixed).sum())))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), batch.column("n_tokens"),
                 pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(texts.dtypes)[id_column]
    return rows.filter("kind = 0").select("id", "held", "n_tokens", "packed").mapInArrow(
        read, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
