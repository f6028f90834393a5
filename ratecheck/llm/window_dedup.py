"""Substring duplicates by super-k-mers: runs of windows that share a minimiser travel together.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash of the word pairs in
it. A run of windows with one minimiser is packed as one string of words (a super-k-mer) and
goes to the bucket of the minimiser, so all copies of a window meet in one bucket. There the
windows of strings that share a minimiser are sorted and the smallest document id of each
window is read off.

Equal strings met by one task are combined before the shuffle: every occurrence but those of the
smallest id is already known to be a repeat, is marked on the spot, and does not travel. So
a passage that a third of all documents hold reaches its bucket about once per task.

A word pair that many documents hold among different neighbours would send them all to one bucket.
Such hot minimisers are looked for in a sample of bounded size; under them every window is a
string of its own and goes by its own hash, so that only equal windows meet. The sample
decides on the way of a window alone: all windows are counted exactly either way.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

WINDOW = 13
MER_WORDS = 2
MER_BYTES = 5 * MER_WORDS
FLUSH_BYTES = 48 << 20
BUCKET_BYTES = 32 << 20
MOST_PARTS = 1 << 16
# Strings carry about three times the bytes of their text.
SPREAD = 3
# A minimiser is hot above so many bytes of strings, and seen so often in the sample of texts.
HOT_BYTES = 8 << 20
HOT_SEEN = 8
SAMPLE_SHARE = 16
SAMPLE_BYTES = 512 << 20
CHUNK_BYTES = 2 << 20
LAST_ID = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
SPARSE = np.uint64(1 << 63)
HALF = np.uint64(32)
POWERS = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ROW = pa.schema([("bucket", pa.int32()), ("pack", pa.binary()), ("id", pa.int64()),
                 ("tag", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
ROW_SQL = "bucket int, pack binary, id long, tag long, start int, stop int"
MARK = pa.schema([ROW.field(n) for n in ("id", "tag", "start", "stop")])
MARK_SQL = "id long, tag long, start int, stop int"
SEEN = pa.schema([("mer", pa.int64()), ("seen", pa.int64()), ("size", pa.int64())])
SEEN_SQL = "mer long, seen long, size long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have, least = 1, values
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def minimisers(hashes: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """The minimiser of every window of a text, from its words' hashes and lengths.

    Pairs of short words are frequent, so they rank after all others.
    """
    n = len(hashes) - MER_WORDS + 1
    mers, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for i in range(MER_WORDS):
        mers = (mers ^ hashes[i:i + n]) * STEP
        mers ^= mers >> HALF
        size += lengths[i:i + n]
    mers >>= np.uint64(1)
    mers[size < MER_BYTES] |= SPARSE
    return sliding_least(mers, window - MER_WORDS + 1)


def placed(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and bucket of minimisers or of window hashes."""
    mixed = values * MIX
    mixed ^= mixed >> HALF
    mixed *= STEP
    return mixed >> HALF, (mixed & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)


def word_hashes(line: bytes, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``line``, which single spaces part; ``sizes`` are their lengths."""
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    place = np.arange(len(line) + 1) - np.repeat(begins, sizes + 1)
    # The space after a word counts with it and tells lengths apart.
    flat = np.frombuffer(line + b" ", np.uint8).astype(np.uint64)
    hashes = np.add.reduceat((flat + np.uint64(7)) * POWERS[place & 63], begins)
    hashes ^= hashes >> HALF
    hashes *= STEP
    return hashes ^ (hashes >> HALF)


class Packer:
    """Collects the super-k-mers of a task until they are sent.

    ``hot`` holds the hot minimisers, sorted: their windows travel one by one.
    """

    def __init__(self, window: int, buckets: int, hot: np.ndarray = np.zeros(0, np.uint64)):
        self.window, self.buckets, self.hot = window, buckets, hot
        self.clear()

    def clear(self) -> None:
        self.strings: dict[bytes, tuple] = {}
        self.repeats: list[tuple] = []
        self.marks: list[tuple[int, int, int, int]] = []
        self.held = 0

    def cut(self, found: list[bytes], line: bytes
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Super-k-mers of a text: minimisers, first and last window, and where words start."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        least = minimisers(word_hashes(line, sizes), sizes, self.window)
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        return least[starts], starts, np.append(cuts, len(least)), [
            0, *np.cumsum(sizes + 1).tolist()]

    def add(self, doc: int, tag: int, text: bytes) -> None:
        """Cut a text into super-k-mers; mark those that a smaller id of this task has."""
        found = text.split()
        if len(found) < self.window:
            return
        line, more = b" ".join(found), self.window - 1
        least, starts, stops, ends = self.cut(found, line)
        single = np.isin(least, self.hot) if len(self.hot) else np.zeros(len(least), bool)
        whole = ~single
        keys, places = placed(least[whole], self.buckets)
        self.hold(doc, tag, line, ends, starts[whole].tolist(), stops[whole].tolist(),
                  keys.tolist(), places.tolist())
        if single.any():
            at = [i for a, b in zip(starts[single].tolist(), stops[single].tolist())
                  for i in range(a, b)]
            hashes = np.array([xxhash.xxh64_intdigest(line[ends[i]:ends[i + more + 1] - 1])
                               for i in at], np.uint64)
            keys, places = placed(hashes, self.buckets)
            self.hold(doc, tag, line, ends, at, [i + 1 for i in at], keys.tolist(),
                      places.tolist())

    def hold(self, doc: int, tag: int, line: bytes, ends: list[int], starts: list[int],
             stops: list[int], keys: list[int], places: list[int]) -> None:
        strings, more = self.strings, self.window - 1
        for start, stop, key, place in zip(starts, stops, keys, places):
            string = line[ends[start]:ends[stop + more] - 1]
            # A window that travels alone and a super-k-mer of one window never hold the same words.
            held = strings.get(string)
            if held is None:
                strings[string] = (doc, tag, start, stop, key, place)
                self.held += len(string) + 150
            elif doc > held[0]:
                self.marks.append((doc, tag, start, stop))
            elif doc == held[0]:
                self.repeats.append((string, (doc, tag, start, stop, key, place)))
                self.held += 150
            else:
                self.marks.append(held[:4])
                strings[string] = (doc, tag, start, stop, key, place)

    def send(self) -> Iterator[pa.RecordBatch]:
        """Packed strings per bucket, then the marks; both as rows of one schema."""
        entries: dict[int, list] = {}
        for string, entry in self.strings.items():
            entries.setdefault(entry[5], []).append((string, entry))
        for string, entry in self.repeats:
            smallest = self.strings[string]
            if entry[0] > smallest[0]:
                self.marks.append(entry[:4])
            else:
                entries[entry[5]].append((string, entry))
        for place, rows in entries.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([pack(rows)], pa.binary()),
                 *[pa.nulls(1, ROW.field(i).type) for i in range(2, 6)]], schema=ROW)
        for at in range(0, len(self.marks), 100_000):
            columns = list(zip(*self.marks[at:at + 100_000]))
            spread = pa.array([(d ^ t) % self.buckets for d, t in zip(*columns[:2])], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [spread, pa.nulls(len(spread), pa.binary()),
                 *[pa.array(c, f.type) for c, f in zip(columns, MARK)]], schema=ROW)
        self.clear()


def pack(rows: list) -> bytes:
    """Strings and their numbers, compressed as one value."""
    columns = list(zip(*[entry[:5] for _, entry in rows]))
    lines = b"\n".join(string for string, _ in rows)
    numbers = [np.array(c, t).tobytes()
               for c, t in zip(columns, ("<i8", "<i8", "<i4", "<i4", "<u4"))]
    return zstandard.compress(struct.pack("<q", len(rows)) + b"".join(numbers) + lines, 3)


def unpack(data: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    data = zstandard.decompress(data)
    (n,), at, columns = struct.unpack_from("<q", data), 8, []
    for kind in ("<i8", "<i8", "<i4", "<i4", "<u4"):
        columns.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return columns, data[at:].split(b"\n")


def repeated(packs: list[bytes], window: int) -> Iterator[tuple[int, int, int, int]]:
    """Marks for the windows of a bucket that a smaller id has as well."""
    parts = [unpack(p) for p in packs]
    ids, tags, starts, _, keys = (np.concatenate(c) for c in zip(*[p[0] for p in parts]))
    strings = [s for p in parts for s in p[1]]
    del parts
    # Strings alone with their minimiser hold no repeat, except within their own document.
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    twin = np.zeros(len(ranked), bool)
    same = ranked[1:] == ranked[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    shared, ranked = order[twin], ranked[twin]
    if not len(shared):
        return
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    owners, begin = ids[shared], edges[:-1]
    sizes = np.add.reduceat(np.array([len(strings[row]) for row in shared.tolist()]), begin)
    several = np.minimum.reduceat(owners, begin) < np.maximum.reduceat(owners, begin)
    # Several minimisers are counted at once; one is never divided.
    rows, held = [], 0
    for a, b, size in zip(begin[several].tolist(), edges[1:][several].tolist(),
                          sizes[several].tolist()):
        rows.append(shared[a:b])
        held += size
        if held > CHUNK_BYTES:
            yield from spans(strings, ids, tags, starts, np.concatenate(rows), window)
            rows, held = [], 0
    if rows:
        yield from spans(strings, ids, tags, starts, np.concatenate(rows), window)


def spans(strings: list[bytes], ids: np.ndarray, tags: np.ndarray, starts: np.ndarray,
          group: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Marks of the strings in ``group``."""
    hits: dict[int, list[int]] = {}
    for row, i in later(strings, ids, group, window):
        hits.setdefault(row, []).append(i)
    for row, at in hits.items():
        at.sort()
        doc, tag, start = int(ids[row]), int(tags[row]), int(starts[row])
        for first, last in runs(at):
            yield doc, tag, start + first, start + last + 1


def later(strings: list[bytes], ids: np.ndarray, group: np.ndarray, window: int
          ) -> Iterator[tuple[int, int]]:
    """Row and place of every window of a group that a smaller id has as well.

    Windows are sorted by hash; those of one hash are told apart by their words.
    """
    hashes, rows, places = array("Q"), array("q"), array("q")
    begins, ends = array("q"), array("q")
    digest = xxhash.xxh64_intdigest
    for row in group.tolist():
        string = strings[row]
        edges = [0, *accumulate(len(w) + 1 for w in string.split(b" "))]
        stops = edges[window:]
        hashes.extend([digest(string[a:b - 1]) for a, b in zip(edges, stops)])
        begins.extend(edges[:len(stops)])
        ends.extend(stops)
        rows.extend([row] * len(stops))
        places.extend(range(len(stops)))
    ranked = np.frombuffer(hashes, np.uint64)
    order = np.argsort(ranked, kind="stable")
    ranked = ranked[order]
    owners = ids[np.frombuffer(rows, np.int64)][order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    counts = np.diff(np.append(first, len(ranked)))
    several = np.minimum.reduceat(owners, first) < np.maximum.reduceat(owners, first)
    for a, n in zip(first[several].tolist(), counts[several].tolist()):
        equal: dict[bytes, list[int]] = {}
        for at in order[a:a + n].tolist():
            equal.setdefault(strings[rows[at]][begins[at]:ends[at] - 1], []).append(at)
        for held in equal.values():
            docs = [int(ids[rows[at]]) for at in held]
            least = min(docs)
            for at, doc in zip(held, docs):
                if doc > least:
                    yield rows[at], places[at]


def runs(numbers: Iterable[int]) -> Iterator[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    first = last = None
    for number in numbers:
        if last is not None and number == last + 1:
            last = number
            continue
        if last is not None:
            yield first, last
        first = last = number
    if last is not None:
        yield first, last


def hot_minimisers(docs: DataFrame, total: int, window: int) -> np.ndarray:
    """Minimisers whose strings in a table of ``total`` bytes of text pass ``HOT_BYTES``, sorted.

    They are estimated from whole texts, one in ``SAMPLE_SHARE`` or fewer, ``SAMPLE_BYTES`` of
    them at most by expectation, picked by a hash; each was seen ``HOT_SEEN`` times there, so
    their number is bounded by the sample and not by the table.
    """
    share = max(SAMPLE_SHARE, -(-total // SAMPLE_BYTES))
    picked = docs.filter(F.pmod(F.xxhash64("id", "tag", F.lit("sample")), F.lit(share)) == 0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, 1)
        for batch in batches:
            found: dict[int, list[int]] = {}
            for text in batch.column(0):
                words = text.as_py().encode().split() if text.is_valid else []
                if len(words) < window:
                    continue
                least, starts, stops, ends = packer.cut(words, b" ".join(words))
                for mer, start, stop in zip(least.view(np.int64).tolist(), starts.tolist(),
                                            stops.tolist()):
                    entry = found.setdefault(mer, [0, 0])
                    entry[0] += 1
                    entry[1] += ends[stop + window - 1] - ends[start]
            rows = [(mer, *entry) for mer, entry in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [(), (), ()], SEEN)],
                schema=SEEN)

    seen = picked.select("text").mapInArrow(look, SEEN_SQL).groupBy("mer").agg(
        F.sum("seen").alias("seen"), F.sum("size").alias("size"))
    hot = seen.filter((F.col("seen") >= HOT_SEEN) & (F.col("size") * share >= HOT_BYTES))
    found = np.array([r[0] for r in hot.select("mer").collect()], np.int64)
    return np.sort(found.view(np.uint64))


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, tag, start, stop``: runs of windows of a row that start in a smaller id as well.

    ``docs`` has ``id`` (long, not null), ``tag`` and ``text``.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total * SPREAD // BUCKET_BYTES))
    parts = min(buckets, MOST_PARTS)
    hot = hot_minimisers(docs, total, window)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, buckets, hot)
        for batch in batches:
            for doc, tag, text in zip(*[batch.column(i) for i in range(3)]):
                if text.is_valid:
                    packer.add(doc.as_py(), tag.as_py(), text.as_py().encode())
                if packer.held > FLUSH_BYTES:
                    yield from packer.send()
        yield from packer.send()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, packs = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            found = list(repeated(packs, window)) if packs else []
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found), MARK)], schema=MARK)

        for batch in batches:
            ready = batch.filter(batch.column("id").is_valid())
            if ready.num_rows:
                yield ready.select(["id", "tag", "start", "stop"])
            packed = batch.filter(batch.column("pack").is_valid())
            for bucket, data in zip(packed.column("bucket").to_pylist(),
                                    packed.column("pack").to_pylist()):
                if bucket != place:
                    yield from settle()
                    place, packs = bucket, []
                packs.append(data)
        yield from settle()

    sent = docs.select("id", "tag", "text").mapInArrow(split, ROW_SQL)
    met = sent.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    return met.mapInArrow(count, MARK_SQL)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window that also starts in a document of a smaller id.

    Returns ``doc_id, n_words, n_removed, kept_text``, one row per input row. Windows are judged on
    the input. Texts of fewer words than a window, empty or null ones included, keep what they
    have; null has no words. A null id is larger than any other, and null ids are equal to each
    other; rows that repeat an id do not remove each other's words. An empty table gives no
    rows. Other columns are not read. Rows of one id are told apart by a checksum of their text.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.crc32(F.col(text_column).cast("string").cast("binary")).alias("tag"),
        F.col(text_column).cast("string").alias("text"))
    found = marks(rows, window).groupBy("id", "tag").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    kind = dict(docs.dtypes)[id_column]

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = [press((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("id"), batch.column("tag"),
                 pa.array(texts, pa.binary())], names=["doc_id", "id", "tag", "packed"])

    # Texts meet their spans in a shuffle; they travel compressed.
    packed = rows.withColumn("tag", F.coalesce("tag", F.lit(-1))).mapInArrow(
        shrink, f"doc_id {kind}, id long, tag long, packed binary")
    joined = packed.join(found, ["id", "tag"], "left").select("doc_id", "packed", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("packed"), batch.column("spans")):
                words = expand(text.as_py()).split()
                gone = np.zeros(len(words), bool)
                for span in spans.as_py() or []:
                    gone[span["start"]:span["stop"] + window - 1] = True
                left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), b" ".join(left).decode()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(
        cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
