"""Phrase collocations by Rabin-Karp fingerprints.

1. ``fingerprints``: a chunk of texts becomes one array of bytes, its words lower-cased and
   joined by single spaces. Prefix polynomials over these bytes give the 64-bit fingerprint of
   every n-gram by one subtraction and one product.
2. ``busy_buckets``: every task adds up occurrences by bucket, the low 32 bits of a fingerprint, and
   the shuffle, which takes one row for each task and range of buckets, adds up those sums: some two bytes for each distinct
   n-gram of a task. Words come first, then pairs of frequent
   words, then 3 to 5 words all of whose pairs are frequent. A phrase is at most as frequent as
   its parts and as its bucket, so nothing is lost. "Frequent" is read from a bit table of fixed size
   (``FILTER_BITS``): a wrong bit lets a rare fingerprint through and costs shuffle alone.
3. ``counted``: one scan counts the fingerprints of frequent buckets, and these alone, in full and keeps a pointer
   (row, first word) to one occurrence of each.
4. ``materialised``: the pointers of frequent fingerprints, and only these, are followed to
   their texts.
5. ``verified``: one more scan compares every counted occurrence of a frequent fingerprint with
   that text, byte by byte. Those that differ (a collision, or another language) are emitted
   with their own text, counted by it and taken off. Up to ``REPRESENTATIVES`` texts are
   sent to the tasks; beyond, none is sent, and all occurrences count by their texts in
   a shuffle. Counts are exact either way.

Collocations are ranked per language. Null languages count as ``und``, null texts as empty.
Texts without words give nothing. Rows are counted one by one, repeated rows and ids
included; ids are not read. Ties have a total order, see ``collocations``. Other columns
are not read, whatever their names. Very long texts are hashed whole; memory grows with the
longest single text. An empty table gives an empty result. Counts stay exact up to
10^38 for the product 1000 * a * n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import _LOWER, U64, bytes_of, chunks, mixed, powers, small, staged, word_bounds
from tarnmill.llm.ranking import first_rows

LONGEST = 5
MIN_COUNT = 100
FIRST = 2000
FILTER_BITS = 1 << 27
SEGMENT_BITS = 1 << 21
# fingerprints or buckets that a task adds up before it hands them on
HELD = 1_000_000
# occurrences that a task sorts at once, for each of these
SORTED_AT_ONCE = 4
REPRESENTATIVES = 1 << 19

_BYTES = np.arange(256)
PIECE_END = np.isin(_BYTES, list(b".,;:!?\n\x0b\x0c\r"))
WORD = ~(PIECE_END | np.isin(_BYTES, list(b" \t")))
_BASE = 0xB5297A4D3F84D5B5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

# sums of one task for a range of fingerprints, in ``planes``
PART_SCHEMA = "segment int, held int, sums binary"
FOUND_SCHEMA = "fp bigint, n bigint, row bigint, word int, width int"
# ranges of fingerprints for each partition of the rows: so a range has no more sums than a task hands on, however many tasks there are
RANGES = 4
_COLUMNS = [np.uint64, np.int64, np.int64, np.int32, np.int8]
# steps between neighbouring buckets, and their sums
_BUCKET_COLUMNS = [np.uint32, np.int64]


class Words:
    """The words of a chunk of rows, normalised, with prefix polynomials over their bytes."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, bounds = bytes_of(texts)
        starts, stops, self.rows = word_bounds(data, bounds, WORD)
        lengths = stops - starts
        # words with one space behind each
        ends = np.cumsum(lengths + 1)
        self.starts, self.stops = ends - lengths - 1, ends - 1
        size = int(ends[-1]) if len(ends) else 0
        inside = np.ones(size, bool)
        inside[self.stops] = False
        self.bytes = np.full(size, 32, np.uint8)
        self.bytes[inside] = _LOWER[data[WORD[data]]].astype(np.uint8)
        # words lie in one piece if no piece ends between them
        cuts = np.cumsum(PIECE_END[data])
        self.pieces = cuts[starts] if len(starts) else np.zeros(0, np.int64)
        self.first_word = np.searchsorted(self.rows, np.arange(len(bounds) - 1))
        coded = pc.fill_null(langs, "und").dictionary_encode()
        self.langs, self.lang_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([int(hash_of(lang)) for lang in self.langs.to_pylist()], np.uint64)
        self.seeds = seeds[self.lang_of[self.rows]] if len(starts) else np.zeros(0, np.uint64)
        self.running = np.zeros(size + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + U64(1)) * powers(_BASE, size)[:size], out=self.running[1:])
        self.scale = powers(_BASE_INVERSE, size)

    def grams(self, width: int) -> np.ndarray:
        """First words of all n-grams of ``width`` words within a piece and a row."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.pieces[:n] == self.pieces[width - 1 :]) & (self.rows[:n] == self.rows[width - 1 :]))

    def fingerprints(self, first: np.ndarray, width: int, keep: int = 64) -> np.ndarray:
        """Fingerprints of the n-grams that begin at the words ``first``, of ``keep`` bits."""
        start, stop = self.starts[first], self.stops[first + width - 1]
        value = (self.running[stop] - self.running[start]) * self.scale[start]
        value = mixed(mixed(value ^ (stop - start).astype(np.uint64)) ^ self.seeds[first])
        return value >> U64(64 - keep) if keep < 64 else value

    def texts(self, first: np.ndarray, width: int) -> pa.Array:
        """The words of these n-grams as text."""
        start, stop = self.starts[first], self.stops[first + width - 1]
        sizes = stop - start
        ends = np.append(0, np.cumsum(sizes))
        flat = self.bytes[np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])


def hash_of(lang: str) -> np.uint64:
    """A 64-bit hash of a language name."""
    value = U64(0)
    with np.errstate(over="ignore"):
        for byte in lang.encode():
            value = value * U64(0x100000001B3) ^ U64(byte + 1)
    return mixed(np.array([value], np.uint64))[0]


class Sums:
    """Occurrences by fingerprint: how many, and where one of them is."""

    def __init__(self):
        self.parts, self.held, self.settled = [], 0, 0

    def add(self, fp, n, row, word, width) -> None:
        self.parts.append((fp, n, row, word, width))
        self.held += len(fp)
        if self.held > self.settled + HELD:
            self.settle()

    def settle(self) -> None:
        fp, n, row, word, width = (np.concatenate(columns) for columns in zip(*self.parts))
        order = np.argsort(fp, kind="stable")
        ordered = fp[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(fp) else np.zeros(0, np.int64)
        one = order[heads]
        self.parts = [(ordered[heads], np.add.reduceat(n[order], heads) if len(heads) else n, row[one], word[one], width[one])]
        self.held = self.settled = len(heads)

    def batches(self, segments: int) -> Iterator[pa.RecordBatch]:
        """One row for each range of fingerprints."""
        if self.parts:
            self.settle()
            columns = [c.astype(kind, copy=False) for c, kind in zip(self.parts[0], _COLUMNS)]
            self.parts, self.held, self.settled = [], 0, 0
            yield from by_segment(segment_of(columns[0], segments), lambda own: [c[own] for c in columns])


class Buckets:
    """Occurrences by bucket: how many, without a trace of where."""

    def __init__(self):
        self.raw, self.pending = [], 0
        self.buckets, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, fp: np.ndarray) -> None:
        self.raw.append(fp.astype(np.uint32))
        self.pending += len(fp)
        if self.pending > SORTED_AT_ONCE * HELD:
            self.settle()

    def settle(self) -> None:
        if self.pending:
            buckets, n = np.unique(np.concatenate(self.raw), return_counts=True)
            self.buckets, self.n = summed(np.concatenate([self.buckets, buckets]), np.concatenate([self.n, n])) if len(self.buckets) else (buckets, n)
        self.raw, self.pending = [], 0

    def batches(self, segments: int) -> Iterator[pa.RecordBatch]:
        """One row for each range of buckets."""
        self.settle()
        buckets, n = self.buckets, self.n.astype(np.int64)
        self.buckets, self.n = buckets[:0], n[:0]
        segment = segment_of(buckets.astype(np.uint64) << U64(32), segments)
        yield from by_segment(segment, lambda own: [np.diff(buckets[own], prepend=np.uint32(0)), n[own]])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their sums), ascending."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(keys)]
    return ordered[heads], np.add.reduceat(n[order], heads) if len(heads) else n


def by_segment(segment: np.ndarray, columns: Callable[[slice], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row for each segment, with the columns of its range in ``planes``."""
    heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.zeros(0, np.int64)
    stops = np.append(heads[1:], len(segment))
    for at in range(0, len(heads), 64):
        some = list(zip(heads[at : at + 64].tolist(), stops[at : at + 64].tolist()))
        arrays = [pa.array(segment[heads[at : at + 64]]), pa.array([stop - start for start, stop in some], pa.int32()), pa.array([planes(columns(slice(start, stop))) for start, stop in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["segment", "held", "sums"])


def segment_of(fp: np.ndarray, segments: int) -> np.ndarray:
    """The range that holds each fingerprint; ranges rise with the fingerprints."""
    return ((fp >> U64(32)) * U64(segments) >> U64(32)).astype(np.int32)


def planes(columns: list[np.ndarray]) -> bytes:
    """The columns' first bytes, second bytes and so on: sorted, small and equal numbers shrink well in this order."""
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def of_planes(raw: bytes, n: int, kinds: list = _COLUMNS) -> list[np.ndarray]:
    """The columns in ``planes``."""
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def has(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether a fingerprint's bit is set."""
    place = fp % U64(FILTER_BITS)
    return (bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1


def candidates(words: Words, widths: list[int], keep: int, bits: np.ndarray | None, part: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, first words) of the n-grams all of whose parts of ``part`` words are in ``bits``."""
    if bits is not None:
        parts = words.grams(part)
        good = np.zeros(len(words.starts) + 1, bool)
        good[parts] = has(bits, words.fingerprints(parts, part, keep))
    for width in widths:
        first = words.grams(width)
        if bits is not None:
            for k in range(width - part + 1):
                first = first[good[first + k]]
        yield width, first


def busy_buckets(rows: DataFrame, widths: list[int], least: int, keep: int, bits=None, part: int = 0) -> DataFrame:
    """Buckets that the ``candidates`` of these widths fill ``least`` times or more, as ``fp``."""
    segments = RANGES * max(1, rows.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Buckets()
        for chunk in chunks(batches):
            words = Words(chunk.column("text"), chunk.column("lang"))
            for width, first in candidates(words, widths, keep, bits.value if bits is not None else None, part):
                sums.add(words.fingerprints(first, width, keep))
            # beyond this many different ones memory would grow with the task's input
            if len(sums.buckets) > HELD:
                yield from sums.batches(segments)
        yield from sums.batches(segments)

    def add(table: pa.Table) -> pa.Table:
        held = [of_planes(raw.as_py(), n.as_py(), _BUCKET_COLUMNS) for raw, n in zip(table.column("sums"), table.column("held"))]
        buckets, total = summed(np.concatenate([np.cumsum(steps, dtype=np.uint32) for steps, _ in held]), np.concatenate([n for _, n in held]))
        return pa.table([pa.array(buckets[total >= least].astype(np.int64))], ["fp"])

    return staged(rows.mapInArrow(count, PART_SCHEMA).groupBy("segment").applyInArrow(add, "fp bigint"), "buckets")


def counted(rows: DataFrame, levels: list, keep: int) -> DataFrame:
    """Partial counts of the ``candidates`` of all levels whose own bucket is in the level's bits."""
    segments = RANGES * max(1, rows.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for chunk in chunks(batches):
            words = Words(chunk.column("text"), chunk.column("lang"))
            ids = chunk.column("row").to_numpy()
            for width, first, fp in busy(words, levels, keep):
                own = words.rows[first]
                sums.add(fp, np.ones(len(first), np.int64), ids[own], (first - words.first_word[own]).astype(np.int32), np.full(len(first), width, np.int8))
            if sums.settled > HELD:
                yield from sums.batches(segments)
        yield from sums.batches(segments)

    return rows.mapInArrow(count, PART_SCHEMA)


def busy(words: Words, levels: list, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, first words, fingerprints) of the n-grams of all levels that have their bit and their parts'."""
    for widths, bits, part in levels:
        for width, first in candidates(words, widths, keep, bits.value if part else None, part):
            fp = words.fingerprints(first, width, keep)
            hit = np.flatnonzero(has(bits.value, fp))
            yield width, first[hit], fp[hit]


def frequent(parts: DataFrame, least: int) -> DataFrame:
    """Fingerprints that occur ``least`` times or more, with one pointer each."""

    def add(table: pa.Table) -> pa.Table:
        held = [of_planes(raw.as_py(), n.as_py()) for raw, n in zip(table.column("sums"), table.column("held"))]
        fp, n, row, word, width = (np.concatenate(columns) for columns in zip(*held))
        order = np.argsort(fp, kind="stable")
        ordered = fp[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total, sizes = np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(fp)))
        often = np.flatnonzero(total >= least)
        # the first occurrence of each of these
        group = np.repeat(np.arange(len(often)), sizes[often])
        own = order[np.repeat(heads[often] - (np.cumsum(sizes[often]) - sizes[often]), sizes[often]) + np.arange(len(group))]
        own = own[np.lexsort((width[own], word[own], row[own], group))]
        own = own[np.cumsum(sizes[often]) - sizes[often]]
        arrays = [fp[own].view(np.int64), total[often], row[own], word[own], width[own].astype(np.int32)]
        return pa.table([pa.array(a) for a in arrays], ["fp", "n", "row", "word", "width"])

    return staged(parts.groupBy("segment").applyInArrow(add, FOUND_SCHEMA), "frequent")


def bit_table(found: DataFrame) -> np.ndarray:
    """The bits of all fingerprints in ``found``; of fixed size, built in segments by the tasks."""

    def build(key, table):
        place = table.column("place").to_numpy() % SEGMENT_BITS
        bits = np.zeros(SEGMENT_BITS // 8, np.uint8)
        np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return pa.table({"segment": [key[0].as_py()], "bits": [bits.tobytes()]})

    # FILTER_BITS is a power of two, so the remainder is that of the unsigned value
    placed = found.select(F.pmod("fp", F.lit(FILTER_BITS)).alias("place")).distinct()
    segments = placed.withColumn("segment", F.floor(F.col("place") / SEGMENT_BITS)).groupBy("segment").applyInArrow(build, "segment bigint, bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for segment, bits in segments.toLocalIterator():
        at = segment * (SEGMENT_BITS // 8)
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def materialised(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, lang, phrase, n, width) from the texts that the pointers name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                words = Words(row.column("text"), row.column("lang"))
                points = row.column("points")[0].values
                fp, n, word, width = (points.field(k).to_numpy() for k in range(4))
                for w in np.unique(width):
                    own = width == w
                    lang = pa.array([words.langs[0].as_py()] * int(own.sum()))
                    arrays = [pa.array(fp[own]), lang, words.texts(word[own].astype(np.int64), int(w)).cast(pa.string()), pa.array(n[own]), pa.array(width[own])]
                    yield pa.RecordBatch.from_arrays(arrays, ["fp", "lang", "phrase", "n", "width"])

    points = found.groupBy("row").agg(F.collect_list(F.struct("fp", "n", "word", "width")).alias("points"))
    return rows.join(small(points), "row").mapInArrow(cut, "fp bigint, lang string, phrase string, n bigint, width int")


def verified(rows: DataFrame, found: DataFrame, levels: list, keep: int, least: int) -> DataFrame:
    """(lang, phrase, width, f) of all phrases that occur ``least`` times or more, exactly counted.

    ``levels``: the (widths, bits, part) by whose ``busy`` n-grams the fingerprints in ``found`` were counted.
    """
    spark = rows.sparkSession
    known = staged(materialised(rows, found), "materialised") if found.count() <= REPRESENTATIVES else None
    fps, texts, langs, table = np.zeros(0, np.uint64), pa.array([], pa.large_string()), [], None
    if known is not None:
        columns = known.select("fp", "lang", "phrase").toArrow().combine_chunks()
        fps = columns.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fps)
        fps, columns = fps[order], columns.take(pa.array(order))
        texts, langs = columns.column("phrase").cast(pa.large_string()).combine_chunks(), columns.column("lang").to_pylist()
    else:
        table = spark.sparkContext.broadcast(bit_table(found))
    names: dict[str, int] = {}
    codes = np.array([names.setdefault(lang, len(names)) for lang in langs], np.int32)
    sent = spark.sparkContext.broadcast((fps, *bytes_of(texts), codes, names))

    def agree(words: Words, first: np.ndarray, width: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those with a frequent fingerprint, whether their text is its representative's)."""
        fps, data, bounds, codes, names = sent.value
        if table is not None:
            hit = np.flatnonzero(has(table.value, fp))
            return hit, np.zeros(len(hit), bool)
        if not len(fps):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        place = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
        hit = np.flatnonzero(fps[place] == fp)
        place, first = place[hit], first[hit]
        own_codes = np.array([names.get(lang, -1) for lang in words.langs.to_pylist()], np.int32)
        start, size = words.starts[first], words.stops[first + width - 1] - words.starts[first]
        same = (bounds[place + 1] - bounds[place] == size) & (codes[place] == own_codes[words.lang_of[words.rows[first]]])
        at = np.flatnonzero(same)
        for some in np.array_split(at, 1 + len(at) // 50_000):
            if len(some):
                ends = np.append(0, np.cumsum(size[some]))
                step = np.arange(ends[-1])
                equal = words.bytes[np.repeat(start[some] - ends[:-1], size[some]) + step] == data[np.repeat(bounds[place[some]] - ends[:-1], size[some]) + step]
                same[some] = np.logical_and.reduceat(equal, ends[:-1])
        return hit, same

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            words = Words(chunk.column("text"), chunk.column("lang"))
            for width, first, fp in busy(words, levels, keep):
                hit, same = agree(words, first, width, fp)
                first, fp = first[hit[~same]], fp[hit[~same]]
                if len(first):
                    lang = words.langs.take(pa.array(words.lang_of[words.rows[first]]))
                    texts = pa.table([pa.array(fp.view(np.int64)), lang.cast(pa.string()), words.texts(first, width)], ["fp", "lang", "phrase"])
                    equal = texts.group_by(["fp", "lang", "phrase"]).aggregate([([], "count_all")]).combine_chunks()
                    arrays = [equal.column("fp"), equal.column("lang"), equal.column("phrase").cast(pa.string()), equal.column("count_all")]
                    arrays = [a.combine_chunks() for a in arrays] + [pa.array(np.full(equal.num_rows, width, np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, ["fp", "lang", "phrase", "n", "width"])

    others = rows.mapInArrow(differing, "fp bigint, lang string, phrase string, n bigint, width int")
    # a rare phrase among them may have been counted in part; it fails the threshold all the same
    others = staged(others.groupBy("fp", "lang", "phrase", "width").agg(F.sum("n").alias("f")), "others")
    counts = others.select("lang", "phrase", "width", "f")
    if known is not None:
        wrong = others.groupBy("fp").agg(F.sum("f").alias("wrong"))
        counts = counts.union(known.join(wrong, "fp", "left").select("lang", "phrase", "width", (F.col("n") - F.coalesce("wrong", F.lit(0))).alias("f")))
    out = staged(counts.where(F.col("f") >= least), "phrases")
    sent.unpersist()
    return out


def word_totals(rows: DataFrame) -> DataFrame:
    """All word occurrences per language."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for chunk in chunks(batches):
            data, bounds = bytes_of(chunk.column("text"))
            _, _, of = word_bounds(data, bounds, WORD)
            own = np.bincount(of, minlength=chunk.num_rows)
            for lang, n in zip(pc.fill_null(chunk.column("lang"), "und").to_pylist(), own.tolist()):
                sums[lang] = sums.get(lang, 0) + n
            if len(sums) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.int64())], ["lang", "n"])
                sums = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "n"])

    return rows.mapInArrow(total, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, keep: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, width, f) of all frequent phrases of 1 to 5 words, (lang, n) of all words).

    ``keep`` shortens the fingerprints, which only tests of collisions do.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = staged(rows, "rows")
    # each level reads the bits of all before it; the last table has every level's
    bits, sent = np.zeros(FILTER_BITS // 8, np.uint8), None
    levels = [([1], 0), ([2], 1), (list(range(3, LONGEST + 1)), 2)]
    for widths, part in levels:
        bits |= bit_table(busy_buckets(rows, widths, least, keep, sent, part))
        if sent is not None:
            sent.unpersist()
        sent = spark.sparkContext.broadcast(bits)
    levels = [(widths, sent, part) for widths, part in levels]
    found = frequent(counted(rows, levels, keep), least)
    counts = verified(rows, found, levels, keep, least)
    sent.unpersist()
    return counts, staged(word_totals(rows), "totals")


def collocations(docs: DataFrame, least: int = MIN_COUNT, first: int = FIRST, keep: int = 64) -> DataFrame:
    """Per language (null: ``und``) the ``first`` best phrases of ``docs`` (text, lang).

    Phrases have 2 to 5 words and ``least`` occurrences or more. Each way to cut one in two
    has the score floor(1000 * a * n / (l * r)); the worst one counts, at the earliest
    place. A phrase inside a longer one that is as frequent is left out. Order: score, then a,
    both falling, then the phrase's bytes.
    """
    counts, totals = phrase_counts(docs, least, keep)
    words = F.split("phrase", " ")
    candidates = counts.where("width >= 2").withColumn("words", words)
    # f never grows with a phrase, so a longer phrase that is as frequent has neighbours one word shorter that are too
    outer = candidates.where("width >= 3").select("lang", "f", F.explode(F.array(_joined(1, F.col("width") - 1), _joined(2, F.col("width") - 1))).alias("phrase")).distinct()
    left = candidates.join(outer, ["lang", "f", "phrase"], "left_anti")
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"), "width", "words")
    cuts = cuts.withColumns({"head": _joined(1, F.col("k")), "tail": _joined(F.col("k") + 1, F.col("width") - F.col("k"))}).drop("words")
    parts = small(counts.select("lang", "phrase", "f"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(small(totals), "lang")
    score = F.expr("(1000 * (cast(a as decimal(19,0)) * cast(n as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score.cast("bigint"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    return first_rows(flat, "lang", order, first, F.col("phrase")).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _joined(first, size):
    """Some of the words, as text."""
    return F.array_join(F.slice("words", first, size), " ")
