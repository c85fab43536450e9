"""Line deduplication with two Bloom filters.

1. Every task marks the key hashes of its documents' lines in two filters: *once* and, at
   the second document, *twice*. Filters travel as compressed slices, are merged per slice
   (a bit set by two tasks goes to *twice*), and only *twice* is kept.
2. A second scan passes the keys that *twice* may hold; only those suspects are shuffled,
   already counted per task, and their exact number of documents is taken.
3. Keys in ``min_docs`` documents or more lose their lines. Confirmed keys go to every
   task if a count shows at most ``SMALL_ROWS``, else each document meets its own keys in
   a shuffle join.

A filter has ``FILTER_BITS`` bits whatever the input, so what is broadcast is bounded. On
inputs with far more lines than bits, more lines become suspects and the exact count
shuffles more 16-byte keys; the result is exact at any fill, as filters miss nothing.

A key is the line without space and U+0009 to U+000D at both ends, A-Z lower-cased, and is
known by a 128-bit BLAKE2b digest. Lines with an empty key always stay. Null and empty
texts are one empty line. Every row counts as one document, so repeated rows count each; rows
with a null id take part like others. Other columns are untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import SMALL_ROWS, chunks, fresh, staged

MIN_DOCS = 10
FILTER_BITS = 1 << 27
SLICES = 256
HASHES = 2
BLANK = b" \t\n\x0b\x0c\r"
SLICE_BITS = FILTER_BITS // SLICES


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def digests_of(text: str | None) -> list[bytes]:
    """The digest of every line's key, empty keys as no bytes."""
    return [digest(k) if (k := key_of(line)) else b"" for line in (text or "").encode().split(b"\n")]


def places(digests: list[bytes]) -> np.ndarray:
    """HASHES filter bits per digest, all in one slice so that slices can be merged apart."""
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    first = halves[:, 0] % np.uint64(FILTER_BITS)
    base = first - first % np.uint64(SLICE_BITS)
    return np.stack([first] + [base + (halves[:, 1] >> np.uint64(24 * k)) % np.uint64(SLICE_BITS) for k in range(HASHES - 1)], axis=1).astype(np.int64)


# ---------------------------------------------------------------- the filters


def merge(once: np.ndarray, twice: np.ndarray, more_once: np.ndarray, more_twice: np.ndarray) -> None:
    """Add another pair of filters to ``once`` and ``twice`` in place."""
    twice |= more_twice
    twice |= once & more_once
    once |= more_once


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of a task's two filters."""
    once, twice = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8)
    used = np.zeros(SLICES, bool)
    for part in chunks(batches):
        # the lines of one document are marked once
        distinct = [d for text in part.column("text").to_pylist() for d in set(digests_of(text)) if d]
        if not distinct:
            continue
        at = places(distinct)
        used[np.unique(at[:, 0] // SLICE_BITS)] = True
        unique, counts = np.unique(np.frombuffer(b"".join(distinct), dtype="V16"), return_counts=True)
        for keys, again in ((unique[counts == 1], False), (unique[counts > 1], True)):
            if len(keys) == 0:
                continue
            bits = places([keys.tobytes()])
            byte, mask = bits >> 3, (1 << (bits & 7)).astype(np.uint8)
            seen = ((once[byte] & mask) != 0).all(axis=1) | again
            for k in range(HASHES):
                np.bitwise_or.at(twice, byte[seen, k], mask[seen, k])
                np.bitwise_or.at(once, byte[:, k], mask[:, k])
    width = SLICE_BITS // 8
    for number in np.flatnonzero(used):
        cut = slice(number * width, (number + 1) * width)
        columns = [pa.array([int(number)], pa.int32())] + [pa.array([zlib.compress(f[cut].tobytes(), 1)], pa.binary()) for f in (once, twice)]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "once", "twice"])


def merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One *twice* filter per slice from rows ordered by slice; holds one slice at a time."""
    current, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 6)], pa.binary())], ["slice", "twice"])

    for batch in batches:
        for number, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            more = [np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b)]
            if number != current:
                if current is not None:
                    yield done()
                current, once, twice = number, more[0].copy(), more[1].copy()
            else:
                merge(once, twice, *more)
    if current is not None:
        yield done()


def twice_filter(texts: DataFrame) -> bytes:
    """The merged *twice* filter, compressed; its plain size is FILTER_BITS / 8 bytes."""
    marked = texts.mapInArrow(mark, "slice int, once binary, twice binary")
    merged = marked.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge_slices, "slice int, twice binary")
    whole = np.zeros((SLICES, SLICE_BITS // 8), np.uint8)
    for row in merged.toLocalIterator():
        whole[row["slice"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


# ---------------------------------------------------------------- the operator


def suspects(texts: DataFrame) -> DataFrame:
    """(key, docs) of the keys that the filter may hold, summed per chunk of rows."""
    packed = texts.sparkSession.sparkContext.broadcast(twice_filter(texts))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for part in chunks(batches):
            distinct = [d for text in part.column("text").to_pylist() for d in set(digests_of(text)) if d]
            if not distinct:
                continue
            bits = places(distinct)
            hit = ((twice[bits >> 3] & (1 << (bits & 7)).astype(np.uint8)) != 0).all(axis=1)
            keys, counts = np.unique(np.frombuffer(b"".join(distinct), dtype="V16")[hit], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(counts, pa.int64())], ["key", "docs"])

    return texts.mapInArrow(find, "key binary, docs bigint")


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Digests of the keys that ``min_docs`` documents hold, with their number (stored)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = suspects(texts).groupBy("key").agg(F.sum("docs").alias("docs"))
    return staged(counted.where(F.col("docs") >= min_docs), "line-keys")


def rewritten(text: str | None, drop: Callable[[bytes], bool]) -> tuple[int, int, bytes]:
    """(lines, dropped lines, the other lines joined)."""
    lines = (text or "").encode().split(b"\n")
    kept = [line for line in lines if not ((k := key_of(line)) and drop(digest(k)))]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``text`` rewritten, and the counts of lines and dropped lines.

    The counts are named by ``lines`` and ``dropped``, which must not be columns of ``docs``.
    """
    keys = repeated_keys(docs, min_docs)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    names = docs.columns
    if keys.count() <= SMALL_ROWS:
        # 16 bytes each: at most 16 MB
        chosen = docs.sparkSession.sparkContext.broadcast(b"".join(bytes(r["key"]) for r in keys.select("key").toLocalIterator()))

        def listed():
            packed = chosen.value
            known = frozenset(packed[i : i + 16] for i in range(0, len(packed), 16))
            return lambda part: repeat(known.__contains__)

        return docs.mapInArrow(_rewriter(listed, names, lines, dropped), schema)

    # too many keys for every task: documents get their own keys, texts are shuffled once
    row, own_keys = fresh(docs, "row"), fresh(docs, "keys")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    own = rows.select(F.col(row).alias("row"), "text").mapInArrow(_keys_by_row, "row bigint, key binary")
    hits = own.join(keys.select("key"), "key").groupBy(F.col("row").alias(row)).agg(F.collect_set("key").alias(own_keys))
    met = rows.join(hits, row, "left")

    def by_row():
        return lambda part: (frozenset(some or ()).__contains__ for some in part.column(own_keys).to_pylist())

    return met.mapInArrow(_rewriter(by_row, names, lines, dropped), schema)


def _keys_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        pairs = [(row, d) for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()) for d in set(digests_of(text)) if d]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], ["row", "key"])


def _rewriter(prepare: Callable, names: list[str], lines: str, dropped: str):
    """A task function that rewrites texts; ``prepare()`` gives a function from a chunk to
    the drop tests of its rows."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = prepare()
        for part in chunks(batches):
            done = [rewritten(text, drop) for text, drop in zip(part.column("text").to_pylist(), tests(part))]
            columns = [pa.array([d[2] for d in done], pa.binary()).cast(pa.string()) if name == "text" else part.column(name) for name in names]
            columns += [pa.array([d[k] for d in done], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*names, lines, dropped])

    return rewrite


def first_documents(docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """(key, doc_id) of the first document, by id, that holds each repeated key.

    For callers that keep the first occurrence of a line rather than none.
    """
    keys = repeated_keys(docs, min_docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("row"), F.col("text").cast("string").alias("text"))
    own = texts.mapInArrow(_keys_by_row, "row bigint, key binary")
    return own.join(keys.select("key"), "key").groupBy("key").agg(F.min("row").alias("doc_id"))
