"""Shared parts: stored tables, size-checked joins, and words as numpy arrays.

Task functions receive Arrow batches and cut them into chunks of about ``CHUNK`` text
bytes, so that their arrays stay small whatever the batch settings of the session are.
"""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.session import checkpoint_dir

CHUNK = 1_000_000
# a table may be sent to every task up to this many narrow rows; beyond it a shuffle join runs
SMALL_ROWS = 1 << 20

U64 = np.uint64


# ---------------------------------------------------------------- tables


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Cuts the lineage: the stored copy outlives lost executors and is not recomputed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in the stored table ``ids`` (null keys stay).

    The ids are counted first: up to ``SMALL_ROWS`` of them are sent to every task and
    texts stay where they are; more of them meet the rows in a shuffle join.
    """
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(small(ids), key, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in the stored table ``ids``; see ``without_ids``."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return docs.join(small(ids), key, "left_semi")


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if a count shows at most ``SMALL_ROWS`` narrow rows."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not use."""
    used = {column.lower() for column in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- batches


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` text bytes, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(sizes):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    # a worker waits for its next task with the memory of this one, which others need
    give_back()


def give_back() -> None:
    """Return to the system what this worker has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: none) and the bounds of its rows in them."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    raw = filled.buffers()[2] if len(filled) else None
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


# ---------------------------------------------------------------- words

_BYTES = np.arange(256)
# code points outside space and U+0009 to U+000D
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
# ASCII letters and digits, and every byte of other code points
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_CODES_LOWER = _CODES[_LOWER]
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task (functions travel by value, so their
    module's own variables start anew in every task)."""
    return sys.modules.setdefault("tarnmill_worker_cache", types.ModuleType("tarnmill_worker_cache")).__dict__


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; those that a chunk needs are kept."""
    cache = worker_cache()
    known = cache.get(("powers", base))
    if known is None or len(known) <= n:
        factors = np.full(max(n, CHUNK) + 1, U64(base))
        factors[0] = 1
        known = np.cumprod(factors, dtype=np.uint64)
        if n <= CHUNK:
            cache[("powers", base)] = known
    return known[: n + 1]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finisher of the splitmix generator)."""
    z = values + U64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def word_bounds(data: np.ndarray, bounds: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of member bytes, and the row that holds it."""
    # a worker that has moved on to words needs no tokens; they are its largest part
    worker_cache().pop("encoder", None)
    inside = member[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    cuts = bounds[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    ends = bounds[1:][bounds[1:] > 0] - 1
    after[ends] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(bounds, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from one running sum over all bytes."""
    n = len(data)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((_CODES_LOWER if lower else _CODES)[data] * powers(_P, n)[:n], out=running[1:])
    value = (running[stops] - running[starts]) * powers(_P_INVERSE, n)[starts]
    return mixed(value ^ (stops - starts).astype(np.uint64))


_Q = 0xD1342543DE82EF95
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every window of ``width`` neighbouring values, by its first place."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_Q, n)[:n], out=running[1:])
    return mixed((running[width:] - running[:-width]) * powers(_Q_INVERSE, n)[: n - width + 1])
