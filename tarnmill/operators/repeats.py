"""Maximal repeated substrings of weighted words by a distributed suffix array.

Every suffix of every distinct word is keyed by its first ``FIRST_KEY`` characters; equal keys
are added up before they are shuffled, and a range partitioning sorts them, so that each
partition is a stretch of the suffix array. Common-prefix lengths of neighbours and a stack give the
nodes of the suffix tree with their counts. A node at the edge of a stretch may go on in the next one:
prefixes of the first and last keys travel as partial sums and are added up afterwards.

Keys that are cut off and repeated are sorted again with keys of twice the length (the doubling step),
and give the nodes beyond the old length; only suffixes that share that many characters take
part. So a piece has no length limit, and the first step moves at most ``FIRST_KEY`` characters for
each letter. Beyond it, a suffix moves as many characters as it shares with another one, so a word
made of one repeated stretch costs the square of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.session import stored

FIRST_KEY = 32
# suffixes that a row holds at most before they are exploded
SUFFIXES_PER_ROW = 4096


def common_prefixes(keys: list[str]) -> np.ndarray:
    """Length of the common prefix of each string and the one before it; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) < 2:
        return out
    points = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.cumsum(sizes) - sizes
    open_pairs, depth = np.arange(1, len(keys)), 0
    while len(open_pairs):
        open_pairs = open_pairs[(sizes[open_pairs] > depth) & (sizes[open_pairs - 1] > depth)]
        open_pairs = open_pairs[points[starts[open_pairs] + depth] == points[starts[open_pairs - 1] + depth]]
        depth += 1
        out[open_pairs] = depth
    return out


def inner_nodes(keys: list[str], shared: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first key, last key, depth) of the suffix tree's nodes over sorted distinct keys.

    A node is a prefix at which keys part, or a key that is a whole suffix. ``shared`` has the
    common prefix of each key and the one before it.
    """
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    # a whole suffix that begins the next key is a place where keys part
    alone = np.flatnonzero(whole & (np.append(shared[1:], 0) < sizes))
    firsts, lasts, depths = [alone], [alone], [sizes[alone]]
    at = np.flatnonzero(shared > 0)
    for depth in np.unique(shared[at]).tolist():
        at = at[shared[at] >= depth]
        # keys with a common prefix of this depth are neighbours; they part here if one shares no more
        heads = np.flatnonzero(np.append(True, np.diff(at) > 1))
        ends = np.append(heads[1:], len(at)) - 1
        parted = np.logical_or.reduceat(shared[at] == depth, heads)
        firsts.append(at[heads[parted]] - 1)
        lasts.append(at[ends[parted]])
        depths.append(np.full(int(parted.sum()), depth))
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(depths)


def nodes(keys: list[str], counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, depth, count, at the edge) of the suffix tree over sorted distinct keys; the node is the
    key's prefix of that depth.

    Edge rows are the prefixes of the first and the last key, nodes or not, with what these keys count.
    """
    shared = common_prefixes(keys)
    before = np.append(0, np.cumsum(counts))
    first, last, depth = inner_nodes(keys, shared, whole)
    # a node at the edge holds the first or the last key
    inside = (first > 0) & (last < len(keys) - 1)
    first, last, depth = first[inside], last[inside], depth[inside]
    # edges: the keys that begin with a prefix of the first (last) key are the first (last) ones
    head = np.minimum.accumulate(np.append(len(keys[0]), shared[1:]))
    tail = np.minimum.accumulate(np.append(len(keys[-1]), shared[1:][::-1]))
    opening = np.arange(1, len(keys[0]) + 1)
    # prefixes of the last key that are none of the first one
    closing = np.arange(int(tail[-1]) + 1 if len(keys) > 1 else len(keys[0]) + 1, len(keys[-1]) + 1)
    # both fall along the keys
    opened = np.searchsorted(-head, -opening, side="right")
    closed = len(keys) - np.searchsorted(-tail, -closing, side="right")
    key = np.concatenate([first, np.zeros(len(opening), np.int64), np.full(len(closing), len(keys) - 1)])
    count = np.concatenate([before[last + 1] - before[first], before[opened], before[-1] - before[closed]])
    return key, np.concatenate([depth, opening, closing]), count, np.arange(len(key)) >= len(first)


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [batch for batch in batches if batch.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    keys = table.column("key").to_pylist()
    at, depth, count, edge = nodes(keys, table.column("n").to_numpy(), table.column("whole").to_numpy())
    for start in range(0, len(at), 100_000):
        stop = start + 100_000
        texts = [keys[k][:d] for k, d in zip(at[start:stop].tolist(), depth[start:stop].tolist())]
        arrays = [pa.array(texts, pa.string()), pa.array(count[start:stop], pa.int64()), pa.array(edge[start:stop], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["piece", "n", "edge"])


def _suffixes(words: DataFrame, least: int) -> DataFrame:
    """``word, n, at`` (from 1) of all suffixes with ``least`` characters or more; long words
    are dealt in slices."""
    starts = F.sequence(F.lit(1), F.length("word") - (least - 1), F.lit(SUFFIXES_PER_ROW))
    rows = words.where(F.length("word") >= least).select("word", "n", F.explode(starts).alias("from"))
    ends = F.least(F.col("from") + (SUFFIXES_PER_ROW - 1), F.length("word") - (least - 1))
    return rows.select("word", "n", F.explode(F.sequence(F.col("from"), ends)).alias("at"))


def _nodes_between(keyed: DataFrame, size: int, shortest: int) -> DataFrame:
    """Nodes of ``shortest`` to ``size - 1`` characters, from suffix keys cut at ``size``."""
    ordered = keyed.repartitionByRange("key").sortWithinPartitions("key")
    placed = stored(ordered.mapInArrow(_stretch, "piece string, n bigint, edge boolean"), "nodes")
    edges = placed.where("edge").groupBy("piece").agg(F.sum("n").alias("n"))
    # whole suffixes at an edge are nodes whatever follows
    ends = keyed.where("whole").select(F.col("key").alias("piece"))
    edges = stored(edges, "edges")
    followed = edges.select(F.expr("left(piece, length(piece) - 1)").alias("piece"), "n").distinct()
    parted = edges.join(followed, ["piece", "n"], "left_anti").union(edges.join(ends, "piece", "left_semi").select("piece", "n")).distinct()
    found = placed.where("not edge").select("piece", "n").union(parted)
    return found.where(F.length("piece").between(shortest, size - 1) & (F.col("n") > 1))


def right_maximal(words: DataFrame, shortest: int = 2) -> DataFrame:
    """``piece, n``: substrings of two occurrences or more, each word counted ``n`` times, that
    no single next character always follows."""
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    size, alive, result = FIRST_KEY, _suffixes(words, 1), None
    low = shortest
    while True:
        key: Column = F.substring("word", F.col("at"), F.lit(size))
        whole = F.length("word") - F.col("at") + 1 <= size
        keyed = stored(alive.select(key.alias("key"), "n", whole.alias("whole")).groupBy("key").agg(F.sum("n").alias("n"), F.bool_or("whole").alias("whole")), "keys")
        found = _nodes_between(keyed, size, low)
        result = found if result is None else result.union(found)
        # keys of full length may go on to be equal
        longer = stored(keyed.where((F.length("key") == size) & (F.col("n") > 1)).select("key"), "open")
        if longer.isEmpty():
            return result
        reached = _suffixes(words, size).withColumn("key", F.substring("word", F.col("at"), F.lit(size)))
        alive = stored(reached.join(longer, "key", "left_semi").select("word", "n", "at"), "alive")
        low, size = max(size, shortest), 2 * size


def maximal_repeats(words: DataFrame, shortest: int = 2) -> DataFrame:
    """``piece, n``: repeated substrings that grow by no character, on neither side, without
    losing an occurrence."""
    right = stored(right_maximal(words, shortest), "right")
    # the tail of a right-maximal piece with as many occurrences always has that first character
    tails = right.select(F.expr("substring(piece, 2)").alias("piece"), "n").distinct()
    return right.join(tails, ["piece", "n"], "left_anti")
