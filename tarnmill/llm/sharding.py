"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a key (hash of the text, then id, then a row number), so equal texts lie together.
The boundary of shard i is the first row with at least i / shards of all bytes before it. It is
found by probing: every round counts the exact bytes below candidate keys, in all
partitions at once, and narrows each boundary's interval until one key is left. Then all rows
go to their shard in one range exchange and are numbered there.

A group of equal texts stays whole, in the shard where its first row falls, if it holds at most
``WHOLE_PERCENT`` of a shard's bytes. A larger group is cut by the same search over its ids, so
no group, however hot, breaks the balance. A shard misses its share by less than the larger of
one row and one such group at either end.

Null and empty texts are the same group. Rows with a null id come first within their group.
Repeated rows are told apart by a row number fixed when the manifest is stored. An
empty table gives no rows; shards may be empty if there are few rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import staged

SHARDS = 24
WHOLE_PERCENT = 1
OVERHEAD = 8
# probes per boundary and round
PROBES = 255
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def manifest(docs: DataFrame) -> DataFrame:
    """Stored (k1, k2, k3, doc_id, size, text_crc32) of all rows; k2 orders ids, nulls first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("bigint")
    # md5 spreads keys evenly whatever the texts are
    k1 = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    rows = docs.select(
        k1.alias("k1"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("k2"), F.monotonically_increasing_id().alias("k3"), "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32")
    )
    return staged(rows, "shard-manifest")


def bytes_below(rows: DataFrame, column: str, edges: list[int]) -> list[int]:
    """Exact bytes of the rows whose ``column`` lies below each edge (ascending)."""
    limits = np.array(edges, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(limits) + 1, np.int64)
        for batch in batches:
            values, sizes = (batch.column(k).to_numpy() for k in (0, 1))
            np.add.at(sums, np.searchsorted(limits, values, side="right"), sizes)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], ["bin", "bytes"])

    totals = rows.select(column, "size").mapInArrow(count, "bin bigint, bytes bigint").groupBy("bin").agg(F.sum("bytes").alias("bytes"))
    bins = np.zeros(len(limits) + 1, object)
    for r in totals.collect():
        bins[r["bin"]] = r["bytes"]
    return np.cumsum(bins)[:-1].tolist()


def narrowed(rows: DataFrame, column: str, low: int, high: int, base: int, wants: list[int], shards: int) -> dict[int, tuple[int, int, int]]:
    """For every want: (key, bytes before the key, bytes before the next key) of the last key
    with less than the wanted bytes before it. ``base`` bytes precede all rows."""
    below = {v: n for v, n in zip((low, high), [base, None])}
    spans = {want: (low, high) for want in wants}
    while any(b - a > 1 for a, b in spans.values()):
        probes = set()
        for a, b in set(spans.values()):
            step = max(1, -((a - b) // (PROBES + 1)))
            probes.update(range(a + step, b, step))
        if below[high] is None:
            probes.add(high)
        probes = sorted(p for p in probes if below.get(p) is None)
        if probes:
            for probe, n in zip(probes, bytes_below(rows, column, probes)):
                below[probe] = base + int(n)
        known = sorted(v for v in below if below[v] is not None)
        counts = [below[v] for v in known]
        for want, (a, b) in spans.items():
            # the last known key with fewer bytes before it than wanted, and the key after it
            place = int(np.searchsorted(np.array([c * shards for c in counts], object), want, side="left"))
            place = max(1, min(place, len(known) - 1))
            spans[want] = (known[place - 1], known[place])
    if below[high] is None:
        below[high] = base + int(bytes_below(rows, column, [high])[0])
    return {want: (a, below[a], below[b]) for want, (a, b) in spans.items()}


def boundaries(rows: DataFrame, total: int, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """First key (k1, k2, k3) of the shards 1, 2, ..."""
    wants = [i * total for i in range(1, shards)]
    found: dict[int, tuple[int, int, int]] = {}
    hot: dict[tuple[int, int], list[int]] = {}
    for want, (key, before, after) in narrowed(rows, "k1", -1, 1 << 60, 0, wants, shards).items():
        if 100 * shards * (after - before) <= WHOLE_PERCENT * total or after * shards < want:
            found[want] = (key + 1, LEAST, LEAST)
        else:
            hot.setdefault((key, before), []).append(want)
    for (key, before), own in hot.items():
        group = rows.where(F.col("k1") == key)
        repeated: dict[tuple[int, int], list[int]] = {}
        for want, (k2, before2, after2) in narrowed(group, "k2", *id_range(group, "k2"), before, own, shards).items():
            if 100 * shards * (after2 - before2) > WHOLE_PERCENT * total:
                repeated.setdefault((k2, before2), []).append(want)
            else:
                found[want] = (key, k2 + 1, LEAST)
        for (k2, before2), inner in repeated.items():
            same = group.where(F.col("k2") == k2)
            for want, (k3, _, _) in narrowed(same, "k3", *id_range(same, "k3"), before2, inner, shards).items():
                found[want] = (key, k2, k3 + 1)
    return [found[want] for want in wants]


def id_range(rows: DataFrame, column: str) -> tuple[int, int]:
    least, most = rows.agg(F.min(column), F.max(column)).first()
    return max(LEAST, least - 1), min(MOST, most + 1)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard (always null)."""
    rows = manifest(docs)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    firsts = boundaries(rows, total, shards) if total else []
    number = F.lit(0)
    for k1, k2, k3 in firsts:
        tie = (F.col("k2") > k2) | ((F.col("k2") == k2) & (F.col("k3") >= F.lit(k3)))
        number = number + F.when((F.col("k1") > k1) | ((F.col("k1") == k1) & tie), 1).otherwise(0)
    placed = rows.withColumn("shard", number.cast("int"))
    # the exchange: ranges of the same key, so every partition holds neighbours
    ordered = placed.repartitionByRange("shard", "k1", "k2", "k3").sortWithinPartitions("shard", "k1", "k2", "k3")

    def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            shard_numbers = batch.column("shard").to_numpy()
            places = np.arange(len(shard_numbers), dtype=np.int64)
            begins = np.flatnonzero(np.append(True, shard_numbers[1:] != shard_numbers[:-1]))
            for a, b in zip(begins, [*begins[1:], len(shard_numbers)]):
                if shard_numbers[a] != current:
                    current, n = shard_numbers[a], 0
                places[a:b] = n + np.arange(b - a)
                n += b - a
            columns = [pa.array([part] * len(places), pa.int32()), batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("shard"), pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "size", "text_crc32", "shard", "place"])

    kind = dict(docs.dtypes)["doc_id"]
    slim = ordered.select("doc_id", "size", "text_crc32", "shard")
    done = staged(slim.mapInArrow(number_rows, f"part int, doc_id {kind}, size bigint, text_crc32 bigint, shard int, place bigint"), "shard-rows")
    # rows ahead of each (shard, part): one small number per partition and shard
    counts = sorted((r["shard"], r["part"], r["count"]) for r in done.groupBy("shard", "part").count().collect())
    ahead, last, n = [], None, 0
    for shard_number, part, count in counts:
        n = n if shard_number == last else 0
        ahead.append((shard_number, part, n))
        last, n = shard_number, n + count
    offsets = docs.sparkSession.createDataFrame(ahead, "shard int, part int, ahead bigint")
    # at most one row for each partition and shard border
    met = done.join(F.broadcast(offsets), ["shard", "part"])
    slot = (F.col("place") + F.col("ahead")).alias("slot")
    return met.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
