"""Distributed running totals.

A window ordered over a whole table would put all rows into one task. Here the rows are
range-partitioned by their key, every partition sums its own rows in one pass, and the
sums of the partitions ahead of it are added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.session import stored


def _sums_within(batches: Iterator[pa.RecordBatch], values: list[str]) -> Iterator[pa.RecordBatch]:
    """Each row's partition and the sums of ``values`` over the rows before it there."""
    part, so_far = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
    for batch in batches:
        columns, names = [pa.array(np.full(batch.num_rows, part, np.int32))], ["__part"]
        for name, column in zip(batch.schema.names, batch.columns):
            columns.append(column)
            names.append(name)
        for name in values:
            own = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)
            until = np.cumsum(own) + so_far[name]
            columns.append(pa.array(until - own))
            names.append(f"__before{name}")
            so_far[name] = int(until[-1]) if len(until) else so_far[name]
        yield pa.RecordBatch.from_arrays(columns, names)


def running_total(df: DataFrame, keys: list[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add, for each entry ``name: value``, the sum of ``value`` over all rows with a
    smaller key.

    ``keys`` must be unique and not NULL. ``df`` is read for the range bounds and for the
    rows, so costly input is best stored first. The ranged rows are stored once: a partition's
    number and its rows stay as they are for the sums that follow.
    """
    values = {f"__value_{name}": value.cast("bigint") for name, value in totals.items()}
    ranged = df.withColumns(values).repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = [T.StructField("__part", T.IntegerType()), *ranged.schema.fields, *[T.StructField(f"__before{name}", T.LongType()) for name in values]]
    names = list(values)
    placed = stored(ranged.mapInArrow(lambda batches: _sums_within(batches, names), T.StructType(fields)), "ranged")
    # one row for each partition, in partition order
    sums = sorted(tuple(row) for row in placed.groupBy("__part").agg(*[F.sum(name) for name in names]).collect())
    ahead, so_far = [], [0] * len(names)
    for part, *own in sums:
        ahead.append((part, *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, own)]
    schema = ", ".join(["__part int", *[f"__ahead{name} bigint" for name in names]])
    # as many rows as partitions
    met = placed.join(F.broadcast(df.sparkSession.createDataFrame(ahead, schema)), "__part")
    added = {name: F.col(f"__ahead__value_{name}") + F.col(f"__before__value_{name}") for name in totals}
    return met.withColumns(added).select(*[c for c in df.columns if c not in totals], *totals)


def with_position(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Zero-based position of each row in key order."""
    return running_total(df, keys, {name: F.lit(1)})


def take_fraction(df: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """The first ``floor(count * fraction)`` rows in key order."""
    count = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("n")).scalar()
    return with_position(df, keys, "__position").where(F.col("__position") < count).drop("__position")
