"""The first rows of every group, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import fresh

SALTS = 64


def first_rows(df: DataFrame, group: str, order: list[Column], n: int, spread: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in the given order, numbered from 1 in ``rank``.

    A group is first cut to ``n`` rows in each of ``SALTS`` parts by the hash of ``spread``,
    so that the sort of one group is shared by many tasks.
    """
    salt, place = fresh(df, "salt"), fresh(df, "place")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    some = salted.withColumn(place, F.row_number().over(Window.partitionBy(group, salt).orderBy(*order))).where(F.col(place) <= n).drop(place, salt)
    return some.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)
