"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 64
# least number of tasks that share the rows of a hot key
HOT_SPREAD = 32


def hot_keys(counts: DataFrame, key: str, count: str) -> list:
    """Keys that hold more than 1/64 of all rows; there are at most 64 of them."""
    total = counts.agg(F.sum(count).alias("n")).scalar()
    rows = counts.where(F.col(count) * MAX_HOT_KEYS > total).select(key).collect()
    return [row[0] for row in rows]


def join_on_skewed_key(
    big: DataFrame, small: DataFrame, key: str, spread_by: str, hot: list, how: str = "inner"
) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``key``) with the rows of hot keys spread.

    Rows of a hot key get one of as many salts from ``spread_by`` as a shuffle has
    partitions (32 at least), and only the hot rows of the small side are repeated, so at
    most 64 rows for each salt are added. Whether the small side is broadcast is left to
    its measured size.
    """
    if not hot:
        return big.join(small, key, how)
    spread = max(HOT_SPREAD, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(spread))).otherwise(F.lit(0))
    salted = big.withColumn("__salt", salt.cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    repeated = small.withColumn("__salt", F.explode(salts))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
