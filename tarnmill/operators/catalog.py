"""Repository catalog and resumption of finished work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.prefix import with_position

# Fixed value: upper star bound of a crawl that starts from nothing.
FIRST_UPPER_BOUND = 500000
# rows that one task may merge
TOP_ROWS = 10_000


def upsert_repos(items: DataFrame) -> DataFrame:
    """``url, stars`` with the stars seen last, by ``seq``."""
    return items.groupBy("url").agg(F.max_by("stars", "seq").alias("stars"))


def merge_catalogs(old: DataFrame, new: DataFrame) -> DataFrame:
    """An existing catalog (``url, stars``) extended by a later crawl (``url, stars, seq``);
    the later crawl wins."""
    earlier = old.select("url", "stars", F.struct(F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("at")).alias("seq"))
    later = new.select("url", "stars", F.struct(F.lit(1).alias("round"), F.col("seq").cast("bigint").alias("at")).alias("seq"))
    return upsert_repos(earlier.unionByName(later))


def resume_bound(catalog: DataFrame, max_stars: int | None = None) -> DataFrame:
    """Upper star bound for the next crawl, one row: the given one, or one more than the
    fewest stars in the catalog, or the starting bound."""
    fewest = F.coalesce(F.min("stars") + 1, F.lit(FIRST_UPPER_BOUND))
    return catalog.agg((F.lit(max_stars) if max_stars is not None else fewest).cast("bigint").alias("max_stars"))


def repos_in_range(catalog: DataFrame, low: int, high: int) -> DataFrame:
    """Repositories with ``low`` to ``high`` stars, most stars first."""
    return catalog.where(F.col("stars").between(low, high)).orderBy(F.desc("stars"), "url")


def pending(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not among the finished ones."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def first_rows(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in order of the unique ``keys``; 0 or less keeps all.

    Up to ``TOP_ROWS`` rows every task keeps its own first ones and one task merges them; more
    rows are numbered where they lie.
    """
    if limit <= 0:
        return df
    if limit <= TOP_ROWS:
        return df.orderBy(*keys).limit(limit)
    return with_position(df, keys, "__position").where(F.col("__position") < limit).drop("__position")
