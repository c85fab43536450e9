"""Whole repositories assigned to splits by line budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.prefix import running_total
from tarnmill.operators.skew import hot_keys, join_on_skewed_key
from tarnmill.session import cut_lineage

# Default shares, seed and split names in fill order.
EXCLUDE_SHARE = 0.2
TEST_SHARE = 0.2
TRAIN_SHARE = 0.8
SEED = "RANDOMSEED"
SPLITS = ["excludes", "test", "train", "validation"]


def repo_totals(files: DataFrame) -> DataFrame:
    """Files, lines and comments per repository."""
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("num_lines").alias("num_lines"),
        F.sum("num_comments").alias("num_comments"),
    )


def corpus_totals(unique: DataFrame) -> DataFrame:
    """Files, lines, comments and dropped duplicates of the whole corpus, one row."""
    return unique.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("num_lines").alias("total_lines"),
        F.sum("num_comments").alias("total_comments"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
    )


def line_budgets(
    totals: DataFrame,
    exclude: float = EXCLUDE_SHARE,
    test: float = TEST_SHARE,
    train: float = TRAIN_SHARE,
) -> DataFrame:
    """Budgets in lines, each a share of what the earlier ones leave."""
    lines = totals.select(F.col("total_lines").alias("lines"))
    step1 = lines.withColumn("exclude_lines", F.floor(F.lit(exclude) * F.col("lines")))
    step2 = step1.withColumn("test_lines", F.floor(F.lit(test) * (F.col("lines") - F.col("exclude_lines"))))
    return step2.select(
        "exclude_lines",
        "test_lines",
        F.floor(F.lit(train) * (F.col("lines") - F.col("exclude_lines") - F.col("test_lines"))).alias("train_lines"),
    )


def shuffle_key(item: Column, seed: str = SEED) -> Column:
    """Seeded order that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(seed), item.cast("string")))


def assign_repos(repos: DataFrame, budgets: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``split`` to every repository.

    Repositories are taken in shuffled order while the lines taken so far do not
    exceed the budget, so a split can overshoot by one repository and an empty budget
    still takes one. With ``before`` as the lines of all earlier repositories, that
    is a comparison against the budget plus the lines of the finished splits. The
    repository table is kept once; only the three budgets and two sums reach the driver.
    """
    keyed = repos.withColumn("order_key", shuffle_key(F.col("repo"), seed))
    ordered = cut_lineage(
        running_total(keyed, ["order_key", "repo"], {"before": F.col("num_lines")})
    )
    split = F.when(F.lit(False), F.lit(""))
    taken = 0
    for name, budget in zip(SPLITS, budgets.select("exclude_lines", "test_lines", "train_lines").first()):
        within = F.col("before") <= taken + (budget or 0)
        split = split.when(within, F.lit(name))
        if name != SPLITS[2]:
            taken = ordered.where(within).agg(F.coalesce(F.sum("num_lines"), F.lit(0))).first()[0]
    return ordered.withColumn("split", split.otherwise(F.lit(SPLITS[3]))).drop("before")


def split_files(files: DataFrame, assigned: DataFrame, key: str = "file_id") -> DataFrame:
    """File list per split: ``split, repo, file_id``.

    The repository table carries the file counts, so hot repositories are known
    before the join and their files are spread.
    """
    hot = hot_keys(assigned, "repo", "files")
    wanted = files.select("repo", key)
    return join_on_skewed_key(wanted, assigned.select("repo", "split"), "repo", key, hot).select("split", "repo", key)


def split_statistics(assigned: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Files and lines per split and in total; duplicates only on the total row.

    Every split has a row, also one without repositories.
    """
    per_split = [
        F.sum(F.when(F.col("split") == name, F.col(value)).otherwise(0)).alias(f"{name}_{value}")
        for name in SPLITS
        for value in ("files", "num_lines")
    ]
    row = assigned.agg(
        *per_split, F.sum("files").alias("total_files"), F.sum("num_lines").alias("total_num_lines")
    )
    dropped = duplicates.scalar()
    stats = [
        F.struct(
            F.lit(name.capitalize()).alias("split"),
            F.coalesce(F.col(f"{name}_files"), F.lit(0)).alias("files"),
            F.coalesce(F.col(f"{name}_num_lines"), F.lit(0)).alias("lines"),
            (dropped if name == "total" else F.lit(None)).cast("bigint").alias("duplicates"),
        )
        for name in [*SPLITS, "total"]
    ]
    return row.select(F.inline(F.array(*stats)))
