"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller stores
as Parquet and hands to the next stage. All stages but the last return the columns of ``docs``
and keep the rows they were given, apart from those they reject. The stages that compare
documents store their input with row numbers and judge rows by these, so that null and
repeated ids are judged like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import decontaminate, lines, near_dup, packing, quality
from tarnmill.llm.common import fresh, staged, without_ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share.

    ``n_chars`` follows the new text where that column exists. Documents stay even if no
    line is left.
    """
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    done = lines.drop_repeated_lines(docs, lines=n_lines, dropped=n_dropped)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The stored rows of ``docs`` with a row number, and the name of its column."""
    row = fresh(docs, "row")
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id.

    Of copies with one id the first by its text's hash stays. A class of rows without ids keeps
    one of them.
    """
    rows, row = numbered(docs, "near-dedup-rows")
    found = near_dup.classes_of_rows(rows.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")))
    classes = staged(found.select(F.col("doc_id").alias(row), "class_id"), "classes")
    placed = rows.select(row, "doc_id", F.md5(F.col("text").cast("string")).alias("digest")).join(classes, row)
    first = placed.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", row)).alias("first"))
    copies = staged(classes.select(row).join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti"), "copies")
    return without_ids(rows, copies, row).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = numbered(docs, "decontamination-rows")
    found = decontaminate.contaminated(rows.select(F.col(row).alias("doc_id"), "text"), benchmark)
    return without_ids(rows, staged(found.select(F.col("doc_id").alias(row)), "contaminated"), row).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packed_sequences", packed_sequences),
]

# tokenising and the retrieval have no SQL; tests/llm compares the stages with plain models
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
