"""Comments of newly arrived source files.

A file stream remembers in its checkpoint which files it has seen, so a later run
only handles what is new: the resumable form of the extraction stage. Every file is
independent, so no state and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnmill.operators.comments import comment_blocks, comment_rows, filter_blocks
from tarnmill.operators.lexing import lex_files
from tarnmill.sources.files import decode, with_repo

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*.py", files_per_batch: int = 100_000) -> DataFrame:
    """Stream of ``file_id, repo, text``."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return with_repo(stream, folder).select(F.col("filename").alias("file_id"), "repo", decode(F.col("content")).alias("text"))


def extract_new_comments(spark: SparkSession, folder: str, output: str, checkpoint: str) -> StreamingQuery:
    """Append the comments of all files that have arrived since the last run."""
    found = filter_blocks(comment_blocks(lex_files(new_files(spark, folder))))
    rows = comment_rows(found, "file_id", "repo")
    writer = rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
