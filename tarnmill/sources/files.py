"""Source files and archives as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.paths import relative_path, repo_of_path
from tarnmill.functions.tasks import row_function
from tarnmill.sources import archives

_ignore_undecodable = row_function(
    T.StringType(), lambda: lambda raw: None if raw is None else bytes(raw).decode("utf-8", "ignore")
)


def decode(content: Column) -> Column:
    """Text of a file: undecodable bytes dropped, line ends unified. Only content that is
    not valid UTF-8 leaves the JVM."""
    raw = content.cast("string")
    valid = F.is_valid_utf8(raw)
    repaired = _ignore_undecodable(F.when(~valid, content))
    return F.regexp_replace(F.when(valid, raw).otherwise(repaired), "\r\n?", "\n")


def _binary(spark: SparkSession, folder: str, pattern: str, skip_unreadable: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.option("ignoreMissingFiles", skip_unreadable).option("ignoreCorruptFiles", skip_unreadable).load(folder)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """``path, length`` of all files under a folder; contents are not read."""
    return _binary(spark, folder, pattern).select("path", "length")


def with_repo(files: DataFrame, base: str) -> DataFrame:
    """Add ``filename`` relative to the base folder and ``repo``, from ``path``."""
    named = files.withColumn("filename", relative_path(F.col("path"), base))
    return named.withColumn("repo", repo_of_path(F.col("filename")))


def read_files(spark: SparkSession, folder: str, pattern: str = "*.py", skip_unreadable: bool = False) -> DataFrame:
    """``file_id, repo, text`` of all files under ``folder/org/name``; the id is the
    relative path. Files outside a repository have no repo (see ``misplaced``).

    A file that cannot be read ends the job. With ``skip_unreadable`` it has no row here and
    one in ``unread_files``.
    """
    located = with_repo(_binary(spark, folder, pattern, skip_unreadable), folder)
    return located.select(F.col("filename").alias("file_id"), "repo", decode(F.col("content")).alias("text"))


def unread_files(spark: SparkSession, folder: str, files: DataFrame, pattern: str = "*.py") -> DataFrame:
    """``file_id, repo, error`` of the listed files that have no row in the stored ``files``."""
    listed = with_repo(list_files(spark, folder, pattern), folder).select(F.col("filename").alias("file_id"), "repo")
    return listed.join(files.select("file_id"), "file_id", "left_anti").withColumn("error", F.lit("unreadable"))


def misplaced(files: DataFrame) -> DataFrame:
    """Files that do not lie in a repository folder."""
    return files.where(F.col("repo").isNull())


def read_archives(
    spark: SparkSession, folder: str, suffixes: Sequence[str] = (".py",), pattern: str = "*.tar.gz"
) -> DataFrame:
    """``archive, member, content, error`` of the regular files in tar archives whose
    lower-cased name ends with one of the suffixes; no suffixes keep all. An archive that
    breaks off gives the members before the fault and one row with the error. Nothing is
    written to disk; each archive is streamed by one task, see ``archives``."""
    archives.register(spark)
    reader = spark.read.format("tar_members").option("pattern", pattern).option("suffixes", ",".join(suffixes))
    return reader.load(folder)


def write_selected(files: DataFrame, folder: str, key: str = "file_id") -> None:
    """Append selected files to a Parquet table, leaving out those it already has."""
    spark = files.sparkSession
    try:
        existing = spark.read.parquet(folder).select(key)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = None
    new = files if existing is None else files.join(existing, key, "left_anti")
    new.write.mode("append").parquet(folder)
