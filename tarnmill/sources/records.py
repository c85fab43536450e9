"""Per-file records, splits, labelled comments, vectors and catalogs on disk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.session import stored
from tarnmill.sources.archives import located

# ranges behind the first of their files that are sent to every task
MOST_RANGES = 1 << 20


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line, with an explicit schema."""
    return spark.read.schema(schema).json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(split_files: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split touches only its files."""
    split_files.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _least_range(spark: SparkSession) -> int:
    """Files up to this size are never cut into ranges."""
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    found = [re.match(r"(\d+)([bkmg]?)", spark.conf.get(f"spark.sql.files.{name}").lower()) for name in ("openCostInBytes", "maxPartitionBytes")]
    return min(int(size) * units[unit] for size, unit in (match.groups() for match in found))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files, with the position of each line (from 0).

    A large file is read in byte ranges by many tasks; a line belongs to the range in which it begins.
    Lines are numbered within their range, and a range's first number is the number of lines in
    the ranges before it, which takes one more pass over large files. Small ones are read once.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    small = F.col("_metadata.file_size") <= _least_range(spark)
    whole, cut = (
        read.where(files).select(*meta, F.col("value").alias("line")).mapInArrow(_number_in_range, "path string, start bigint, line string, line_no bigint")
        for files in (small, ~small)
    )
    # without texts; the splitting into ranges is the same as long as the files are
    ranges = stored(cut.groupBy("path", "start").agg((F.max("line_no") + 1).alias("n")), "ranges")
    ahead = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    later = ranges.withColumn("ahead", ahead).where("ahead is not null").select("path", "start", "ahead")
    later = stored(later, "offsets")
    if later.count() <= MOST_RANGES:
        later = F.broadcast(later)
    placed = cut.join(later, ["path", "start"], "left").withColumn("line_no", F.col("line_no") + F.coalesce("ahead", F.lit(0)))
    both = whole.unionByName(placed.select("path", "start", "line", "line_no"))
    return both.select("path", F.col("line_no").cast("int").alias("line_no"), "line")


def _number_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each row's place in its range; a task reads its ranges one after the other."""
    last, so_far = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
        code = path.indices.to_numpy()
        heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (start[1:] != start[:-1])))
        place = np.arange(batch.num_rows) - np.repeat(heads, np.diff(np.append(heads, batch.num_rows)))
        if (path.dictionary[int(code[0])].as_py(), int(start[0])) == last:
            place[: heads[1] if len(heads) > 1 else None] += so_far
        last, so_far = (path.dictionary[int(code[-1])].as_py(), int(start[-1])), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "start", "line")), pa.array(place)], ["path", "start", "line", "line_no"])


def write_labelled(folds: DataFrame, path: str) -> None:
    """Rows ``fold, part, label, text`` as lines ``__label__<label> <text>`` in files named
    ``part<task>_<fold>.<part>``, readable by ``read_labelled``.

    A task writes its own files whole, so one that runs again writes the same names again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(path)
        system.create_dir(root, recursive=True)
        task, streams = TaskContext.get().partitionId(), {}
        try:
            for batch in batches:
                for fold, part, label, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "part", "label", "text"))):
                    name = f"{root}/part{task}_{fold}.{part}"
                    if name not in streams:
                        streams[name] = system.open_output_stream(name)
                    streams[name].write(f"__label__{label} {text}\n".encode())
        finally:
            for stream in streams.values():
                stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([len(streams)], pa.int64())], ["files"])

    folds.select("fold", "part", "label", "text").mapInArrow(write, "files bigint").write.format("noop").mode("overwrite").save()


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """``fold, part, label, text`` from files named ``*_<fold>.train`` and ``*_<fold>.valid``.

    Lines without a label, blank ones among them, are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    name = r"_(\d+)\.(train|valid)$"
    line = r"^__label__(\S+) ?(.*)$"
    return lines.where(F.col("value").rlike(line)).select(
        F.regexp_extract("file", name, 1).cast("int").alias("fold"),
        F.regexp_extract("file", name, 2).alias("part"),
        F.regexp_extract("value", line, 1).alias("label"),
        F.regexp_extract("value", line, 2).alias("text"),
    )


def vector_table(model: Word2VecModel | DataFrame) -> DataFrame:
    """``word, vector`` of fitted word vectors, from a table of them or a model of Spark ML."""
    if isinstance(model, DataFrame):
        return model.select("word", F.col("vector").cast("array<float>").alias("vector"))
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Text lines ``word v1 ... vd`` after a header ``count dim`` in the first part file."""
    numbers = F.array_join(F.transform("vector", lambda v: v.cast("string")), " ")
    body = vectors.select(F.concat_ws(" ", "word", numbers).alias("value"))
    header = vectors.agg(
        F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("string")).alias("value")
    )
    header.coalesce(1).union(body).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    # the header has two whole numbers; written vector values always have a point
    lines = spark.read.text(path).where(~F.col("value").rlike("^[0-9]+ [0-9]+$"))
    parts = lines.select(F.split("value", " ").alias("p")).where(F.size("p") > 1)
    return parts.select(
        F.element_at("p", 1).alias("word"),
        F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vector"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``url, stars`` from JSON objects that map urls to stars."""
    objects = spark.read.text(path).select(F.from_json("value", "map<string,bigint>").alias("repos"))
    return objects.select(F.explode("repos").alias("url", "stars"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One small object per repository and line, readable by ``read_catalog``."""
    catalog.select(F.to_json(F.create_map("url", "stars")).alias("value")).write.mode("overwrite").text(path)
