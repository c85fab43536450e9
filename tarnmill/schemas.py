"""Explicit schemas of the tables that pass between stages."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in ("srow", "scol", "erow", "ecol")]
)

PREDICTION = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("prob", T.DoubleType())]
)

LEXED = "struct<tokens:array<struct<type:string,text:string,srow:int,scol:int,erow:int,ecol:int>>,error:string>"

FILE_COMMENTS = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("num_comments", T.IntegerType()),
        T.StructField("positions", T.ArrayType(SPAN)),
        T.StructField("repo", T.StringType()),
    ]
)

CLASSIFIED_FILES = T.StructType(
    FILE_COMMENTS.fields + [T.StructField("predictions", T.ArrayType(PREDICTION))]
)

TOKENIZED_FILES = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("hash", T.LongType()),
        T.StructField("num_lines", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)

REPOS = T.StructType([T.StructField("url", T.StringType()), T.StructField("stars", T.LongType())])
