"""Schemas of the index tables."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("repo", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("indexed_at", T.TimestampType(), True),
    ]
)
VECTORS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False), False)])
POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)
EXPORT = T.StructType([*CHUNKS.fields, VECTORS["vector"], T.StructField("embed_model", T.StringType(), True)])
EVENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("root", T.StringType())])
RAW_CHUNK = T.StructType([T.StructField("content", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
