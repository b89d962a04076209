"""Answers a table of queries over all documents: python -m jobs.batch_search --documents D --queries Q --output O

For each text of ``queries`` (item_id, text) the ``top_k`` best documents by BM25 are written
as (item_id, rank, doc_id, score, source), partitioned by ``bucket``, the item's id modulo
16: evaluation of an index, or context for many prompts at once. The output is overwritten
as a whole, so running again gives the same. Queries without a term of the corpus have no
rows; rows with a null id can't be answered or found and are left out; a null text has no
terms. Documents that repeat an id are ranked each, under that id and the greatest source it
has.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import keyword

log = logging.getLogger("batch_search")

BUCKETS = 16
ANSWERS = "item_id long, rank int, doc_id long, score double, source string, bucket int"


def answered(documents: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(item_id, rank, doc_id, score, source, bucket)."""
    known = documents.where("doc_id is not null")
    chunks = known.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    asked = queries.where("item_id is not null").groupBy(F.col("item_id").alias("query")).agg(F.max("text").alias("content"))
    best = keyword.bm25_batch(chunks, asked, top_k)
    rows = best.join(known.groupBy(F.col("doc_id").alias("id")).agg(F.max("source").alias("source")), "id")
    return rows.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score", "source", F.pmod("query", F.lit(BUCKETS)).cast("int").alias("bucket"))


def read(spark: SparkSession, output: str) -> DataFrame:
    """The answers that stand in the output."""
    return spark.read.schema(ANSWERS).parquet(output)


def run(spark: SparkSession, documents: str, queries: str, output: str, top_k: int = 10) -> dict:
    """Writes the best documents of every query; returns rows read and written."""
    docs, asked = spark.read.parquet(documents), spark.read.parquet(queries)
    told = {"documents": docs.count(), "queries": asked.count()}
    log.info("reads %(documents)d documents and %(queries)d queries", told)
    answered(docs, asked, top_k).repartition(BUCKETS, "bucket").sortWithinPartitions("item_id", "rank").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(output)
    told["answers"] = read(spark, output).count()
    log.info("wrote %d answers to %s", told["answers"], output)
    return told


if __name__ == "__main__":
    from jobs.config import main

    main(run, "batch_search", ["documents", "queries", "output"], ["top_k"])
