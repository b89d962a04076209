"""Keeps the chunks of a growing table of documents: python -m jobs.index_documents --documents D --output O --checkpoint C

A file stream over the table's Parquet files takes what came since the last run, in batches
of files, and ends. Each batch leaves out documents whose text is the one already held,
splits the others, and writes two tables below ``output``:

* ``chunks``, partitioned by batch and repository: the rows of the index;
* ``files``, partitioned by batch: source_path and file_hash of each document written, also
  of those that have no chunks (any more).

A document counts as its newest batch tells it; ``current`` reads that state. A batch that is
run again after a failure takes the same files (they stand in the checkpoint) and overwrites
its own partitions, ``files`` last, so a half-written batch is never seen and nothing is
doubled. The checkpoint and the output belong together; to start over, remove both.

Rows with a null id or source are documents named ``null`` and ``null``; of rows that share a
path in one batch the one with the greatest text counts; null texts are empty. Other columns
of the table are ignored.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import files, identity
from quillspark.operators import chunking

log = logging.getLogger("index_documents")

FILES = "source_path string, file_hash string, batch long"
CHUNKS = "id string, content string, content_hash string, source_path string, language string, chunk_index int, start_line int, end_line int, batch long, repo string"


def named(documents: DataFrame) -> DataFrame:
    """Files (source_path, repo, language, content, file_hash), one for each path."""
    source, doc = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("source", "doc_id"))
    path = F.concat(F.lit("/"), source, F.lit("/"), doc, F.lit(".txt"))
    rows = documents.select(path.alias("source_path"), source.alias("repo"), F.coalesce("text", F.lit("")).alias("content"))
    one = rows.groupBy("source_path", "repo").agg(F.max("content").alias("content"))
    return one.select("source_path", "repo", files.language(F.col("source_path")).alias("language"), "content", identity.content_hash(F.col("content")).alias("file_hash"))


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the output, empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _newest(held: DataFrame) -> DataFrame:
    """The last batch of each path, with the hash written there."""
    return held.groupBy("source_path").agg(F.max("batch").alias("batch"), F.max_by("file_hash", "batch").alias("file_hash"))


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of all documents as they stand."""
    newest = _newest(_held(spark, f"{output}/files", FILES)).select("source_path", "batch")
    return _held(spark, f"{output}/chunks", CHUNKS).join(newest, ["source_path", "batch"])


def _pattern(path: str) -> str:
    """A pattern that only this path matches: a file stream takes a table in one file by patterns only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _write(rows: DataFrame, path: str, *parts: str) -> None:
    """Overwrites the partitions that ``rows`` have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _indexed(output: str, told: dict):
    def handle(documents: DataFrame, batch: int) -> None:
        spark = documents.sparkSession
        known = _newest(_held(spark, f"{output}/files", FILES).where(F.col("batch") < batch))
        known, seen = known.select("source_path", "file_hash"), Observation()

        def changed(rows: DataFrame) -> DataFrame:
            return named(rows).join(known, ["source_path", "file_hash"], "left_anti")

        number = F.lit(batch).cast("long").alias("batch")
        # all paths end in .txt, so the branch for Python sources isn't wanted
        _write(chunking.chunk(changed(documents.observe(seen, F.count(F.lit(1)).alias("n"))), python=False).select("*", number), f"{output}/chunks", "batch", "repo")
        _write(changed(documents).select("source_path", "file_hash", number), f"{output}/files", "batch")
        told["rows"], told["batches"] = told["rows"] + seen.get["n"], told["batches"] + 1
        own = F.col("batch") == batch
        wrote = [_held(spark, f"{output}/{t}", s).where(own).count() for t, s in (("files", FILES), ("chunks", CHUNKS))]
        log.info("batch %d: read %d rows, wrote %d documents in %d chunks to %s", batch, seen.get["n"], *wrote, output)

    return handle


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, files_per_batch: int = 1000) -> dict:
    """Indexes the documents that came since the last run; returns rows read and batches made."""
    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(documents))
    told = {"rows": 0, "batches": 0}
    query = stream.select("doc_id", "source", "text").writeStream.foreachBatch(_indexed(output, told)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %(rows)d new rows in %(batches)d batches", told)
    return told


if __name__ == "__main__":
    from jobs.config import main

    main(run, "index_documents", ["documents", "output", "checkpoint"], ["files_per_batch"])
