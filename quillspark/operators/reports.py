"""Reports and checks over the index. Notes never count, and ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.operators import chunking


def _files(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("repo") != C.NOTE_REPO)


def list_repos(chunks: DataFrame) -> DataFrame:
    out = _files(chunks).groupBy("repo").agg(F.count("*").alias("chunks"), F.sort_array(F.collect_set("language")).alias("languages"), F.max("indexed_at").alias("last_indexed"))
    return out.orderBy(F.desc_nulls_last("last_indexed"), "repo")


def stats(chunks: DataFrame) -> DataFrame:
    return _files(chunks).groupBy("repo", "language").agg(F.count("*").alias("chunks"), F.max("indexed_at").alias("last_indexed")).orderBy("repo", F.desc("chunks"), "language")


def count(chunks: DataFrame) -> DataFrame:
    return _files(chunks).agg(F.count("*").alias("chunks"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return _files(chunks).groupBy("source_path").agg(F.count("*").alias("chunks"))


def partial_files(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose stored count differs from what splitting them now gives (source_path, expected)."""
    both = chunk_counts(chunks).join(expected, "source_path")
    return both.where("chunks <> expected and expected > 0")


def recounted(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Files (source_path, repo, language, content) whose stored chunks aren't what splitting them now gives.

    Each file is split again by the splitter of its language. Per such file: chunks stored,
    ``expected`` now, and how many of the expected ones aren't stored with this content
    (``changed``). Files without stored chunks are for ``unindexed_files``.
    """
    now = chunking.chunk(files).select("source_path", "chunk_index", "content_hash")
    stored = _files(chunks).select("source_path", "chunk_index", F.col("content_hash").alias("_stored"))
    both = now.withColumn("_now", F.lit(1)).join(stored.withColumn("_was", F.lit(1)), ["source_path", "chunk_index"], "full_outer")
    told = both.groupBy("source_path").agg(
        F.count("_was").alias("chunks"), F.count("_now").alias("expected"), F.count(F.when(F.col("_now").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("_stored")), 1)).alias("changed")
    )
    scanned = files.select("source_path").distinct()
    return told.join(scanned, "source_path", "left_semi").where("chunks > 0 and (chunks <> expected or changed > 0)")


def missing_files(chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed files that the listing (path) lacks."""
    return _files(chunks).select("source_path").distinct().join(listing.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def unindexed_files(chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files (path, repo) without chunks, counted by repository."""
    stored = chunks.select(F.col("source_path").alias("path"))
    return listing.join(stored, "path", "left_anti").groupBy("repo").agg(F.count("*").alias("files"))
