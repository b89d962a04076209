"""Stored index tables by bucket, so that a run joins them without shuffling them.

``write`` keeps two tables under a folder: ``places`` (source_path, chunk_index,
content_hash) and ``contents``, a row per content with the vector of the largest id that
holds it. Both are bucketed and sorted by what a run looks up. Only the run's side of a join,
which is as large as what was scanned, moves to the buckets; what it meets there is as
small, and later steps may shuffle that. It is dealt by the tables' own number of buckets:
left to the session's, the planner would shuffle the stored side whenever that is larger.

A file with very many chunks would make one bucket as large as itself. Places are therefore
dealt to ``PARTS`` parts by their index, and bucketed by path and part; the scanned paths are
repeated for each part. Contents are unlike, so no bucket of theirs grows alone.

Tables are external and known by their folder: each call names them anew in the session's
catalog, and drops the name again once the plan holds what it stood for. Bucket counts and
schemas are read from a table beside the data. Writing again replaces both tables.

Defined results: a chunk without a vector is a place, but no known content. Rows with a null
path, index or hash aren't stored. Two chunks in one place both stay. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import indexing

PARTS = 16
_KEYS = {"places": ("source_path", "part"), "contents": ("content_hash",)}


def _quoted(path: str) -> str:
    return path.replace("\\", "\\\\").replace("'", "\\'")


def _store(rows: DataFrame, path: str, name: str, buckets: int) -> None:
    spark, keys, table = rows.sparkSession, _KEYS[name], f"quill_{uuid.uuid4().hex}"
    # one task a bucket, so one sorted file a bucket
    dealt = rows.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{name}").mode("overwrite").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.createDataFrame([(buckets, columns)], "buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}_told")


def _attach(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, int]:
    told, table, keys = spark.read.parquet(f"{path}/{name}_told").first(), f"quill_{uuid.uuid4().hex}", ", ".join(_KEYS[name])
    spark.sql(f"CREATE TABLE {table} ({told['columns']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {told['buckets']} BUCKETS LOCATION '{_quoted(path)}/{name}'")
    try:
        return spark.table(table), told["buckets"]
    finally:
        spark.sql(f"DROP TABLE {table}")


@dataclass
class Colocated:
    """Both stored tables, with their buckets known to the planner."""

    places: DataFrame
    contents: DataFrame
    buckets: int

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Colocated:
        (places, buckets), (contents, _) = (_attach(spark, path, name) for name in _KEYS)
        return cls(places, contents, buckets)

    def of(self, scanned: DataFrame) -> DataFrame:
        """The stored places of some files (source_path)."""
        parts = scanned.select("source_path").distinct().select("source_path", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        parts = parts.repartition(self.buckets, *_KEYS["places"])
        return self.places.join(parts, list(_KEYS["places"]), "left_semi").drop("part")

    def plan(self, new: DataFrame, scanned: DataFrame) -> DataFrame:
        """What a run does to each place of the scanned files: as ``indexing.plan``."""
        return indexing.plan(new, self.of(scanned))

    def to_embed(self, planned: DataFrame) -> DataFrame:
        """Distinct hashes to embed that no stored file holds."""
        return indexing.embed_needed(planned.repartition(self.buckets, "content_hash"), self.contents)

    def vectors(self, hashes: DataFrame) -> DataFrame:
        """(content_hash, vector) of the wanted contents (content_hash) that are stored."""
        wanted = hashes.select("content_hash").repartition(self.buckets, "content_hash").distinct()
        return self.contents.join(wanted, "content_hash", "left_semi")


def write(chunks: DataFrame, vectors: DataFrame, path: str, buckets: int) -> Colocated:
    """Stores the places of ``chunks`` (id, source_path, chunk_index, content_hash) and the ``vectors`` (id, vector) of their contents."""
    known = chunks.where("content_hash is not null")
    places = known.where("source_path is not null and chunk_index is not null").select("source_path", "chunk_index", "content_hash", F.pmod(F.col("chunk_index"), F.lit(PARTS)).cast("int").alias("part"))
    held = known.select("id", "content_hash").join(vectors.select("id", "vector"), "id").groupBy("content_hash").agg(F.max_by("vector", "id").alias("vector"))
    _store(places, path, "places", buckets)
    _store(held, path, "contents", buckets)
    return Colocated.read(chunks.sparkSession, path)
