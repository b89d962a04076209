"""Changes below watched roots, as a stream: listings are taken by executors and compared by a join.

``poll`` lists the roots once, stores the listing under the next version, and writes what
differs from the version before as events. A file stream over those events, ``events``, is
the source: its checkpoint knows which were taken, so a restart loses none. Events of a
version are made from two stored listings; where a poll was stopped between the listing and
its events, the next one writes them first.

Defined results: the first listing has no events. Roots that don't exist are left out; files
of a root that has gone since stay listed, without events, until it is back. A file whose
length or time differs is modified.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import tree

LISTING = "path string, length long, modified long, root string, version long"
EVENTS = "path string, event_type string, ts timestamp, seq long, root string, version long"


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, event_type, root) of what differs between two listings (path, length, modified, root)."""
    o = old.select("path", F.struct("length", "modified").alias("_old"), F.col("root").alias("_old_root"))
    n = new.select("path", F.struct("length", "modified").alias("_new"), F.col("root").alias("_new_root"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return o.join(n, "path", "full_outer").select("path", kind.alias("event_type"), F.coalesce("_new_root", "_old_root").alias("root")).where("event_type is not null")


def _tell(spark: SparkSession, folder: str, version: int, now: datetime) -> None:
    """Writes the events of a version, made from its listing and the one before."""
    listings = _held(spark, f"{folder}/listings", LISTING)
    found = compare(listings.where(F.col("version") == version - 1), listings.where(F.col("version") == version))
    _write(found.select("path", "event_type", F.lit(now).cast("timestamp").alias("ts"), F.monotonically_increasing_id().alias("seq"), "root", F.lit(version).cast("long").alias("version")), f"{folder}/events")


def poll(spark: SparkSession, roots: list[str], folder: str, now: datetime | None = None) -> int:
    """Takes one listing and writes its events; returns its version."""
    now = now or datetime.now()
    listings = _held(spark, f"{folder}/listings", LISTING)
    last = _last(listings)
    if last > 1 and _last(_held(spark, f"{folder}/events", EVENTS)) < last:
        _tell(spark, folder, last, now)  # of a poll that was stopped, or nothing
    gone = [r for r in roots if not tree.exists(spark, r)]
    listed = tree.scan(spark, roots).select("path", "length", "modified", "root")
    if gone and last:
        before = listings.where(F.col("version") == last).where(F.col("root").isin([tree.top(r) for r in gone]))
        listed = listed.unionByName(before.select(*listed.columns))
    _write(listed.withColumn("version", F.lit(last + 1).cast("long")), f"{folder}/listings")
    if _last(_held(spark, f"{folder}/listings", LISTING)) == last:  # nothing listed: a version of its own all the same
        _write(spark.createDataFrame([("", 0, 0, "", last + 1)], LISTING), f"{folder}/listings")
    if last:
        _tell(spark, folder, last + 1, now)
    for v in range(max(1, last - 2), last):  # two listings are all that is needed
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/listings/version={v}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return last + 1


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of changes (path, event_type, ts, seq, root)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/events")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)  # a stream needs its folder
    return spark.readStream.schema(EVENTS).parquet(f"{folder}/events").where("path <> ''").drop("version")
