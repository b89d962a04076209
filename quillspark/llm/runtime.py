"""Shared storage for intermediate tables, and small plan helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch at most, so that long texts and large sets don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size; sizes beyond the bounds are lowered for the session, as plans read them when they run."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = int(re.sub(r"[^0-9-]", "", str(conf.get(key))) or -1)
        if held <= 0 or held > most:
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not held and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = held or tempfile.mkdtemp(prefix="quillspark-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a materialised table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quill_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs now instead of at some later collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``, a number of each row in the order of ids, nulls last and equal ids by text.

    It is the id itself where all ids are known and unlike. ``name`` mustn't be a column yet.
    """
    count = unused(docs, "n")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias(count)).where(F.col("doc_id").isNull() | (F.col(count) > 1))
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    return materialise(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over (a, b): one row (node, label) per node, label the smallest node it can reach.

    Each round hooks every root to its smallest neighbour if that is smaller, halves paths
    by joining the pointers with themselves, and rewrites the edges onto the roots. A root
    that stays has all its neighbours hooked to it, or one of them to a smaller root, which
    is then its neighbour and takes it in the next round. So of the roots with neighbours at
    most half are left after two rounds. All state stays in tables; joins on a label that a
    giant component shares are plain sort-merge joins of stored tables, which adaptive
    execution splits.
    """
    pairs = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    labels = None
    while not pairs.isEmpty():
        # pointers of this round's roots: larger end to its smallest neighbour
        both = pairs.select("a", "b")
        hook = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "hook")
        while True:
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = materialise(hook.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "hook")
            hook = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = materialise(nodes.join(hook, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
        else:
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialise(labels.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        left = hook.select(F.col("node").alias("a"), F.col("label").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("label").alias("rb"))
        moved = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        pairs = materialise(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else nodes.select("node", F.col("node").alias("label"))
