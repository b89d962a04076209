"""The folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where a local master names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs now instead of at some later collection of garbage.

    Py4J lets go of plans in a thread of its own that looks once a second, and Spark's
    listeners hold the last one for a moment, so one collection at once would find them held.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.1)
        spark.sparkContext._jvm.System.gc()
