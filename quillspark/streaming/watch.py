"""Change events: filtering, moves, debouncing, and applying them to the index.

The functions take batch or streaming frames alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.operators import indexing, store
from quillspark.sources import changes, tree
from quillspark.streaming import debounce as debounce_


def watched(events: DataFrame) -> DataFrame:
    """Events whose path has a watched suffix."""
    return events.where(F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)).isin(*C.WATCHED_SUFFIXES))


def expand_moves(events: DataFrame) -> DataFrame:
    """Moves (with dest_path) as a deletion and a creation."""
    made = F.when(
        F.col("event_type") == "moved",
        F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("event_type"))),
    ).otherwise(F.array(F.struct("path", "event_type")))
    rest = [c for c in events.columns if c not in ("path", "event_type", "dest_path")]
    return events.select(*rest, F.explode(made).alias("_e")).select(*rest, "_e.path", "_e.event_type")


def debounce(events: DataFrame, gap: str = C.DEBOUNCE, late: str | None = None) -> DataFrame:
    """Per root and burst (no pause longer than the gap) the last event of each path.

    ``late`` bounds a stream's state with a watermark; batches need none.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    order = F.struct("ts", "seq")
    bursts = events.groupBy(F.session_window("ts", gap).alias("burst"), "root").agg(F.collect_list(F.struct("path", "ts", "seq", "event_type")).alias("_all"))
    if events.isStreaming:  # a second aggregation over the same stream isn't allowed: fold within the burst
        paths = F.array_distinct(F.transform("_all", lambda e: e["path"]))
        best = F.transform(paths, lambda p: F.array_max(F.transform(F.filter("_all", lambda e: e["path"] == p), lambda e: F.struct(e["ts"].alias("ts"), e["seq"].alias("seq"), p.alias("path"), e["event_type"].alias("event_type")))))
        return bursts.select("root", F.col("burst.start").alias("burst_start"), F.explode(best).alias("_e")).select("root", "burst_start", "_e.path", "_e.event_type")
    rows = bursts.select("root", F.col("burst.start").alias("burst_start"), F.explode("_all").alias("_e")).select("root", "burst_start", "_e.*")
    return rows.groupBy("root", "burst_start", "path").agg(F.max_by("event_type", order).alias("event_type"))


def apply_events(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after changes (path, event_type): deleted files go, others are replaced by ``fresh`` chunks of theirs."""
    gone = chunks.join(changes.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti").select(*chunks.columns)
    changed = changes.where("event_type <> 'deleted'").select(F.col("path").alias("source_path")).distinct()
    return gone.unionByName(fresh.join(changed, "source_path", "left_semi").select(*chunks.columns))


def run(events: DataFrame, handle, checkpoint: str, gap_ms: int = C.DEBOUNCE_MS, longest_ms: int = 60 * C.DEBOUNCE_MS, **trigger):
    """Starts a query that hands each batch of debounced changes to ``handle(frame, batch_id)``.

    Moves (events with ``dest_path``) count as a deletion and a creation. A burst comes out
    after ``gap_ms`` without an event of its root, and after ``longest_ms`` at the latest.
    """
    if "dest_path" in events.columns:
        events = expand_moves(events)
    spark = events.sparkSession
    key, held = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, debounce_.PROVIDER)  # a query keeps the settings it was started with
    try:
        ready = debounce_.debounced(watched(events), gap_ms, longest_ms)
        return ready.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def handler(held: store.SnapshotStore, embedder=None):
    """A handle for ``run``: each batch of changes becomes one commit of chunks and vectors to the store.

    Files pass the same ignore files and skip rules as in a scan of their watched root.
    """

    def handle(changes: DataFrame, batch_id: int) -> None:
        spark = held.spark
        there = F.max(F.when(F.col("event_type") != "deleted", 1).otherwise(0)).alias("there")
        last = changes.groupBy("path", "root").agg(there).collect()  # one burst's paths
        kept = {r["path"]: bool(r["there"]) and tree.exists(spark, r["path"]) for r in last}
        if not kept:
            return
        within = [r["root"] for r in last if r["root"] and r["path"].startswith(r["root"].rstrip("/") + "/")]
        listed = tree.scan(spark, [p for p, t in kept.items() if t], within)
        gone = spark.createDataFrame([(p,) for p, t in kept.items() if not t], "path string") if not all(kept.values()) else None
        indexing.index_files(held, tree.read_files(listed), listed.select(F.col("path").alias("source_path")), datetime.now(), embedder, gone)

    return handle


def live(held: store.SnapshotStore, events: DataFrame, roots: list[str], checkpoint: str, embedder=None, **how):
    """Catches up with every root, then follows its change events; returns the running query."""
    for root in roots:
        indexing.index_path(held, root, datetime.now(), embedder)
    return run(events, handler(held, embedder), checkpoint, **how)


def follow(held: store.SnapshotStore, roots: list[str], folder: str, checkpoint: str, embedder=None, **how):
    """``live`` over the changes that polls of the roots write to ``folder``; the caller polls, as often as it likes.

    The first listing is taken before the catch-up, so that no change falls between them.
    """
    changes.poll(held.spark, roots, folder)
    there = [r for r in roots if tree.exists(held.spark, r)]
    return live(held, changes.events(held.spark, folder), there, checkpoint, embedder, **how)
