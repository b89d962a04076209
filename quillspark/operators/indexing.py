"""Incremental indexing: what to keep, reuse, embed and delete."""

from __future__ import annotations

from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import files, identity
from quillspark.functions.vectors import HashEmbedder, batches
from quillspark.operators import chunking, reports, store
from quillspark.sources import tree


def plan(new: DataFrame, old: DataFrame, strict_compat: bool = False) -> DataFrame:
    """(source_path, chunk_index, content_hash, action) from new and stored chunks of the scanned files, those without chunks included.

    unchanged: same place, same content; reuse: the content stands elsewhere in the stored
    file, so its vector does; embed: new content; delete: the place is gone. A file without
    chunks loses its rows, unless ``strict_compat`` keeps them.
    """
    key = ["source_path", "chunk_index"]
    n = new.select(*key, F.col("content_hash").alias("_new"))
    o = old.select(*key, F.col("content_hash").alias("_old"))
    known = old.select("source_path", F.col("content_hash").alias("_new")).distinct().withColumn("_known", F.lit(True))
    both = n.join(o, key, "full_outer").join(known, ["source_path", "_new"], "left")
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_new") == F.col("_old"), "unchanged").when(F.col("_known"), "reuse").otherwise("embed")
    out = both.select(*key, F.coalesce("_new", "_old").alias("content_hash"), action.alias("action"))
    if strict_compat:
        out = out.join(new.select("source_path").distinct(), "source_path", "left_semi")
    return out


def hash_map_by_index(chunks: DataFrame) -> DataFrame:
    """Per file its indexes and hashes as a map."""
    return chunks.groupBy("source_path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_index", "content_hash")))).alias("hashes"))


def vectors_by_hash(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(source_path, content_hash, vector), of equal contents that of the last index."""
    best = chunks.groupBy("source_path", "content_hash").agg(F.max_by("id", "chunk_index").alias("id"))
    return best.join(vectors, "id").select("source_path", "content_hash", "vector")


def known_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_path").agg(F.sort_array(F.collect_set("content_hash")).alias("hashes"))


def embed_needed(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct hashes to embed that no stored chunk of any file has."""
    return planned.where("action = 'embed'").select("content_hash").distinct().join(stored.select("content_hash"), "content_hash", "left_anti")


def run_stats(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: embedded, reused (copies in other files too), unchanged and deleted."""
    embedded = embed_needed(planned, stored).agg(F.count("*").alias("embedded"))
    counts = planned.agg(*(F.count(F.when(F.col("action") == a, 1)).alias(f"_{a}") for a in ("embed", "reuse", "unchanged", "delete")))
    one = counts.join(F.broadcast(embedded))  # one row each
    return one.select("embedded", (F.col("_reuse") + F.col("_embed") - F.col("embedded")).alias("reused"), F.col("_unchanged").alias("unchanged"), F.col("_delete").alias("deleted"))


def _embed(frames, embedder, area: int, rows: int):
    for frame in frames:
        frame = frame.assign(content=frame.content.str.slice(0, C.EMBED_CHARS)).iloc[frame.content.str.len().clip(upper=C.EMBED_CHARS).argsort(kind="stable")]
        for _, part in frame.groupby(batches(frame.content.str.len(), area, rows).to_numpy()):
            yield pd.DataFrame({"content_hash": part.content_hash.to_numpy(), "vector": embedder.embed(part.content.tolist())})


def embed(contents: DataFrame, embedder=None) -> DataFrame:
    """(content_hash, vector) of distinct contents (content_hash, content), in batches by padded area."""
    work = partial(_embed, embedder=embedder or HashEmbedder(), area=C.BATCH_AREA, rows=C.BATCH_ROWS)
    return contents.select("content_hash", "content").mapInPandas(work, "content_hash string, vector array<float>")


def apply(new: DataFrame, chunks: DataFrame, vectors: DataFrame, now, embedder=None, scanned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables after indexing: (chunks, vectors). ``new`` has all chunks of the scanned files.

    ``scanned`` (source_path) lists those files; a listed file without chunks loses its rows.
    Without it the files that ``new`` has are taken. Each content is embedded once, whatever
    the number of files that hold it; vectors of known content come from the stored tables,
    which are searched for the contents to write only.
    """
    scanned = (new if scanned is None else scanned).select("source_path").distinct()
    old = chunks.join(scanned, "source_path", "left_semi")
    planned = plan(new, old)
    written = planned.where("action in ('reuse', 'embed')").select("source_path", "chunk_index")
    rows = new.join(written, ["source_path", "chunk_index"], "left_semi").withColumn("indexed_at", F.lit(now).cast("timestamp"))
    gone = planned.where("action <> 'unchanged'").select(identity.chunk_id(F.col("source_path"), F.col("chunk_index")).alias("id"))
    wanted = rows.select("content_hash").distinct()
    held = chunks.select("id", "content_hash").join(wanted, "content_hash", "left_semi").join(vectors, "id").groupBy("content_hash").agg(F.max_by("vector", "id").alias("vector"))
    missing = embed_needed(planned, chunks)
    fresh = embed(new.join(missing, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("content").alias("content")), embedder)
    new_vectors = rows.select("id", "content_hash").join(held.unionByName(fresh), "content_hash").select("id", "vector")
    return chunks.join(gone, "id", "left_anti").unionByName(rows.select(*chunks.columns)), vectors.join(gone, "id", "left_anti").unionByName(new_vectors)


#: Keys up to which a lookup names them, so that a scan of the store prunes by them.
FEW = 1000


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (one column of that name): by their values where they are few, else by a join."""
    few = keys.select(column).distinct().limit(FEW + 1).collect()
    return rows.where(F.col(column).isin([r[0] for r in few])) if len(few) <= FEW else rows.join(keys.select(column).distinct(), column, "left_semi")


def below(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of the files named by ``paths`` (path), and of files below them."""
    few = [r[0] for r in paths.select("path").distinct().limit(FEW // 10 + 1).collect()]
    if len(few) <= FEW // 10:
        return rows.where(reduce(lambda a, b: a | b, (store.under(F.col("source_path"), p) for p in few), F.lit(False)))
    above = rows.select("id", F.explode(F.concat(F.array("source_path"), files.ancestors(F.col("source_path")))).alias("path"))
    return rows.join(above.join(paths.select("path").distinct(), "path", "left_semi").select("id").distinct(), "id", "left_semi")


def remove(paths: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables without the files of ``paths`` (path) and whatever lies below a path."""
    return tuple(store.cascade(below(chunks, paths).select("id"), chunks, vectors))


ACTIONS = ("embed", "reuse", "unchanged", "delete")


def index_files(held: store.SnapshotStore, found: DataFrame, scanned: DataFrame, now, embedder=None, removed: DataFrame | None = None) -> dict:
    """Splits files (source_path, repo, language, content), publishes what changed, and returns the run's statistics.

    ``removed`` (path) names files and directories whose rows go. The new chunks, the plan
    and the contents to embed are each written once and read back by the steps after them;
    the statistics are counted as they are written. What is written to the store is in
    proportion to what changed. A run without changes publishes nothing.
    """
    base = held.snapshot()
    count = F.count(F.lit(1)).alias("n")
    paths, listed = held.staged(scanned.select("source_path").distinct(), "scanned")
    if not listed["n"] and removed is None:
        held.unstage(paths)
        return dict.fromkeys(("embedded", "reused", "unchanged", "deleted", "removed"), 0)
    kinds = {r[0] for r in paths.select(files.language(F.col("source_path"))).distinct().collect()}  # of a fixed table
    new, _ = held.staged(chunking.chunk(found, kinds=kinds), "new")
    chunks, lost = base.chunks, None
    if removed is not None:
        lost, gone_files = held.staged(below(chunks, removed).select("id", "content"), "removed")
        chunks = chunks.join(lost.select("id"), "id", "left_anti")
    old = among(chunks, "source_path", paths)
    planned, told = held.staged(plan(new, old), "plan", *(F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ACTIONS))
    written = planned.where("action in ('reuse', 'embed')").select("source_path", "chunk_index", "action")
    rows = new.join(written, ["source_path", "chunk_index"]).withColumn("indexed_at", F.lit(now).cast("timestamp"))
    known = among(chunks.select("id", "content_hash"), "content_hash", rows.select("content_hash"))
    contents = rows.where("action = 'embed'").join(known.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content"))
    contents, to_embed = held.staged(contents, "contents", count)
    stats = {"embedded": to_embed["n"], "reused": told["reuse"] + told["embed"] - to_embed["n"], "unchanged": told["unchanged"], "deleted": told["delete"], "removed": 0 if lost is None else gone_files["n"]}
    staged = [t for t in (new, paths, planned, contents, lost) if t is not None]
    if stats["embedded"] or stats["reused"] or stats["deleted"] or stats["removed"] or not base.number:
        one = known.groupBy("content_hash").agg(F.max("id").alias("id"))
        stored = among(base.vectors, "id", one).join(one, "id").select("content_hash", "vector")
        vectors = rows.select("id", "content_hash").join(stored.unionByName(embed(contents, embedder)), "content_hash").select("id", "vector")
        gone = old.join(planned.where("action <> 'unchanged'"), ["source_path", "chunk_index"], "left_semi").select("id", "content")
        if lost is not None:
            gone = gone.unionByName(lost)
        held.change(rows, vectors, gone, base.number, 1 + listed["n"] // 100 if listed["n"] <= FEW else None)
    held.unstage(*staged)
    return stats


def index_path(held: store.SnapshotStore, path: str, now, embedder=None, batches: int = 1, tag: str | None = None) -> dict:
    """Indexes a directory tree or one file, from the scan to the commit; returns the run's statistics.

    ``batches`` deals the files out by the hash of their path; each batch is published by
    itself, so a run that is stopped leaves whole batches and the next one embeds only the
    rest. ``tag`` marks the run's jobs: ``sparkContext.cancelJobsWithTag(tag)`` stops it from
    any thread, and what wasn't published isn't seen.
    """
    spark, total = held.spark, {}
    if tag is not None:
        spark.sparkContext.addJobTag(tag)
    try:
        listed = tree.scan(spark, path)
        for k in range(batches):
            own = listed if batches == 1 else listed.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == k)
            told = index_files(held, tree.read_files(own), own.select(F.col("path").alias("source_path")), now, embedder)
            total = {c: total.get(c, 0) + n for c, n in told.items()}
        return total
    finally:
        if tag is not None:
            spark.sparkContext.removeJobTag(tag)


def rebuild(held: store.SnapshotStore, now, embedder=None) -> dict:
    """Indexes every repository of the index anew and embeds all contents; returns the new chunks by repository.

    Repositories that are gone from the file system are left as they are, notes too. All
    changes are one commit, under the store's model.
    """
    base = held.snapshot(any_model=True)
    repos = [r["repo"] for r in reports.list_repos(base.chunks).select("repo").collect()]
    there = [r.rstrip("/") for r in repos if tree.exists(held.spark, r)]
    if not there:
        return {}
    new, _ = held.staged(chunking.chunk(tree.read_files(tree.scan(held.spark, there))).withColumn("indexed_at", F.lit(now).cast("timestamp")), "new")
    kept, _ = remove(held.spark.createDataFrame([(r,) for r in there], "path string"), base.chunks, base.vectors)
    rows, _ = held.staged(kept.unionByName(new.select(*kept.columns)), "rows")
    fresh = embed(rows.select("content_hash", "content").dropDuplicates(["content_hash"]), embedder)
    held.commit(rows, rows.select("id", "content_hash").join(fresh, "content_hash").select("id", "vector"), base.number)
    told = {r["repo"]: r["n"] for r in new.groupBy("repo").agg(F.count("*").alias("n")).collect()}
    held.unstage(new, rows)
    return told
