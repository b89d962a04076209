"""After search: overlap removal, context packing, rendering."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions.text import token_estimate


class Intervals:
    """Kept line ranges of a file, sorted and disjoint: a range is met by the last one that begins at or before its end, or by none."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, start: int, end: int) -> bool:
        """Whether the range meets no kept one; then it is kept."""
        at = bisect_right(self.starts, end)
        if at and self.ends[at - 1] >= start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _kept(batches):
    """Ranges of one or more files in the order of files and ranks; a file's kept ranges stay with the task until its last row."""
    path, held = None, Intervals()
    for batch in batches:
        keep = []
        for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("source_path", "start_line", "end_line")), strict=True):
            if p != path:
                path, held = p, Intervals()
            keep.append(held.add(a, b))
        yield batch.filter(pa.array(keep, pa.bool_()))


def dedup_overlap(results: DataFrame, rank: str = "rank") -> DataFrame:
    """Keeps a row unless its lines meet those of a kept better row of the same file (greedy, by rank).

    Each file's ranges come to one task in the order of ranks, in Arrow batches, and are
    looked up by binary search among the kept ones; no list of a file's rows is built. Of
    rows with equal rank the one with the smaller lines comes first. Rows without a path or
    lines, and ranges that end before they begin, are left out.
    """
    whole = results.where("source_path is not null and start_line <= end_line")
    rows = whole.select("source_path", F.col(rank).alias("rank"), "start_line", "end_line")
    dealt = rows.repartition("source_path").sortWithinPartitions("source_path", "rank", "start_line", "end_line")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = dealt.mapInArrow(_kept, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    kept = kept.select("source_path", F.col("rank").alias(rank), "start_line", "end_line")
    return whole.join(kept, ["source_path", rank, "start_line", "end_line"], "left_semi")


def block(header: Column) -> Column:
    return F.concat(header, F.lit("```"), F.col("language"), F.lit("\n"), F.col("content"), F.lit("\n```"))


def pack_context(results: DataFrame, budget: int) -> DataFrame:
    """Blocks in file order until the first that would overrun the token budget; the first always stays."""
    files = F.when(F.col("language") == C.NOTE_LANGUAGE, F.lit(None)).otherwise(F.col("source_path"))
    order = Window.orderBy("source_path", "start_line", "end_line")
    # the last file named above a row, notes aside
    rows = results.withColumn("_file", files).withColumn("_above", F.last("_file", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    lines = F.concat(F.lit("## lines "), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("\n"))
    named = F.concat(F.lit("# "), F.col("source_path"), F.lit("  ("), F.col("language"), F.lit(")\n"), lines)
    header = F.when(F.col("_file").isNull(), F.lit("# [memory]\n")).when(F.col("_above") == F.col("_file"), lines).otherwise(named)
    rows = rows.withColumn("block", block(header)).withColumn("cost", token_estimate(F.col("block")))
    rows = rows.withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(order))
    return rows.where((F.col("used") <= budget) | (F.col("position") == 1)).select("position", "source_path", "start_line", "end_line", "block", "cost", "used")


def markdown(results: DataFrame) -> DataFrame:
    """One text per result, as the search tool shows it."""
    title = F.concat(F.lit("### "), F.col("source_path"), F.lit(" (lines "), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(")\n"))
    return results.withColumn("markdown", F.concat(block(title), F.lit("\n")))


def context(found: DataFrame, budget: int, ascending: bool = False) -> DataFrame:
    """Search results to packed blocks: of the best 50 by score those that don't overlap, in file order up to the budget."""
    order = (F.col("score").asc() if ascending else F.col("score").desc(), "id")
    best = found.orderBy(*order).limit(C.CONTEXT_RESULTS)
    return pack_context(dedup_overlap(best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))), budget)


def told(held, embedder, query: str, top_k: int = 8, repo: str | None = None, mode: str = "hybrid") -> str:
    """The search tool's answer over a store: results as Markdown, or why there are none."""
    if not query:
        return "Empty query."
    try:
        found = held.search(embedder.embed_query(query), query, int(top_k), repo, mode).collect()
    except Exception as e:
        return f"Search error: {e}"
    if not found:
        return "No relevant results found."
    return "\n".join(f"### {r.source_path} (lines {r.start_line}-{r.end_line})\n```{r.language}\n{r.content}\n```\n" for r in found)


def short_path(path: Column, home: str) -> Column:
    """A path below the home directory with ``~`` in its place."""
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))).otherwise(path)


def bar(done: int, total: int, width: int = 32) -> str:
    """A progress bar in plain characters."""
    share = done / total if total else 0.0
    full = int(width * share)
    return f"[{'#' * full}{'.' * (width - full)}] {done}/{total} ({share * 100:3.0f}%)"


def displayed(found: DataFrame, ascending: bool = False) -> DataFrame:
    """(place, title, content) of search results with the best one last, right above a prompt."""
    order = (F.col("score").asc() if ascending else F.col("score").desc(), "id")
    label = F.when(F.col("language") == C.NOTE_LANGUAGE, F.lit("memory")).otherwise(F.concat("source_path", F.lit("  lines "), "start_line", F.lit("-"), "end_line"))
    rows = found.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # the results of one search
    title = F.concat(F.lit("#"), F.col("place"), F.lit("  "), label, F.lit("  score="), F.format_string("%.4f", F.col("score").cast("double")))
    return rows.select("place", title.alias("title"), "content").orderBy(F.desc("place"))
