"""Search: nearest vectors, BM25, and both fused by reciprocal ranks.

Candidates are cut before filters apply, five times as many as asked for, so a filtered
search may return fewer rows than exist. That is part of the results' meaning; it is why
``limit`` stands below ``where`` here. Scores are distances in vector mode (ascending),
else descending. Ties go by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text
from quillspark.operators import keyword
from quillspark.operators.neighbours import Blocks, screened


def knn(vectors: DataFrame | Blocks, query: list[float], k: int) -> DataFrame:
    """(id, distance) of the k nearest vectors (id, vector), all of them or stored by block; zero vectors are left out."""
    return vectors.nearest(query, k) if isinstance(vectors, Blocks) else screened(vectors, query, k)


@dataclass
class Postings:
    """A stored keyword index: its postings, and the number of chunks and of their terms."""

    rows: DataFrame
    n: int
    total: int


def _said(chunks: DataFrame, words: str, n: int, stored: Postings | None) -> DataFrame:
    """The best n (id, score) by BM25, from stored postings where there are any, else from the text."""
    phrases = text.phrases(words)
    scored = keyword.bm25(chunks, phrases) if stored is None else keyword.bm25_index(stored.rows, stored.n, stored.total, phrases)
    return scored.orderBy(F.desc("score"), "id").limit(n)


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """Positions from 0; ``rows`` are a few candidates already cut."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def ranked(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows as a list for fusion."""
    return _ranked(rows.orderBy(*order).limit(n), *order)


def rrf(*ranked: DataFrame, k: int = C.RRF_K) -> DataFrame:
    """(id, score) from lists (id, rank from 0): the sum of 1 / (k + rank + 1)."""
    both = reduce(DataFrame.unionByName, [r.select("id", "rank") for r in ranked])
    return both.groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def _filtered(rows: DataFrame, repo: str | None, include_notes: bool) -> DataFrame:
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    return rows if include_notes else rows.where(F.col("repo") != C.NOTE_REPO)


def _output(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "content", "source_path", "repo", "language", "start_line", "end_line", "score", *more)


def _with_chunks(candidates: DataFrame, chunks: DataFrame, stored: Postings | None = None) -> DataFrame:
    """Candidates are at most a few times top_k rows, so they are the broadcast side.

    Over a stored index their ids are looked up first, so that the scan of the chunks prunes by them.
    """
    if stored is not None:
        found = candidates.collect()
        candidates = chunks.sparkSession.createDataFrame(found, candidates.schema)
        chunks = chunks.where(F.col("id").isin([r["id"] for r in found]))
    return chunks.join(F.broadcast(candidates), "id")


def vector_search(chunks: DataFrame, vectors: DataFrame | Blocks, query: list[float], top_k: int = 10, repo: str | None = None, include_notes: bool = True, stored: Postings | None = None) -> DataFrame:
    fetch = top_k if repo is None and include_notes else C.OVERFETCH * top_k
    found = _with_chunks(knn(vectors, query, fetch).withColumnRenamed("distance", "score"), chunks, stored)
    return _output(_filtered(found, repo, include_notes)).orderBy("score", "id").limit(top_k)


def bm25_search(chunks: DataFrame, query: str, top_k: int = 10, repo: str | None = None, include_notes: bool = True, stored: Postings | None = None) -> DataFrame:
    fetch = top_k if repo is None and include_notes else C.OVERFETCH * top_k
    best = _said(chunks, query, fetch, stored)
    return _output(_filtered(_with_chunks(best, chunks, stored), repo, include_notes)).orderBy(F.desc("score"), "id").limit(top_k)


def fused(chunks: DataFrame, vectors: DataFrame | Blocks, query: list[float], words: str, top_k: int, stored: Postings | None = None) -> DataFrame:
    """Candidates of both lists with ranks from 0 and their fused score, the best first."""
    n = C.OVERFETCH * top_k
    near = _ranked(knn(vectors, query, n), "distance", "id").select("id", F.col("rank").alias("vector_rank"))
    said = _ranked(_said(chunks, words, n, stored), F.desc("score"), "id").select("id", F.col("rank").alias("bm25_rank"))
    parts = [F.coalesce(1 / (F.lit(C.RRF_K) + F.col(r) + 1), F.lit(0.0)) for r in ("vector_rank", "bm25_rank")]
    both = near.join(said, "id", "full_outer").withColumn("score", parts[0] + parts[1])
    return both.orderBy(*_order()).limit(n)


def _order():
    return F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank")


def hybrid_search(chunks: DataFrame, vectors: DataFrame | Blocks, query: list[float], words: str, top_k: int = 10, repo: str | None = None, include_notes: bool = True, stored: Postings | None = None) -> DataFrame:
    found = _with_chunks(fused(chunks, vectors, query, words, top_k, stored), chunks, stored)
    return _output(_filtered(found, repo, include_notes).orderBy(*_order()).limit(top_k))


def explain(chunks: DataFrame, vectors: DataFrame | Blocks, query: list[float], words: str, top_k: int = 8, repo: str | None = None, stored: Postings | None = None) -> DataFrame:
    """Hybrid search with both ranks, from 1; null where a list lacks the row."""
    found = _filtered(_with_chunks(fused(chunks, vectors, query, words, top_k, stored), chunks, stored), repo, True).orderBy(*_order()).limit(top_k)
    return _output(found.withColumns({"vector_rank": F.col("vector_rank") + 1, "bm25_rank": F.col("bm25_rank") + 1}), "vector_rank", "bm25_rank")


def search(chunks: DataFrame, vectors: DataFrame | Blocks, query: list[float] | None, words: str = "", top_k: int = 10, repo: str | None = None, mode: str = "hybrid", include_notes: bool = True, stored: Postings | None = None) -> DataFrame:
    how = {"top_k": top_k, "repo": repo, "include_notes": include_notes, "stored": stored}
    if mode == "vector":
        return vector_search(chunks, vectors, query, **how)
    if mode == "bm25":
        return bm25_search(chunks, words, **how)
    if mode == "hybrid":
        return hybrid_search(chunks, vectors, query, words, **how)
    raise ValueError(f"unknown mode {mode!r}")
