"""Keyword search: stemmed terms, postings, corpus statistics and BM25 with phrases.

A term is the Porter stem of a folded run of letters and digits; text, stored postings and
queries all go through the same two steps. Splitting and folding are Spark expressions.
Stems come in Arrow batches, once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text

class _Stems(dict):
    """Stems by word, as far as they were asked for; starts anew beyond its size."""

    MOST = 1 << 18

    def __missing__(self, word: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = text.Porter.stem(word)
        return self[word]


def stems(phrases: list[list[str]]) -> list[list[str]]:
    """The phrases of a query with each term stemmed."""
    return [[text.Porter.stem(w) for w in p] for p in phrases]


def _words(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words of a list column, the words they stand for, and the row of each; blank pieces are left out."""
    off = column.offsets.to_numpy()
    encoded = column.flatten().dictionary_encode()
    codes, rows = encoded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(off))
    words = encoded.dictionary.to_pylist()
    if "" in words:
        full = codes != words.index("")
        codes, rows = codes[full], rows[full]
    return codes, words, rows


#: Words that a task looks at together, however many an Arrow batch holds; a row with more stands alone.
WORDS_AT_A_TIME = 1 << 19


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with some ``WORDS_AT_A_TIME`` words, so that what a task holds doesn't grow with them."""
    for batch in batches:
        off, at = batch.column("t").offsets.to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + WORDS_AT_A_TIME, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _positions(rows: np.ndarray) -> np.ndarray:
    """The place of each word in its row; rows are in order."""
    size = np.bincount(rows)
    return np.arange(len(rows)) - (np.cumsum(size) - size)[rows]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Stems()
    for batch in _parts(batches):
        codes, words, rows = _words(batch.column("t"))
        distinct: dict[str, int] = {}
        stem_of = np.array([distinct.setdefault(known[w], len(distinct)) for w in words], np.int64)
        term, pos = stem_of[codes] if len(codes) else codes, _positions(rows)
        order = np.argsort(rows * len(distinct) + term, kind="stable")  # places are in order already
        term, pos, rows = term[order], pos[order], rows[order]
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (rows[1:] != rows[:-1])))) if len(term) else np.zeros(0, np.int64)
        size = np.bincount(rows, minlength=batch.num_rows)
        off = np.append(new, len(term)).astype(np.int32)
        terms = pa.array(list(distinct), pa.string()).take(pa.array(term[new]))
        columns = [terms, batch.column("id").take(pa.array(rows[new])), pa.array(size[rows[new]], pa.int32()), pa.array(np.diff(off), pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(pos, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "len", "tf", "positions"])


#: Inputs up to so many bytes are dealt anew where they come in fewer files than there are cores.
SMALL_INPUT = 1 << 30


def _spread(rows: DataFrame) -> DataFrame:
    """A small input in one or a few files would run in as many tasks; larger ones stay as they are read."""
    plan, cores = rows._jdf.queryExecution().optimizedPlan(), rows.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.stats().sizeInBytes())) > SMALL_INPUT or not 0 < len(rows._jdf.inputFiles()) < cores:
        return rows
    return rows.repartition(cores)


def _split(chunks: DataFrame) -> DataFrame:
    return _spread(chunks.select("id", "content")).select("id", text.pieces(F.col("content")).alias("t"))


def _id_type(chunks: DataFrame) -> str:
    return chunks.schema["id"].dataType.simpleString()


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, len, tf, positions) of all chunks (id, content); len is the chunk's count of terms."""
    return _split(chunks).mapInArrow(_postings, f"term string, id {_id_type(chunks)}, len int, tf int, positions array<int>")


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.size(text.terms(F.col("content"))).alias("len"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """Chunks that hold each term; terms repeat within a chunk only before the shuffle."""
    return postings(chunks).groupBy("term").agg(F.count("*").alias("df"))


def _counted(batches: Iterator[pa.RecordBatch], phrases: list[list[str]]) -> Iterator[pa.RecordBatch]:
    """The length of each chunk and how often it holds each phrase; only words that may have a stem of the query's are stemmed."""
    known = _Stems()
    wanted = {s: k for k, s in enumerate(dict.fromkeys(s for p in phrases for s in p))}
    for batch in _parts(batches):
        codes, words, rows = _words(batch.column("t"))
        held = pa.array(words, pa.string())
        which = np.full(len(words) + 1, -1, np.int64)
        for s, k in wanted.items():  # all but the last letter of a stem stand in the word
            for i in np.flatnonzero(pc.starts_with(held, s[:-1]).to_numpy(zero_copy_only=False)):
                if known[words[i]] == s:
                    which[i] = k
        term = which[codes] if len(codes) else codes
        counts = []
        for p in phrases:
            hit = term == wanted[p[0]] if p else np.zeros(len(term), bool)
            for k, s in enumerate(p[1:], 1):
                hit[: len(hit) - k] &= (term[k:] == wanted[s]) & (rows[k:] == rows[:-k])
                hit[max(len(hit) - k, 0) :] = False
            counts.append(np.bincount(rows[hit], minlength=batch.num_rows))
        n = batch.num_rows
        flat = np.stack(counts, axis=1).astype(np.int32).ravel()
        tf = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(phrases)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.bincount(rows, minlength=n), pa.int32()), tf], names=["id", "_len", "_tf"])


def _weight(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(C.BM25_LEAST_IDF))
    return idf * (tf * (C.BM25_K1 + 1)) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / average))


def bm25(chunks: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, score) of chunks with any phrase, straight from their text.

    Two scans without a shuffle of postings: one aggregates the corpus statistics into a
    single row, one scores. A phrase listed twice counts twice.
    """
    phrases = stems(phrases)
    if not any(phrases):
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    rows = _split(chunks).mapInArrow(partial(_counted, phrases=phrases), f"id {_id_type(chunks)}, _len int, _tf array<int>")
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count(F.when(F.get("_tf", F.lit(i)) > 0, 1)).alias(f"_df{i}") for i in range(len(phrases))))
    hits = rows.where(F.exists("_tf", lambda t: t > 0)).join(F.broadcast(stats))  # one row
    score = reduce(lambda a, b: a + b, (_weight(F.get("_tf", F.lit(i)), F.col(f"_df{i}"), F.col("_n"), F.col("_len"), F.col("_avg")) for i in range(len(phrases))))
    return hits.select("id", score.alias("score"))


def bm25_index(held: DataFrame, n: int, total: int, phrases: list[list[str]]) -> DataFrame:
    """(id, score) from stored postings of ``n`` chunks with ``total`` terms.

    One scan takes the postings of all the query's terms; they are dealt by chunk once, and
    both the phrases' frequencies and the scores come from that.
    """
    phrases = [p for p in stems(phrases) if p]
    if not phrases:
        return held.select("id", F.lit(0.0).alias("score")).limit(0)
    follow = {w for p in phrases if len(p) > 1 for w in p}  # only these need their places
    places = F.when(F.col("term").isin(follow), F.col("positions")).alias("positions") if follow else F.lit(None).cast("array<int>").alias("positions")
    own = held.where(F.col("term").isin(sorted({w for p in phrases for w in p})))
    own = own.select("id", F.struct("term", "len", "tf", places).alias("_h")).groupBy("id").agg(F.collect_list("_h").alias("_held"))
    runs = F.concat(*(_runs(F.col("_held"), i, p) for i, p in enumerate(phrases)))
    tf = own.select("id", F.explode(runs).alias("_r")).select("id", "_r.*")
    df = tf.groupBy("_p").agg(F.count("*").alias("_df"))  # one row per phrase of the query
    weight = _weight(F.col("_tf"), F.col("_df"), F.lit(n), F.col("len"), F.lit(total / max(n, 1)))
    return tf.join(F.broadcast(df), "_p").groupBy("id").agg(F.sum(weight).alias("score"))


def _runs(held: Column, i: int, phrase: list[str]) -> Column:
    """(len, _p, _tf) of phrase ``i`` from a chunk's postings of the query's terms."""
    of = lambda word: F.filter(held, lambda h: h["term"] == word)
    if len(phrase) == 1:
        return F.transform(of(phrase[0]), lambda h: F.struct(h["len"].alias("len"), F.lit(i).alias("_p"), h["tf"].alias("_tf")))
    runs = of(phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        runs = _followed(runs, of(word), k)
    return F.transform(F.filter(runs, lambda r: F.size(r["positions"]) > 0), lambda r: F.struct(r["len"].alias("len"), F.lit(i).alias("_p"), F.size(r["positions"]).alias("_tf")))


def _followed(runs: Column, following: Column, k: int) -> Column:
    """The runs whose ``k``-th next word is the following one."""

    def one(r: Column) -> Column:
        places = lambda h: F.array_intersect(r["positions"], F.transform(h["positions"], _back(k)))
        return F.transform(following, lambda h: F.struct(r["len"].alias("len"), places(h).alias("positions")))

    return F.flatten(F.transform(runs, one))


def _back(k: int):
    return lambda p: p - k


#: Queries of a batch that share one scan of the chunks.
QUERIES_A_SCAN = 2000


def _hits(batch: pa.RecordBatch, known: _Stems, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each row, then row, term and frequency of each hit, by term)."""
    codes, words, rows = _words(batch.column("t"))
    size = np.bincount(rows, minlength=batch.num_rows)
    of = np.array([vocabulary.get(known[w], -1) for w in words] or [-1], np.int64)
    term = of[codes] if len(codes) else codes
    found = term >= 0
    pairs, tf = np.unique(term[found] * batch.num_rows + rows[found], return_counts=True)
    return size, pairs % max(batch.num_rows, 1), pairs // max(batch.num_rows, 1), tf


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A task's counts: chunks with each term, then (place -1) chunks and (place -2) words."""
    known, df, n, words = _Stems(), np.zeros(len(vocabulary), np.int64), 0, 0
    for batch in _parts(batches):
        size, _, term, _ = _hits(batch, known, vocabulary)
        df += np.bincount(term, minlength=len(df))
        n, words = n + batch.num_rows, words + int(size.sum())
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int32()), pa.array(np.append(df[at], [n, words]), pa.int64())], names=["place", "n"])


def _best(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int], queries: list[tuple[int, list[int]]], idf: np.ndarray, average: float, top_k: int) -> Iterator[pa.RecordBatch]:
    """A task's best of every query."""
    known, best = _Stems(), None
    for batch in _parts(batches):
        size, row, term, tf = _hits(batch, known, vocabulary)
        weight = idf[term] * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * size[row] / average))
        first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        asked, at, scores = [], [], []
        ids = np.unique(batch.column("id").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        for query, own in queries:
            held = np.concatenate([np.arange(first[t], first[t + 1]) for t in own]) if own else np.zeros(0, np.int64)
            if not len(held):
                continue
            score = np.round(np.bincount(row[held], weight[held], batch.num_rows), 6)
            rows = np.flatnonzero(np.bincount(row[held], minlength=batch.num_rows))
            if len(rows) > top_k:
                rows = rows[np.lexsort((ids[rows], -score[rows]))[:top_k]]
            asked.append(np.full(len(rows), query))
            at.append(rows)
            scores.append(score[rows])
        if at:
            rows = pa.array(np.concatenate(at))
            found = pa.table([pa.array(np.concatenate(asked), pa.int64()), batch.column("id").take(rows), pa.array(np.concatenate(scores))], names=["query", "id", "score"])
            best = _first(found if best is None else pa.concat_tables([best, found]), top_k)
    if best is not None:
        yield from best.combine_chunks().to_batches()


def _first(found: pa.Table, top_k: int) -> pa.Table:
    """The best rows of each query."""
    found = found.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = found.column("query").to_numpy()
    return found.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query, "left") < top_k))


def bm25_batch(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query, rank from 1, id, score): the best chunks (id, content) for each of many queries (query, content).

    A query's distinct terms count once each; scores have six places and ties go by id.
    Up to ``QUERIES_A_SCAN`` queries share two scans of the chunks, one for the corpus
    statistics of their terms and one in which each task hands on its best of every
    query, so that no postings are shuffled. More queries take more such pairs of scans.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERIES_A_SCAN))
    terms = queries.select(F.col("query").cast("long").alias("query"), F.array_distinct(text.terms(F.coalesce("content", F.lit("")))).alias("t"))
    rows = _split(chunks)
    out = []
    for block in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()  # some QUERIES_A_SCAN rows
        vocabulary: dict[str, int] = {}
        own = [(r["query"], sorted({vocabulary.setdefault(text.Porter.stem(w), len(vocabulary)) for w in r["t"]})) for r in asked if r["query"] is not None]
        counts = {r["place"]: r["n"] for r in rows.mapInArrow(partial(_frequencies, vocabulary=vocabulary), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
        total, words = counts.get(-1, 0), counts.get(-2, 0)
        df = np.array([counts.get(k, 0) for k in range(len(vocabulary))], float)
        idf = np.maximum(np.log((total - df + 0.5) / (df + 0.5)), C.BM25_LEAST_IDF)
        work = partial(_best, vocabulary=vocabulary, queries=own, idf=idf, average=words / max(total, 1) or 1.0, top_k=top_k)
        out.append(rows.mapInArrow(work, f"query long, id {_id_type(chunks)}, score double"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionByName, out).withColumn("rank", place).where(F.col("rank") <= top_k).select("query", "rank", "id", "score")
