"""Exact removal of long repeated spans by compacting a De Bruijn graph of token k-mers.

Every run of ``SPAN`` words is an edge. Writing all edges to a shuffle would cost several
times the input, so runs of consecutive edges are read as paths at once: edges that share the
same anchor (the ``ANCHOR``-word run with the smallest hash inside the edge) form one path,
known by its words' hash and by where it stands (document, first word, count of words).
Equal edges have equal anchors, so whatever repeats meets under its anchor.

1. Anchors that only one document holds can't repeat; a join drops their paths.
2. Degrees: of each path that repeats, the distinct paths before and after it over all its
   occurrences. Joined back to the occurrences they tell which links don't branch, and paths
   along such links compact into one span of each document, owned by its smallest document.
3. Where paths part within an anchor, the first occurrence of each is opened into its edges
   again, at their coordinates; each edge belongs to the smallest document that has it.
4. The words at the coordinates of all spans and opened edges are read from the source text
   and digested (128 bits). What repeats by its digest is verified; a span whose occurrences
   differ, as hashes that clash would make it, is opened into edges as well.
5. In every document the words go that lie in a span or an edge that a smaller document owns.

Words are kept as they are. Defined results: null and blank texts have no words; texts of
fewer than ``SPAN`` words lose none; rows with a null id are kept whole and are no source;
repetition within an id alone removes nothing; rows that repeat an id are each judged
against smaller ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.runtime import drop_table, map_arrow, materialise, release
from quillspark.llm.words import _BASE, _powers, mix, rolled, slices, split

SPAN, ANCHOR = 13, 6


def paths(w, span: int, anchor: int):
    """Compacted paths of some documents' words: anchor key, path key, document, and window arrays.

    Returns (akey, skey, doc, begin, at, per): ``at`` is the first word of each window, ``per``
    the offsets of windows by document, ``begin`` the offset of each path's first window.
    """
    n = w.counts
    per = np.concatenate(([0], np.cumsum(np.maximum(n - span + 1, 0))))
    at = np.arange(per[-1]) + np.repeat(w.first[:-1] - per[:-1], np.diff(per))
    none = np.zeros(0, np.uint64)
    if not len(at):
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64), at, per
    keys = rolled(w.hash, anchor)
    gap = span - anchor + 1
    low = keys[at]
    for j in range(1, gap):
        low = np.minimum(low, keys[at + j])
    where = at.copy()
    for j in range(gap - 1, -1, -1):
        where[keys[at + j] == low] = at[keys[at + j] == low] + j
    doc = np.repeat(np.arange(len(n)), np.diff(per))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(at)) - 1
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * _powers(len(w.hash), _BASE), out=total[1:])
    lo, hi = at[begin], at[last] + span
    skey = mix((total[hi] - total[lo]) * _powers(len(w.hash) + 1, pow(_BASE, -1, 1 << 64))[lo] + (hi - lo).astype(np.uint64))
    return low[begin], skey, doc[begin], begin, at, per


def _anchors(batches, span: int, anchor: int):
    """Anchors of each document, each once."""
    for batch in batches:
        for rows, data, off in slices(batch):
            akey, _, doc, *_ = paths(split(data, off), span, anchor)
            order = np.lexsort((akey, doc))
            akey, doc = akey[order], doc[order]
            once = np.ones(len(doc), bool)
            once[1:] = (akey[1:] != akey[:-1]) | (doc[1:] != doc[:-1])
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)[doc[once]]
            yield pa.RecordBatch.from_arrays([pa.array(akey[once].view(np.int64)), pa.array(ids)], names=["akey", "doc_id"])


def _paths(batches, span: int, anchor: int):
    """All paths with their places: the first word and the count of words in one number."""
    for batch in batches:
        for rows, data, off in slices(batch):
            w = split(data, off)
            akey, skey, doc, begin, at, _ = paths(w, span, anchor)
            size = np.diff(np.append(begin, len(at))) + span - 1
            first = at[begin] - w.first[doc] if len(doc) else doc
            columns = [akey.view(np.int64), skey.view(np.int64), *(rows.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "copy")), (first << 32) | size]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["akey", "skey", "doc_id", "copy", "place"])


def _told(batches, span: int):
    """Digests of the words at the asked places: one row per span (head not null) and per edge of an opened place."""
    names = ["doc_id", "copy", "head", "begin", "stop", "d1", "d2"]
    for batch in batches:
        for i, (text, doc, copy) in enumerate(zip(*(batch.column(c) for c in ("text", "doc_id", "copy")), strict=True)):
            words = text.as_py().encode().split()  # bytes split at 0x20 and 0x09-0x0D
            heads, begins, stops, parts = [], [], [], []
            for s in batch.column("spans")[i].as_py() or []:
                heads.append(s["head"])
                begins.append(s["begin"])
                stops.append(s["stop"])
            for s in batch.column("opened")[i].as_py() or []:
                n = s["stop"] - s["begin"] - span + 1
                heads += [None] * n
                begins += range(s["begin"], s["begin"] + n)
                stops += range(s["begin"] + span, s["stop"] + 1)
            for a, b in zip(begins, stops, strict=True):
                parts.append(hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest())
            digest = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
            n = len(begins)
            columns = [pa.array([doc.as_py()] * n, pa.int64()), pa.array([copy.as_py()] * n, pa.int64()), pa.array(heads, pa.int64()), pa.array(begins, pa.int32()), pa.array(stops, pa.int32()), *(pa.array(digest[:, k]) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _cut(batches, with_text: bool):
    """Each document without the words of its ``gone`` places."""
    for batch in batches:
        n_words, n_removed, digest, text = [], [], [], []
        for value, places in zip(batch.column("text"), batch.column("gone"), strict=True):
            words = (value.as_py() or "").encode().split()
            n_words.append(len(words))
            change = np.zeros(len(words) + 1, np.int64)
            if places.is_valid and len(places.values):
                np.add.at(change, places.values.field("begin").to_numpy(), 1)
                np.add.at(change, places.values.field("stop").to_numpy(), -1)
                words = list(compress(words, np.cumsum(change[:-1]) == 0))
            joined = b" ".join(words)
            n_removed.append(n_words[-1] - len(words))
            digest.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                text.append(joined.decode())
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string())] if with_text else columns, names=[*names, "kept_text"] if with_text else names)


_ROW = ["doc_id", "copy"]


def _places(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Places of each document in one array."""
    return rows.groupBy(*_ROW).agg(F.collect_list(F.struct(*columns)).alias(name))


def _compacted(found: DataFrame, nodes: DataFrame, span: int) -> DataFrame:
    """Spans (doc_id, copy, head, begin, stop, owner): runs of repeated paths along links that don't branch."""
    rows = found.join(nodes.select("akey", "skey", "before", "after", "owner"), ["akey", "skey"]).select(*_ROW, "skey", "before", "after", "owner", F.shiftright("place", 32).cast("int").alias("begin"), F.expr("cast(place & 4294967295 as int)").alias("n"))
    rows = rows.withColumn("stop", F.col("begin") + F.col("n"))
    order = Window.partitionBy(*_ROW).orderBy("begin")
    linked = (F.lag("stop").over(order) - (span - 1) == F.col("begin")) & (F.lag("after").over(order) == F.col("skey")) & (F.col("before") == F.lag("skey").over(order))
    rows = rows.withColumn("fresh", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # all paths of a run have the same documents, hence one owner
    return rows.groupBy(*_ROW, "run").agg(F.max(F.when(F.col("fresh") == 1, F.col("skey"))).alias("head"), F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.min("owner").alias("owner")).drop("run")


def remove_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if a run of ``span`` words covers it whose words also start in a document
    with a smaller id; the words left are joined by single spaces.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null and text is not null")
    # places are words of a text, so texts that share an id have to be told apart
    again = not known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    copy = (F.coalesce(F.xxhash64("text"), F.lit(0)) if again else F.lit(0)).cast("long")
    known, docs = known.withColumn("copy", copy), docs.withColumn("copy", copy)
    how = {"span": span, "anchor": anchor}
    held = map_arrow(known.select("doc_id", "text"), partial(_anchors, **how), "akey long, doc_id long")
    held = held.groupBy("akey").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("akey")
    repeated = materialise(held, "anchors")
    release(spark)
    found = map_arrow(known, partial(_paths, **how), "akey long, skey long, doc_id long, copy long, place long")
    found = materialise(found.join(repeated, "akey", "left_semi"), "paths")
    release(spark)
    # degrees: the paths next to each path, where there is but one on all its occurrences
    order = Window.partitionBy(*_ROW).orderBy("place")
    begin, stop = F.shiftright("place", 32), F.shiftright("place", 32) + F.expr("place & 4294967295")
    near = found.select("akey", "skey", "doc_id", F.when(F.lag(stop).over(order) - (span - 1) == begin, F.lag("skey").over(order)).alias("before"), F.when(F.lead(begin).over(order) == stop - (span - 1), F.lead("skey").over(order)).alias("after"))
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c)
    nodes = materialise(near.groupBy("akey", "skey").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), only("before"), only("after")), "nodes")
    release(spark)
    spans = materialise(_compacted(found, nodes.where("owner < last"), span), "spans")
    release(spark)
    branching = nodes.groupBy("akey").agg(F.count("*").alias("n")).where("n > 1").select("akey")
    first = nodes.join(branching, "akey", "left_semi").select("akey", "skey", F.col("owner").alias("doc_id"))
    opened = found.join(first, ["akey", "skey", "doc_id"], "left_semi").select(*_ROW, F.shiftright("place", 32).cast("int").alias("begin"), stop.cast("int").alias("stop"))
    asked = _places(spans, "spans", "head", "begin", "stop").join(_places(opened, "opened", "begin", "stop"), _ROW, "full_outer")
    asked = materialise(asked, "asked")
    for used in (repeated, found, nodes):
        drop_table(used)
    release(spark)
    schema = "doc_id long, copy long, head long, begin int, stop int, d1 long, d2 long"
    told = materialise(map_arrow(known.join(asked, _ROW).select("text", *_ROW, "spans", "opened"), partial(_told, span=span), schema), "told")
    release(spark)
    heads = told.where("head is not null").groupBy("head").agg(F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2"))
    unlike = materialise(heads.where("a1 <> b1 or a2 <> b2").select("head"), "unlike")
    edges = told.where("head is null")
    sure = spans.where("doc_id > owner")
    if not unlike.isEmpty():  # hashes that clash
        sure = sure.join(unlike, "head", "left_anti")
        rest = _places(spans.join(unlike, "head", "left_semi"), "opened", "begin", "stop").withColumn("spans", F.expr("cast(null as array<struct<head: long, begin: int, stop: int>>)"))
        edges = edges.unionByName(map_arrow(known.join(rest, _ROW).select("text", *_ROW, "spans", "opened"), partial(_told, span=span), schema))
    first = materialise(edges.groupBy("d1", "d2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("d1", "d2", "owner"), "first")
    later = edges.join(first, ["d1", "d2"]).where("doc_id > owner").select(*_ROW, "begin", "stop")
    gone = materialise(_places(sure.select(*_ROW, "begin", "stop").unionByName(later), "gone", "begin", "stop"), "gone")
    for used in (spans, asked, told, unlike, first):
        drop_table(used)
    release(spark)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_arrow(docs.join(gone, _ROW, "left").select("doc_id", "text", "gone"), partial(_cut, with_text=with_text), schema)


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM k),
own AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN own USING (s) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.pos) AS s, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
