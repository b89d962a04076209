"""MinHash near-duplicate detection with HyperMinHash registers.

Each document's set of word shingles is reduced to ``BUCKETS`` registers. A register
keeps, of the smallest hash in its bucket, the count of leading zeros and ten
mantissa bits (two bytes). Each bucket hashes the whole set by a multiplier of its own
instead of taking a share of one hash: most documents have fewer shingles than would
fill 160 shares, and empty registers would cost the recall that the contract asks for. Registers are banded five by five. At a similarity of
0.85 a pair shares no band with a probability of 7e-9. Candidates pass an estimate
from their registers, corrected for registers that collide by chance, and then an
exact comparison of the full shingle sets.

Copies never multiply: documents with equal sets are folded into the one with the
smallest id before banding. Inside a band's bucket every member is first compared
with one centre only. Pairs of members that the first links leave in different
components are then all compared, so that no link between components is lost,
while members of one component are never paired again, nor pairs whose sizes and
shingles held by one set alone rule a link out.

Defined results: a null or blank text has no shingles, is linked with nothing and is
kept. A null id is its own component (null) and is kept. Rows that repeat an id
share its result when their texts have equal sets; else each row has its own set, and
the links of all of them count for the id. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import components, drop_table, map_arrow, materialise, release
from quillspark.llm.words import mix, slices, split

WORDS = 5
ROWS, BANDS = 5, 32
BUCKETS = ROWS * BANDS
MANTISSA = 10
#: An estimate from 160 registers is 5.5 standard deviations below 0.85 here; lower ones aren't verified.
SLACK = 0.155



def by_chance(n: float, m: float) -> float:
    """Expected share of registers of disjoint sets of n and m shingles that agree: both minima in one cell of zeros and mantissa."""
    edge = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(63, -1, -1)] + [[1.0]])
    inside = [-np.diff(np.exp(k * np.log1p(-np.minimum(edge, 1 - 1e-16)))) for k in (n, m)]
    return float((inside[0] * inside[1]).sum())


SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, regs binary"


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (documents x BUCKETS, two bytes each) of non-empty sorted sets h[off[i]:off[i+1]]."""
    odd = mix(np.arange(1, BUCKETS + 1).astype(np.uint64)) | np.uint64(1)
    low = np.stack([np.minimum.reduceat(h * a, off[:-1]) for a in odd], axis=1)
    fraction, exponent = np.frexp(low.astype(np.float64))  # low = fraction * 2**exponent, 0.5 <= fraction < 1
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | mantissa


def _signatures(batches, words: int):
    for batch in batches:
        for rows, data, off in slices(batch):
            w = split(data, off, fold=True)
            h, at = w.shingles(words)
            n = np.diff(at)
            full = np.flatnonzero(n)
            a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            regs: list = [None] * len(n)
            if len(full):
                begin = at[:-1][full]
                a[full] = np.add.reduceat(mix(h + np.uint64(1)), begin).view(np.int64)
                b[full] = np.bitwise_xor.reduceat(mix(h + np.uint64(2)), begin).view(np.int64)
                packed = registers(h, np.append(begin, len(h)))
                for i, r in zip(full, packed, strict=True):
                    regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "regs"])


def _sets(batches, words: int):
    """Full shingle sets as sorted 64-bit hashes."""
    for batch in batches:
        for rows, data, off in slices(batch):
            h, at = split(data, off, fold=True).shingles(words)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])


def _shared(batches):
    """How many shingles the sets of each pair have in common, and their sizes."""
    for batch in batches:
        both, size_a, size_b = [], [], []
        for x, y in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            size_a.append(len(p))
            size_b.append(len(q))
            if len(p) > len(q):
                p, q = q, p
            both.append(int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in (both, size_a, size_b))], names=["a", "b", "both", "size_a", "size_b"])


def _estimated(x: str, y: str, n: str, m: str) -> F.Column:
    """Jaccard estimate: the share of equal registers, less those that agree by chance at these sizes."""
    same = F.expr(f"aggregate(sequence(0, {BUCKETS - 1}), 0, (s, i) -> s + if(substring({x}, 2 * i + 1, 2) = substring({y}, 2 * i + 1, 2), 1, 0))")
    # by powers of two of the smaller size; pairs have similar sizes
    table = F.array(*(F.lit(by_chance(2.0**k, 2.0**k)) for k in range(41)))
    chance = F.element_at(table, F.least(F.floor(F.log2(F.greatest(F.least(n, m), F.lit(1)))).cast("int"), F.lit(40)) + 1)
    return (same / F.lit(BUCKETS) - chance) / (1 - chance)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, regs): set_a and set_b identify the set, regs holds its registers."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(_signatures, words=words), SIGNATURE)


def _opened(batches):
    """One row per shingle of each set."""
    for batch in batches:
        for rep, packed in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
            h = np.frombuffer(packed.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), rep, np.int64))], names=["shingle", "rep"])


def _sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Stored full sets (doc_id, shingles) of the ids."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return materialise(map_arrow(texts, partial(_sets, words=words), "doc_id long, shingles binary"), "sets")


def _close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose estimate allows for enough similarity."""
    regs = reps.select(F.col("rep").alias("a"), F.col("regs").alias("regs_a"), F.col("n_shingles").alias("n_a"))
    close = pairs.join(regs, "a").join(regs.select(F.col("a").alias("b"), F.col("regs_a").alias("regs_b"), F.col("n_a").alias("n_b")), "b")
    return materialise(close.where(_estimated("regs_a", "regs_b", "n_a", "n_b") >= percent / 100 - SLACK).select("a", "b"), "close")


def _compared(close: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the exact size of their intersection (both) and of their sets."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_y"))
    pairs = close.join(x, "a").join(y, "b").select("a", "b", "set_x", "set_y")
    return materialise(map_arrow(pairs, _shared, "a long, b long, both long, size_a long, size_b long"), "compared")


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id it reaches over links), kept.

    A link joins two documents with 100 * |intersection| >= percent * |union| of their
    shingle sets (distinct runs of ``words`` words, A-Z lower-cased).
    """
    spark = docs.sparkSession
    signed = materialise(signatures(docs, words), "signatures")
    identity = ["set_a", "set_b", "n_shingles", "regs"]
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*identity).agg(F.min("doc_id").alias("rep"))
    reps = materialise(reps, "reps")
    band = F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(regs, {2 * ROWS} * b + 1, {2 * ROWS})))"))
    members = reps.select("rep", "n_shingles", band.alias("band", "key")).select("rep", "n_shingles", "key")
    shared = members.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("c"), F.max("rep").alias("last")).where("c.rep < last")
    shared = materialise(shared.select("key", F.col("c.rep").alias("centre"), F.col("c.n_shingles").alias("n_centre")), "buckets")
    members = materialise(members.join(shared, "key").select("key", "centre", "n_centre", "rep", "n_shingles"), "members")
    alike = 100 * F.least("n_shingles", "n_centre") >= percent * F.greatest("n_shingles", "n_centre")  # else sizes alone rule a link out
    close = _close(members.where(alike & (F.col("rep") != F.col("centre"))).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), reps, percent)
    sets = _sets_of(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), docs, words)
    compared = _compared(close, sets)
    links = materialise(_links(compared, percent), "links")
    drop_table(sets)
    release(spark)
    parts = components(links)
    # what the stars left apart: members of a bucket in different components
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "centre", "rep", "n_shingles", F.coalesce("label", "rep").alias("label"))
    counted = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")
    main = materialise(main, "main")  # a join of its own, so that a key with many members can be split
    apart = materialise(placed.join(main, "key").where("rep <> centre").select("key", "centre", "rep", "n_shingles", "label", "main"), "apart")
    # a shingle that no other of these sets holds lies outside every intersection
    sets = _sets_of(apart.select(F.col("rep").alias("doc_id")).union(apart.select("centre")).distinct(), docs, words)
    alone = map_arrow(sets, _opened, "shingle long, rep long").groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last")
    alone = materialise(alone.groupBy("rep").agg(F.count("*").alias("own")), "alone")
    # what a set shares with the centre, where that has been counted, and what else it may share with others
    known = compared.groupBy(F.col("a").alias("rep"), F.col("b").alias("centre")).agg(F.max("both").alias("core"))
    apart = apart.join(alone, "rep", "left").join(known, ["rep", "centre"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    loose = F.when(F.col("core").isNotNull(), F.col("n_shingles") - F.col("own") - F.col("core")).otherwise(F.col("n_shingles") - F.col("own"))
    apart = materialise(apart.select("key", "rep", "label", "main", "n_shingles", "own", F.coalesce("core", "n_shingles").alias("core"), loose.alias("loose")), "apart")

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.select("key", *more, F.col("rep").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("label", "n_shingles", "own", "core", "loose")))

    few, many = side(apart.where("label <> main"), "a"), side(apart, "b", "main")
    # pairs of two outside the main component come up once, those with it once
    rule = (few["key"] == many["key"]) & (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("a") > F.col("b")))
    # both bounds of the intersection, and with the sizes of the similarity: shingles held alone lie
    # outside it, and inside the centre it is no larger than what either set shares with the centre
    least = lambda c: F.least(f"{c}_a", f"{c}_b")
    most = F.least(F.col("n_shingles_a") - F.col("own_a"), F.col("n_shingles_b") - F.col("own_b"), least("core") + least("loose"))
    rule &= 100 * most >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - most)
    rest = few.join(many, rule).select("a", "b").distinct()
    more = materialise(_links(_compared(_close(rest, reps, percent), sets), percent), "links")
    if not more.isEmpty():
        parts = components(links.union(more))
    drop_table(sets)
    release(spark)
    # representatives pass their component on to the copies of their set
    classes = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*identity[:3], "rep", F.coalesce("label", "rep").alias("label"))
    whole = signed.select("doc_id", *identity[:3]).join(classes, identity[:3], "left")
    best = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    whole = whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), best).alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
