"""Fuzzy line dedup by MinHash over character shingles.

Lines are compared lower-cased and trimmed. Equal ones fold first, by their text. A line's
set is its distinct runs of five characters. Each point of its signature is the minimum of
all its shingles' hashes under a multiplier of its own; lines that agree on all six points
of one of 26 bands are candidates. Lines at a similarity of 0.8 share no band with a
probability of 0.2 %, those at 0.85 of 0.01 %, and lines at 0.1, as any two of one language
are, share one in 40,000 pairs, so that few candidates come from unlike lines.

Candidates are verified by the exact Jaccard similarity of both sets: every member of a
bucket with its first line, then all members of the buckets that hold several components
still: pairs of up to 64 lines are listed, each once, and intersections in larger buckets come
from products of incidence matrices, so that pairs of a group of copies never become rows.
Shingles of a pair are compared as their characters, packed into integers, without hashes.
Union-find keeps one line of each component, the first.

Splitting, folding, joins and components are DataFrame operations. Signatures and
verification run on Arrow batches: hashing every shingle with Spark's expressions takes
more than this operator's whole budget of CPU time (see the README).

Defined results: blank lines aren't compared and stay; lines under five characters have
themselves as their one shingle; null and empty texts have no lines. A null id sorts before
others. Repeated rows are documents of their own, in the order Spark numbers them. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import components, drop_table, map_arrow, materialise, release
from quillspark.llm.words import mix, raw, rolled

SHINGLE, THRESHOLD_PERCENT = 5, 80
#: Points stand in a grid of ROWS rows and WIDE columns (a prime). A band takes one point of each row along a
#: line through the grid, so two bands share one point at most.
ROWS, WIDE, SLOPES = 6, 13, 2
BANDS = WIDE * SLOPES
_SLICE = 1 << 17  # bytes of lines worked on at a time
#: Lines of a bucket whose pairs are listed.
_PAIRED = 64
#: Lines of a larger bucket that meet all others at a time, and shingles of them that a matrix has columns for.
_MEMBERS, _WIDTH = 1024, 4096
#: Lines of a block, whose numbers fit 16 bits; bytes of band keys that a task sorts at a time.
_BLOCK, _PART = 1 << 16, 8 << 20
#: Ranges of hashes that a line's shingles are counted by.
_RANGES = 128
_U = np.uint64


def _codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines data[off[i]:off[i+1]] (UTF-8), and offsets by line."""
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))[off].astype(np.int64)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), at


def _short(h: np.ndarray, first: np.ndarray, codes: np.ndarray, at: np.ndarray) -> None:
    """Lines under SHINGLE characters have one hash of the whole; ``first`` has its place."""
    for i in np.flatnonzero(np.diff(at) < SHINGLE):
        own = hashlib.blake2b(codes[at[i] : at[i + 1]].tobytes(), digest_size=h.itemsize).digest()
        h[first[i]] = int.from_bytes(own, "little")


def _windows(h: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes at each character those of runs inside one line, and offsets by line."""
    n = np.diff(at)
    inside = np.ones(len(codes), bool)
    for back in range(1, SHINGLE):  # a line's last characters start no run, but a short line's first stands for it
        inside[(at[1:] - back)[n > back]] = False
    take = np.maximum(n - SHINGLE + 1, 1)
    first = np.concatenate(([0], np.cumsum(take)))
    h = h[inside]
    _short(h, first, codes, at)
    return h, first


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of lines (not empty), and offsets by line."""
    codes, at = _codes(data, off)
    wide = (codes.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    return _windows(rolled(wide ^ (wide >> _U(29)), SHINGLE), codes, at)


def _points() -> np.ndarray:
    return (mix(np.arange(1, ROWS * WIDE + 1).astype(_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def band_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Keys of 48 bits (lines x BANDS), from the 32-bit hashes of all shingles of lines (not empty)."""
    codes, at = _codes(data, off)
    x = codes * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    h, done = x.copy(), 1
    while done < SHINGLE:
        h[: len(h) - done] = h[: len(h) - done] * np.uint32(0x85EBCA77) + x[done:]
        done += 1
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    # from a line's first run to its last, and what lies between them, which isn't used; a short line links with nothing
    spans = np.stack((at[:-1], np.maximum(at[1:] - SHINGLE + 1, at[:-1] + 1)), 1).ravel()
    h = np.append(h, np.uint32(0))
    turned = np.empty_like(h)
    low = np.stack([np.minimum.reduceat(np.multiply(h, m, out=turned), spans)[::2] for m in _points()]).astype(_U)
    slope, from_ = np.divmod(np.arange(BANDS), WIDE)
    keys = np.arange(1, BANDS + 1).astype(_U)[:, None]
    for r in range(ROWS):
        keys = mix(keys + low[r * WIDE + (from_ + slope * r) % WIDE])
    return (keys >> _U(16)).T


def _packed(codes: np.ndarray, at: np.ndarray, spare: int) -> np.ndarray | None:
    """The run of characters at each code point, as integers below ``2**(64 - spare)``, or None if they don't fit.

    Characters are numbered from 1 in the order of code points, so that unlike runs have unlike
    integers; a short line's run is filled up with zeros. What starts no run is all ones.
    """
    held = np.zeros(int(codes.max()) + 1, bool)
    held[codes] = True
    number = np.cumsum(held).astype(_U)
    bits = int(number[-1]).bit_length()
    if bits * SHINGLE + spare > 64:
        return None
    x = number.take(codes)
    run, turned = x.copy(), np.empty_like(x)
    for k in range(1, SHINGLE):
        np.left_shift(run, _U(bits), out=turned)
        run, turned = turned, run
        run[:-k] |= x[k:]
    n = np.diff(at)
    short = n < SHINGLE
    drop = (bits * (SHINGLE - n[short])).astype(_U)
    run[at[:-1][short]] = run[at[:-1][short]] >> drop << drop
    for back in range(1, SHINGLE):  # a line's last characters start no run, but a short line's first stands for it
        run[(at[1:] - back)[n > back]] = _U((1 << 64) - 1)
    return run


def _pieces(batch: pa.RecordBatch, columns: tuple[str, ...], size: int = _SLICE):
    """(first row, end row) of parts of a batch whose texts have about ``size`` bytes."""
    ends = sum(raw(batch.column(c))[1] for c in columns)
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        yield row, stop
        row = stop


SIGNED = "part int, base long, entries binary, heads binary"


def _signed(batches, parts: int):
    """Blocks of band keys, sorted and cut by part: entries hold a key's 48 bits and the line's number after ``base``.

    Of the lines of a block that share a key the first one alone goes to the key's part. The
    others' entries, with their ``heads``, are members whose centre that line is; they travel
    to parts that depend on the block alone, so no key's rows gather in one task.
    """

    def told(base: int, held: list):
        keys = np.concatenate(held)
        entries = np.sort(((keys << _U(16)) | np.arange(len(keys)).astype(_U)[:, None]).ravel())
        key = entries >> _U(16)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads = entries[new]
        part = (key[new] >> _U(16)) * _U(parts) >> _U(32)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        rows = [(int(part[a]), heads[a:b].tobytes(), None) for a, b in zip(cuts, np.append(cuts[1:], len(heads)), strict=True)]
        if not new.all():
            at = np.flatnonzero(new)[np.cumsum(new) - 1][~new]
            rows.append((base % parts, entries[~new].tobytes(), (entries[at] & _U(0xFFFF)).astype(np.uint16).tobytes()))
        part, entries, heads = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([base] * len(rows), pa.int64()), pa.array(entries, pa.binary()), pa.array(heads, pa.binary())], names=["part", "base", "entries", "heads"])

    base, held, n = 0, [], 0
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(ids) != 1) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(ids)), strict=True):
            run = batch.slice(int(lo), int(hi - lo))
            for a, b in _pieces(run, ("line",)):
                if n and (ids[lo + a] != base + n or n + b - a > _BLOCK):
                    yield told(base, held)
                    held, n = [], 0
                base = int(ids[lo + a]) - n
                held.append(band_keys(*raw(run.column("line").slice(a, b - a))))
                n += b - a
    if n:
        yield told(base, held)


def _buckets(batches):
    """Members (key, centre, id) of the keys that more than one line has, from blocks sorted by part."""

    def rows(key, centre, ident):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (key, centre, ident)], names=["key", "centre", "id"])

    def settled(held: list):
        entries, ids = (np.concatenate(c) for c in zip(*held, strict=True))
        key = entries >> _U(16)
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(heads, len(key)))
        shared = np.repeat(size > 1, size)
        return rows(key[shared], np.repeat(np.minimum.reduceat(ids, heads), size)[shared], ids[shared])

    part, held = None, []
    for batch in batches:
        for p, base, entries, heads in zip(*(batch.column(c) for c in ("part", "base", "entries", "heads")), strict=True):
            e, base = np.frombuffer(entries.as_buffer(), _U), base.as_py()
            ids = base + (e & _U(0xFFFF)).astype(np.int64)
            if heads.is_valid:
                yield rows(e >> _U(16), base + np.frombuffer(heads.as_buffer(), np.uint16).astype(np.int64), ids)
                continue
            if held and p.as_py() != part:
                yield settled(held)
                held = []
            part = p.as_py()
            held.append((e, ids))
    if held:
        yield settled(held)


def _sizes(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Of each pair of lines the sizes of the intersection of their shingle sets and of both sets (3 x pairs)."""
    n = len(x)
    sides = [_codes(*raw(c)) for c in (x, y)]
    codes = np.concatenate([c for c, _ in sides])
    at = np.concatenate((sides[0][1], sides[1][1][1:] + len(sides[0][0])))
    spare = max(n - 1, 0).bit_length() + 1
    run = _packed(codes, at, spare)
    if run is None and n > 1:  # many characters: fewer pairs at a time
        return np.concatenate([_sizes(*(c.slice(k, n - n // 2) for c in (x, y))) for k in (0, n - n // 2)], 1)
    if run is None:
        sets = [set(shingles(*raw(c))[0].tolist()) for c in (x, y)]
        return np.array([[len(sets[0] & sets[1])], [len(sets[0])], [len(sets[1])]], np.int32)
    pair = np.tile(np.arange(n).astype(_U) << _U(64 - spare + 1), 2)
    own = np.repeat(pair, np.diff(at))
    # pair, run and side from the highest bit on, so that one sort brings equal runs of a pair together
    starts = run != _U((1 << 64) - 1)
    run = (run << _U(1)) | own
    run[len(sides[0][0]) :] |= _U(1)
    run = np.sort(run[starts])
    run = run[np.concatenate(([True], run[1:] != run[:-1]))]
    of = (run >> _U(64 - spare + 1)).astype(np.int64) if spare > 1 else np.zeros(len(run), np.int64)
    second = (run & _U(1)).astype(bool)
    again = np.flatnonzero((run[1:] ^ run[:-1]) == 1)
    again = again[~second[again]]
    return np.stack([np.bincount(i, minlength=n) for i in (of[again], of[~second], of[second])]).astype(np.int32)


def _compared(batches):
    """Sizes of both shingle sets of each pair of lines, and of their intersection."""
    for batch in batches:
        for a, b in _pieces(batch, ("x", "y")):
            sizes = _sizes(*(batch.column(c).slice(a, b - a) for c in ("x", "y")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("a", "b")), *map(pa.array, sizes)], names=["a", "b", "both", "n_a", "n_b"])


def _sketched(batches):
    """Of each line the number of its shingles, and the counts by range of their hashes where all fit a byte."""
    for batch in batches:
        for a, b in _pieces(batch, ("line",)):
            for lo in range(a, b, 4096):
                ids, lines = (batch.column(c).slice(lo, min(b - lo, 4096)) for c in ("id", "line"))
                h, off = shingles(*raw(lines))
                h = np.sort((h >> _U(12)) | np.repeat(np.arange(len(ids)).astype(_U) << _U(52), np.diff(off)))
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
                of = (h >> _U(52)).astype(np.int64) * _RANGES + (mix(h & _U((1 << 52) - 1)) % _U(_RANGES)).astype(np.int64)
                counts = np.bincount(of, minlength=len(ids) * _RANGES).reshape(len(ids), _RANGES)
                told = [c.tobytes() if fine else None for c, fine in zip(counts.astype(np.uint8), counts.max(1) < 256, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts.sum(1), pa.int32()), pa.array(told, pa.binary())], names=["id", "n", "counts"])


def _possible(batches, percent: int):
    """The pairs whose intersection may be large enough; one more is granted, for hashes that meet."""
    for batch in batches:
        x, y = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_x", "n_y"))
        most = np.minimum(x, y)
        told = np.flatnonzero(batch.column("x").is_valid().to_numpy(zero_copy_only=False) & batch.column("y").is_valid().to_numpy(zero_copy_only=False))
        if len(told):
            c, d = (np.frombuffer(raw(batch.column(k).take(pa.array(told)))[0], np.uint8).reshape(-1, _RANGES) for k in ("x", "y"))
            most[told] = np.minimum(c, d).sum(1, dtype=np.int64)
        most += 1
        fine = pa.array(100 * most >= percent * (x + y - most))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(fine) for c in ("a", "b")], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that may be links, with the sizes of their sets (n_a, n_b) and of the intersection (both)."""
    x, y = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{k}"), F.col("counts").alias(k)) for c, k in (("a", "x"), ("b", "y")))
    near = map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "n_x", "n_y", "x", "y"), partial(_possible, percent=percent), "a long, b long")
    rows = near.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    out = materialise(map_arrow(rows.select("a", "b", "x", "y"), _compared, "a long, b long, both int, n_a int, n_b int"), "compared")
    release(texts.sparkSession)
    return out


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _crossed(batches, percent: int):
    """Links (a, b) between members of a group in different components, from rows sorted by group.

    Intersections of all pairs come from products of the group's incidence matrix, a range of
    shingles at a time; no pair becomes a row unless it is a link.
    """

    def settled(rows: list):
        _, left, right, ids, labels, few, block, lines = (list(c) for c in zip(*rows, strict=True))
        h, off = shingles(*raw(pa.array(lines, pa.string())))
        order = np.argsort(h)
        rank = np.empty(len(h), _U)
        rank[order] = np.cumsum(np.concatenate(([0], h[order][1:] != h[order][:-1]))).astype(_U)
        held = np.unique((rank << _U(32)) | np.repeat(np.arange(len(ids)).astype(_U), np.diff(off)))
        rank, member = (held >> _U(32)).astype(np.int64), (held & _U(0xFFFFFFFF)).astype(np.int64)
        size = np.bincount(member, minlength=len(ids))
        shared = np.bincount(rank)[rank] > 1
        rank, member = rank[shared], member[shared]
        column = np.cumsum(np.concatenate(([0], rank[1:] != rank[:-1]))) if len(rank) else rank
        few = np.flatnonzero(few)
        both = np.zeros((len(few), len(ids)), np.float32)
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + _WIDTH, _WIDTH)) if len(column) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = np.zeros((len(ids), _WIDTH), np.float32)
            part[member[lo:hi], column[lo:hi] % _WIDTH] = 1
            both += part[few] @ part.T
        labels, block, ids = np.array(labels), np.array(block), np.array(ids)
        fine = 100 * both >= percent * (size[few][:, None] + size[None, :] - both)
        fine &= labels[few][:, None] != labels[None, :]
        if left[0] != right[0]:  # pairs inside a block meet in the block's own group
            fine &= block[few][:, None] != block[None, :]
        x, y = np.nonzero(fine)
        return pa.RecordBatch.from_arrays([pa.array(ids[few[x]], pa.int64()), pa.array(ids[y], pa.int64())], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "left", "right", "id", "label", "few", "block", "line")), strict=True):
            if row[:3] != now and rows:
                yield settled(rows)
                rows = []
            now = row[:3]
            rows.append(row)
    if rows:
        yield settled(rows)


def _starred(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members and their buckets' first lines."""
    return members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()


def _apart(members: DataFrame, parts: DataFrame, texts: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that the first ones have left in different components.

    Of a bucket of up to ``_PAIRED`` lines the pairs are compared that haven't been, each once
    however many buckets share it. The members of a larger one meet in groups of two of its
    blocks; a block has about ``_MEMBERS`` lines, so no bucket is too large for a task.
    """
    placed = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")).distinct()
    counted = placed.groupBy("key", "label").agg(F.count("*").alias("m"))
    main = counted.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels"), F.sum("m").alias("m")).where("labels > 1").select("key", "main", "m")
    main = materialise(main, "main")  # a join of its own, so that a key with many members can be split
    apart = materialise(placed.join(main, "key").select("key", "id", "label", (F.col("label") != F.col("main")).alias("few"), "m"), "apart")
    few, rest = (apart.where(f"m <= {_PAIRED}").select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "label", "few"))) for k in "xy")
    pairs = few.where("few_x").join(rest, "key").where("label_x <> label_y").select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()
    pairs = pairs.join(_starred(members).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    near = _links(_verified(pairs, texts, sketches, percent), percent)
    large = apart.where(f"m > {_PAIRED}").withColumn("blocks", F.ceil(F.col("m") / _MEMBERS).cast("int"))
    rows = large.join(texts.select("id", "line"), "id").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "id", "label", "few", "block", "line")
    rows = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    out = materialise(map_arrow(rows, partial(_crossed, percent=percent), "a long, b long").union(near).distinct(), "links")
    drop_table(apart)
    release(texts.sparkSession)
    return out


def lines_of(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per line: _row (its document's number), doc_id, pos, label of its component and kept."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("doc_id", "_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.lower(F.trim("line")))
    filled, digest = F.col("line").rlike(r"\S"), F.unhex(F.md5("line"))
    lines = materialise(rows.select("doc_id", "_row", "pos", F.when(filled, digest).alias("digest")), "lines")
    unique = rows.where(filled).select(digest.alias("digest"), "line").distinct()
    unique = materialise(unique.withColumn("id", F.monotonically_increasing_id()), "unique")
    release(spark)
    parts = max(1, -(-unique.count() * BANDS * 8 // _PART))
    signed = map_arrow(unique.select("id", "line"), partial(_signed, parts=parts), SIGNED)
    members = map_arrow(signed.repartition(parts, "part").sortWithinPartitions("part"), _buckets, "key long, centre long, id long")
    members = materialise(members, "members")
    release(spark)
    # what candidates need from here on, in place of all texts
    ids = members.select("id").union(members.select("centre")).distinct()
    texts = materialise(unique.join(ids, "id", "left_semi"), "texts")
    drop_table(unique)
    release(spark)
    sketches = materialise(map_arrow(texts.select("id", "line"), _sketched, "id long, n int, counts binary"), "sketches")
    links = materialise(_links(_verified(_starred(members), texts, sketches, percent), percent), "links")
    parts = components(links)
    more = _apart(members, parts, texts, sketches, percent)
    if not more.isEmpty():
        parts = components(links.union(more))
    drop_table(members)
    release(spark)
    # from the numbers of unlike texts to their digests, which occurrences carry
    named = texts.select("id", "digest").join(parts.withColumnRenamed("node", "id"), "id")
    named = named.select("digest", "label").join(texts.select(F.col("id").alias("label"), F.col("digest").alias("name")), "label").select("digest", "name")
    placed = lines.join(named, "digest", "left").select("doc_id", "_row", "pos", F.coalesce("name", "digest").alias("label"))
    placed = materialise(placed, "placed")
    kept = materialise(placed.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "_row", "pos")).alias("first")), "kept")
    same = (F.col("first._row") == F.col("_row")) & (F.col("first.pos") == F.col("pos"))
    return placed.join(kept, "label", "left").select("_row", "doc_id", "pos", "label", F.coalesce(same, F.lit(True)).alias("kept"))


def line_dedup(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_lines (not blank), n_removed and the positions removed, from 0."""
    found = lines_of(docs, percent).groupBy("_row", "doc_id").agg(F.count("label").alias("n_lines"), F.count(F.when(~F.col("kept"), 1)).alias("n_removed"), F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("pos")))).alias("removed"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
