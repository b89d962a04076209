"""Exact nearest vectors by cosine distance, from stored blocks that a search may skip.

``build`` stores vectors by block: each goes to the nearest of a few centres, in a folder
of its own per block, with a table of the blocks' centres and radii. On the unit sphere a
block of centre c and radius r has nothing nearer to a query q than ``|q - c| - r``. A
search reads the nearest blocks until they hold k vectors, takes their k-th distance, and
then only blocks whose bound is within it; Spark prunes the others' folders. In a block,
matrix products over Arrow batches leave the rows that may be among the k nearest, which
the expression of ``vectors.cosine_distance`` then measures. So results equal a search of
all rows, distances and ties included, whatever the centres are.

Centres start as the vectors with the smallest hashes of their ids, at most ``blocks`` of
them (``MOST_BLOCKS`` at most, so that the table fits the driver), and move to their
blocks' means ``rounds`` times. This bounds memory and says nothing of results.

Defined results: null and zero vectors and those with a null component are no one's
neighbours and aren't stored. Vectors of another length than the index's ``dim`` aren't
either. Vectors that have no place on the sphere (a component that isn't finite, a norm
beyond 1e150 or below 1e-145) stand in block -1, which is always read. Rows that repeat an
id stay apart. A zero query finds nothing. Extra columns are ignored. Building again into
the same folder replaces what is there.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine_distance

log = logging.getLogger(__name__)
MOST_BLOCKS = 4096
#: More than rounding can move a distance of unit vectors, or its square root near zero.
SLACK = 1e-6
ODD = -1
#: Squared norms within these bounds neither overflow nor lose digits.
LEAST, MOST = 1e-290, 1e300


def _matrix(batch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of ``dim`` known components, and these as doubles."""
    column = batch.column("vector")
    known = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(known)).flatten()
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
        known = known[whole]
        flat = column.take(pa.array(known)).flatten()
    return known, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("ij,ij->i", x, x)


def _screen(batches, query: np.ndarray, k: int):
    """Rows that may be among the k nearest of those seen in this task; a bound on the k-th distance is all that is kept."""
    size, best = np.sqrt(query @ query), np.zeros(0)
    for batch in batches:
        rows, x = _matrix(batch, len(query))
        n = _squares(x)
        sound = (n > LEAST) & (n < MOST)
        far = np.full(len(x), -np.inf)  # what isn't measured here stays in
        with np.errstate(invalid="ignore", over="ignore"):
            far[sound] = 1 - (x[sound] @ query) / (np.sqrt(n[sound]) * size)
        best = np.append(best, far[sound])
        if len(best) > k:
            best = np.partition(best, k - 1)[:k]
        within = best.max() + SLACK if len(best) == k else np.inf
        keep = rows[(far <= within) & (n != 0)]
        if len(keep):
            yield batch.take(pa.array(keep))


def screened(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance) of the k nearest of all rows (id, vector), by matrix products over Arrow batches."""
    near, q = vectors.select("id", "vector"), np.asarray(query, np.float64)
    if k <= 0 or not q.any():
        return near.select("id", F.lit(None).cast("double").alias("distance")).limit(0)
    if LEAST < _squares(q[None])[0] < MOST:
        near = near.mapInArrow(partial(_screen, query=q, k=k), near.schema)
    near = near.select("id", cosine_distance(F.col("vector"), query).alias("distance"))
    return near.where("distance is not null").orderBy("distance", "id").limit(k)


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector and the distance to it."""
    block = np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)
    return block, np.sqrt(_squares(x - centres[block]))


def _place(batches, centres: np.ndarray, dim: int):
    """Rows with their block and their distance to its centre."""
    for batch in batches:
        rows, x = _matrix(batch, dim)
        n = _squares(x)
        rows, x, n = rows[n != 0], x[n != 0], n[n != 0]
        sound = (n > LEAST) & (n < MOST)
        block, off = np.full(len(x), ODD, np.int32), np.zeros(len(x))
        if sound.any() and len(centres):
            block[sound], off[sound] = _nearest_centre(x[sound] / np.sqrt(n[sound])[:, None], centres)
        out = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([out.column("id"), out.column("vector"), pa.array(off), pa.array(block)], names=["id", "vector", "off", "block"])


def _sums(batches, centres: np.ndarray, dim: int):
    """Per task one sum and count for each centre that has vectors."""
    total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
    for batch in batches:
        _, x = _matrix(batch, dim)
        n = _squares(x)
        sound = (n > LEAST) & (n < MOST)
        if sound.any():
            x = x[sound] / np.sqrt(n[sound])[:, None]
            block, _ = _nearest_centre(x, centres)
            order = np.argsort(block, kind="stable")
            some, first = np.unique(block[order], return_index=True)
            total[some] += np.add.reduceat(x[order], first)
            count += np.bincount(block, minlength=len(centres))
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["block", "n", "total"])


def _first_centres(vectors: DataFrame, dim: int, blocks: int) -> np.ndarray:
    rows = vectors.where(F.size("vector") == dim).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    rows = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(blocks).select("vector").collect()
    x = np.array([r["vector"] for r in rows], np.float64).reshape(-1, dim)
    n = _squares(x)
    sound = (n > LEAST) & (n < MOST)
    return np.unique(x[sound] / np.sqrt(n[sound])[:, None], axis=0)


def build(vectors: DataFrame, path: str, dim: int, blocks: int = 256, rounds: int = 3) -> Blocks:
    """Stores (id, vector) by block under ``path``, for searches with queries of ``dim`` components."""
    if not 0 < blocks <= MOST_BLOCKS:
        raise ValueError(f"blocks must be from 1 to {MOST_BLOCKS}")
    spark, rows = vectors.sparkSession, vectors.select("id", "vector")
    centres = _first_centres(rows, dim, blocks)
    for _ in range(rounds if len(centres) else 0):
        sums = rows.mapInArrow(partial(_sums, centres=centres, dim=dim), "block int, n long, total array<double>")
        parts = sums.select("block", "n", F.posexplode("total").alias("i", "x")).groupBy("block", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        means = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", F.col("x") / F.col("n")))).alias("mean"))
        for r in means.collect():  # a row per block, a value per component
            centres[r["block"]] = [x for _, x in r["mean"]]
    placed = rows.mapInArrow(partial(_place, centres=centres, dim=dim), f"id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, off double, block int")
    # files of even size: a block with many rows is written by several tasks
    placed.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    held = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "block int, centre array<double>")
    counted = held.groupBy("block").agg(F.max("off").alias("radius"), F.count("*").alias("n"))
    typed = F.lit(None).cast(placed.schema).alias("row")  # no rows leave no file that tells their schema
    counted.join(F.broadcast(known), "block", "left").select("*", typed).coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")
    return Blocks.read(spark, path)


@dataclass
class Blocks:
    """A stored index: rows (id, vector, off, block), and number, centre, radius and count of each block."""

    rows: DataFrame
    block: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    n: np.ndarray

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Blocks:
        told = spark.read.parquet(f"{path}/blocks")
        table = sorted(told.collect(), key=lambda r: r["block"])
        dim = max((len(r["centre"]) for r in table if r["centre"]), default=0)
        centre = np.array([r["centre"] or [0.0] * dim for r in table], np.float64).reshape(len(table), dim)
        block, n = (np.array([r[c] for r in table], np.int64) for c in ("block", "n"))
        return cls(spark.read.schema(told.schema["row"].dataType).parquet(f"{path}/rows"), block, centre, np.array([r["radius"] for r in table], np.float64), n)

    def within(self, blocks: np.ndarray) -> DataFrame:
        """The rows of some blocks; the folders of others aren't read."""
        return self.rows.where(F.col("block").isin([int(b) for b in blocks]))

    def plan(self, query: list[float], k: int) -> np.ndarray:
        """Numbers of the blocks that may hold one of the k nearest."""
        q = np.asarray(query, np.float64)
        odd = self.block == ODD
        if k <= 0 or not q.any() or not len(self.block):
            return self.block[:0]
        if odd.all():
            return self.block
        if len(q) != self.centre.shape[1]:
            raise ValueError(f"the index is for vectors of {self.centre.shape[1]} components, not {len(q)}")
        least = np.linalg.norm(self.centre - q / np.linalg.norm(q), axis=1) - self.radius
        least[odd] = -np.inf
        order = np.argsort(least, kind="stable")
        order = order[~odd[order]]
        first = order[: 1 + int(np.searchsorted(np.cumsum(self.n[order]), k))]
        if self.n[first].sum() < k:
            return self.block
        worst = screened(self.within(self.block[first]), query, k).agg(F.max("distance")).first()[0]
        chosen = self.block[least <= np.sqrt(max(2 * worst, 0.0)) + SLACK]
        log.info("reads %d of %d blocks, %d of %d vectors", len(chosen), len(self.block), self.n[np.isin(self.block, chosen)].sum(), self.n.sum())
        return chosen

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """(id, distance) of the k nearest vectors, by distance, then id."""
        return screened(self.within(self.plan(query, k)), query, k)

    def share(self, blocks: np.ndarray) -> float:
        """Share of all vectors that these blocks hold."""
        return float(self.n[np.isin(self.block, blocks)].sum() / max(self.n.sum(), 1))
