"""Centroid clustering of integer vectors, exact in every assignment.

Each round is one scan: float32 matrix products give every vector an interval for its
distance to every centroid. The interval's half width bounds all rounding there can be:
of the conversion to float32, of the product in whatever order it is summed, and of the
double-precision steps after it. Where one centroid's interval lies below all others it is
the nearest; where intervals overlap, the distances to those centroids are computed again
with integers, ties going to the smaller number. Sums and counts by centroid leave a task as
a few hundred rows, are added up by Spark, and only they reach the driver.

Vectors are quantised once, to 64 four-byte integers, and stored in the shared folder.

Defined results: rows whose vector is null, has another number of components than asked for,
or a component that is null, NaN or infinite are left out. Components of any finite float are
exact: those of 2**26 and more are kept as doubles and compared with unbounded integers;
distances and inertias beyond a long are given as the largest long. Rows with a null id are
clustered, and come after all others among the first centroids. Rows with one id are kept
each; among the first centroids they go by their components. With fewer rows than centroids
there are as many centroids as rows; no rows give no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.runtime import map_arrow, materialise, read_table

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components below it in magnitude are stored in four bytes, and squared distances of 64 of them fit a long.
WIDE = 1 << 26
#: Vectors compared at a time, so that products stay in a core's cache.
_ROWS = 4096
_LONG = (1 << 63) - 1
#: Sums travel as two decimals: multiples of this, and the rest.
_LIMB = 1 << 96


def _quantise(batches: Iterator[pa.RecordBatch], components: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, q): components as integers of four bytes, or all of a vector as doubles where one is wide."""
    for batch in batches:
        column = batch.column("embedding")
        whole = np.diff(column.offsets.to_numpy()) == components if len(column) else np.zeros(0, bool)
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(whole)
        held = column.take(pa.array(rows)).flatten()
        x = held.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, components)
        finite = np.isfinite(x).all(axis=1)
        q, rows = np.floor(x[finite] * scale), rows[finite]
        if not np.isfinite(q).all():
            raise OverflowError("a component times the scale isn't a finite double")
        wide = (np.abs(q) >= WIDE).any(axis=1)
        small = q.copy()
        small[wide] = 0
        packed = small.astype("<i4")
        cells = [q[i].astype("<f8").tobytes() if w else packed[i].tobytes() for i, w in enumerate(wide.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(cells, pa.binary())], names=["vec_id", "q"])


def quantised(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the rows to cluster."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return map_arrow(rows, partial(_quantise, components=components, scale=scale), "vec_id long, q binary")


def unpacked(q: bytes, components: int) -> list[int]:
    return [int(x) for x in np.frombuffer(q, "<i4" if len(q) == 4 * components else "<f8")]


class Centroids:
    """Centroids ready for comparison with many vectors."""

    def __init__(self, numbers: list[list[int]]):
        self.numbers = numbers
        #: Whether centroids and vectors of four-byte components can be compared in longs.
        self.narrow = all(abs(x) < WIDE for c in numbers for x in c)
        if self.narrow:
            self.exact = np.array(numbers, np.int64)
            self.single = self.exact.astype(np.float32)
            self.square = (self.exact**2).sum(axis=1)
            self.norm = np.sqrt(self.square.astype(np.float64)) * (1 + 2.0**-50)

    def intervals(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 v.c for each vector and centroid, from a float32 product.

        With u = 2**-24, a product of n components that were rounded before it errs by at
        most g / (1 - g) * sum |v_i||c_i| with g = (n + 2) u, in any order of summation and
        with or without fused steps, and that sum is at most |v||c|. The double steps around
        it add some 2**-50 of what they handle.
        """
        g = (v.shape[1] + 2) * 2.0**-24
        product = (v.astype(np.float32) @ self.single.T).astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1).astype(np.float64)) * (1 + 2.0**-50)
        size = norm[:, None] * self.norm[None, :]
        middle = self.square[None, :] - 2 * product
        off = 2 * g / (1 - g) * size * (1 + 2.0**-20) + 2.0**-48 * (self.square[None, :] + 2 * size)
        return middle - off, middle + off

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector of longs, its squared distance, and how many vectors were compared anew."""
        low, high = self.intervals(v)
        cluster = high.argmin(axis=1)
        near = low <= high.min(axis=1)[:, None]
        doubt = np.flatnonzero(near.sum(axis=1) > 1)
        if len(doubt):
            best = np.full(len(doubt), _LONG)
            for k in range(len(self.exact)):  # ascending, so that ties stay with the smaller number
                those = np.flatnonzero(near[doubt, k])
                d = ((v[doubt[those]] - self.exact[k]) ** 2).sum(axis=1)
                closer = d < best[those]
                best[those[closer]] = d[closer]
                cluster[doubt[those[closer]]] = k
        return cluster, ((v - self.exact[cluster]) ** 2).sum(axis=1), len(doubt)

    def assign_wide(self, v: list[int]) -> tuple[int, int]:
        d, k = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(self.numbers))
        return k, d


def _assigned(batch: pa.RecordBatch, known: Centroids, components: int):
    """Parts of a batch as (rows, vectors, clusters, distances): longs where all fits them, else Python's integers."""
    cells = batch.column("q")
    size = pc.binary_length(cells).to_numpy(zero_copy_only=False)
    narrow = np.flatnonzero(size == 4 * components) if known.narrow else np.zeros(0, np.int64)
    for at in range(0, len(narrow), _ROWS):
        rows = narrow[at : at + _ROWS]
        held = cells.take(pa.array(rows))
        v = np.frombuffer(b"".join(held.to_pylist()), "<i4").reshape(-1, components).astype(np.int64)
        cluster, distance, _ = known.assign(v)
        yield rows, v, cluster, distance
    for i in np.setdiff1d(np.arange(len(cells)), narrow).tolist():
        v = unpacked(cells[i].as_py(), components)
        k, d = known.assign_wide(v)
        yield np.array([i]), np.array([v], object), np.array([k]), np.array([d], object)


def _sums(batches: Iterator[pa.RecordBatch], known: Centroids, components: int) -> Iterator[pa.RecordBatch]:
    """A task's sums: per centroid and component, then its count (place ``components``) and its inertia (the place after)."""
    total = np.zeros((len(known.numbers), components + 2), object)
    for batch in batches:
        for _, v, cluster, distance in _assigned(batch, known, components):
            for k in np.unique(cluster).tolist():
                own = cluster == k
                total[k, :components] += v[own].sum(axis=0).astype(object)
                total[k, components] += int(own.sum())
                total[k, components + 1] += sum(min(d, _LONG) for d in distance[own].tolist())
    k, place = np.nonzero(total)
    high, low = zip(*(divmod(x, _LIMB) for x in total[k, place]), strict=True) if len(k) else ((), ())
    whole = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array([Decimal(x) for x in high], whole), pa.array([Decimal(x) for x in low], whole)],
        names=["cluster", "place", "high", "low"],
    )


def _labelled(batches: Iterator[pa.RecordBatch], known: Centroids, components: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _, cluster, distance in _assigned(batch, known, components):
            told = [min(d, _LONG) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(cluster, pa.int32()), pa.array(told, pa.int64())], names=["vec_id", "cluster", "distance"])


def _totals(rows: DataFrame, known: Centroids, components: int) -> list[list[int]]:
    """Per centroid its sums, count and inertia: at most centroids times components + 2 rows reach the driver."""
    parts = map_arrow(rows, partial(_sums, known=known, components=components), "cluster int, place int, high decimal(38,0), low decimal(38,0)")
    out = [[0] * (components + 2) for _ in known.numbers]
    for r in parts.groupBy("cluster", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r["cluster"]][r["place"]] = int(r["high"]) * _LIMB + int(r["low"])
    return out


def first_centroids(rows: DataFrame, n: int, seed: int, components: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in the order of hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select(key.alias("key"), "q").orderBy(F.asc_nulls_last("key"), "q").limit(n).collect()
    return [unpacked(r["q"], components) for r in best]


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]], list[list[int]]]:
    """Rows (vec_id, cluster, distance), the final centroids, and per centroid its count and inertia."""
    rows = materialise(quantised(vectors, components, scale), "vectors")
    numbers = first_centroids(rows, centroids, seed, components)
    if not numbers:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    for _ in range(rounds):
        totals = _totals(rows, Centroids(numbers), components)
        numbers = [[s // t[components] for s in t[:components]] if t[components] else c for c, t in zip(numbers, totals, strict=True)]
    known = Centroids(numbers)
    told = [t[components:] for t in _totals(rows, known, components)]
    return map_arrow(rows, partial(_labelled, known=known, components=components), "vec_id long, cluster int, distance long"), numbers, told


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """Per vector its cluster and distance, the inertia of the cluster and of all, and a digest of the final centroid."""
    rows, numbers, told = cluster(vectors, **how)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in numbers]
    own = F.array(*(F.lit(min(t[1], _LONG)).cast("long") for t in told))
    return rows.select(
        "vec_id", "cluster", "distance",
        F.try_element_at(own, F.col("cluster") + 1).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(t[1] for t in told), _LONG)).cast("long").alias("inertia"),
        F.try_element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1).cast("string").alias("centroid_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read_table(spark, sf_dir, "embeddings"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same by joins of components, a pair of steps for each round."""
    nearest = """
d{i} AS (SELECT v.row, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM comps v JOIN c{i} c USING (i) GROUP BY v.row, c.k),
a{i} AS MATERIALIZED (SELECT row, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)"""
    moved = """
m{n} AS (SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN comps v USING (row) GROUP BY a.k, v.i),
c{n} AS MATERIALIZED (SELECT c.k, c.i, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM c{i} c LEFT JOIN m{n} m USING (k, i))"""
    steps = [nearest.format(i=i) + ("," + moved.format(i=i, n=i + 1) if i < rounds else "") for i in range(rounds + 1)]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS}),
comps AS MATERIALIZED (SELECT row, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM kept),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k FROM kept QUALIFY k < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT f.k, v.i, v.x FROM first f JOIN comps v USING (row)),{",".join(steps)},
digest AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN digest USING (k)
"""
