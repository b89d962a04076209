"""The index of vectors by blocks against a search of all rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine_distance
from quillspark.operators import neighbours, search

SCHEMA = "id long, vector array<float>"


def _plain(vectors, query, k):
    """Every distance by its expression."""
    rows = vectors.select("id", cosine_distance(F.col("vector"), query).alias("distance")).where("distance is not null")
    return [tuple(r) for r in rows.orderBy("distance", "id").limit(k).collect()]


def _told(found):
    return [tuple(r) for r in found.collect()]


def _clustered(spark, groups=12, each=40, dim=8, spread=0.05):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, dim))
    x = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(groups * each, dim))
    return spark.createDataFrame([(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)], SCHEMA)


def test_blocks_equal_all_rows_and_skip(spark, tmp_path):
    vectors = _clustered(spark).repartition(5)
    index = neighbours.build(vectors, str(tmp_path / "ix"), 8, 12)
    assert index.n.sum() == vectors.count()
    skipped = 0
    for i in (0, 200, 479):
        query = [float(x) for x in vectors.where(F.col("id") == i).first()["vector"]]
        for k in (1, 20, 60):
            assert _told(index.nearest(query, k)) == _plain(vectors, query, k)
            chosen = index.plan(query, k)
            skipped += index.share(chosen) < 0.5
    assert skipped >= 6
    assert _told(index.nearest(query, 1000)) == _plain(vectors, query, 1000)
    # only folders of chosen blocks are read
    assert len(chosen) < len(index.block)
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ (=|IN|INSET) ", index.within(chosen)._jdf.queryExecution().toString())


def test_ties_and_repeated_ids(spark, tmp_path):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(4, [1.0, 1.0]), (4, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("own"), "off": F.lit(1), "distance": F.lit(0)})
    index = neighbours.build(vectors, str(tmp_path / "ix"), 2, 5)
    for k in (1, 7, 13, 32):
        expected = _plain(vectors, [1.0, 1.0], k)
        assert _told(index.nearest([1.0, 1.0], k)) == expected
        assert _told(search.knn(vectors, [1.0, 1.0], k)) == expected


def test_awkward_vectors(spark, tmp_path):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1e-30, 1e-30]), (11, [3e38, -3e38]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = neighbours.build(vectors, str(tmp_path / "ix"), 2, 4)
    for query in ([1.0, 1.0], [-1.0, 0.5], [3e38, 1.0]):
        for k in (1, 3, 20):
            expected = repr(_plain(vectors, query, k))
            assert repr(_told(index.nearest(query, k))) == expected
            assert repr(_told(search.knn(vectors, query, k))) == expected
    for found in (index.nearest([0.0, 0.0], 5), index.nearest([1.0, 1.0], 0), search.knn(vectors, [0.0, 0.0], 5)):
        assert found.columns == ["id", "distance"] and found.count() == 0
    assert repr(_told(search.knn(vectors, [nan, 1.0], 3))) == repr(_plain(vectors, [nan, 1.0], 3))
    with pytest.raises(ValueError, match="components"):
        index.nearest([1.0, 1.0, 1.0], 2)
    with pytest.raises(ValueError, match="blocks"):
        neighbours.build(vectors, str(tmp_path / "none"), 2, 0)


def test_doubles_beyond_the_sphere(spark, tmp_path):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.5]), (4, [-1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    index = neighbours.build(vectors, str(tmp_path / "ix"), 2, 4)
    assert repr(_told(index.nearest([1.0, 1.0], 9))) == repr(_plain(vectors, [1.0, 1.0], 9))
    assert sorted(index.block)[0] == neighbours.ODD


def test_only_odd_vectors_and_none(spark, tmp_path):
    index = neighbours.build(spark.createDataFrame([(1, [math.inf, 1.0])], SCHEMA), str(tmp_path / "odd"), 2)
    assert [r["id"] for r in index.nearest([1.0, 1.0], 3).collect()] == [1]
    index = neighbours.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "ix"), 2)
    assert index.nearest([1.0, 1.0], 3).collect() == []


def test_build_again_replaces(spark, tmp_path):
    path = str(tmp_path / "ix")
    neighbours.build(_clustered(spark), path, 8, 12)
    few = _clustered(spark, groups=2, each=5)
    index = neighbours.build(few, path, 8, 3)
    assert index.n.sum() == 10 == index.rows.count()
    again = neighbours.Blocks.read(spark, path)
    query = [float(x) for x in few.first()["vector"]]
    assert _told(again.nearest(query, 4)) == _plain(few, query, 4)


def test_searches_take_an_index(spark, tmp_path):
    vectors = _clustered(spark).withColumn("id", F.col("id").cast("string"))
    chunks = vectors.select("id", F.concat(F.lit("word "), "id").alias("content"), F.lit("h").alias("content_hash"), F.concat(F.lit("p"), "id").alias("source_path"), F.lit("r").alias("repo"), F.lit("text").alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    index = neighbours.build(vectors, str(tmp_path / "ix"), 8, 12)
    query = [float(x) for x in vectors.where("id = '7'").first()["vector"]]
    for mode in ("vector", "hybrid"):
        both = [search.search(chunks, v, query, "word", 10, mode=mode).collect() for v in (vectors, index)]
        assert both[0] == both[1] and len(both[0]) == 10
