"""Index tables by bucket: same results as over plain tables, and no shuffle of the stored side."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import colocated, indexing

NEW = "source_path string, chunk_index int, content_hash string"


@pytest.fixture
def tables(spark):
    rows = [(f"id{p}-{i}", f"p{p}", i, f"h{(p * i) % 37}") for p in range(9) for i in range(4 if p else 200)]
    chunks = spark.createDataFrame(rows, "id string, " + NEW).withColumns({"part": F.lit("own"), "vector": F.lit("own")})
    vectors = spark.createDataFrame([(r[0], [float(r[2])]) for r in rows], "id string, vector array<float>")
    new = spark.createDataFrame([(f"p{p}", i, f"h{(p * i + 3 * (i == 2)) % 41}") for p in (0, 3, 8, 20) for i in range(6)], NEW)
    scanned = new.select("source_path").union(spark.createDataFrame([("p5",), ("nowhere",)], "source_path string"))
    return chunks, vectors, new, scanned


def _told(rows):
    return sorted(map(repr, rows.collect()))


def _shuffled_scans(df) -> list[str]:
    """For each scan of a stored table, whether a shuffle stands between it and the first join above it."""
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[-1]
    lines = [(len(re.match(r"[\s:+\-|]*", line)[0]), line) for line in text.splitlines()]
    out = []
    for i, (depth, line) in enumerate(lines):
        if "FileScan" in line and "Bucketed: true" in line:
            for above, told in reversed(lines[:i]):
                if above < depth:
                    depth = above
                    if "Join" in told:
                        out.append("joined")
                        break
                    if "Exchange" in told:
                        out.append("shuffled")
                        break
    return out


def test_equal_to_plain_tables_and_no_shuffle(spark, tables, tmp_path):
    chunks, vectors, new, scanned = tables
    held = colocated.write(chunks, vectors, str(tmp_path / "it's"), 6)
    held = colocated.Colocated.read(spark, str(tmp_path / "it's"))  # as another session would
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quill_")]
    planned = held.plan(new, scanned)
    old = chunks.join(scanned.distinct(), "source_path", "left_semi")
    expected = indexing.plan(new, old)
    assert _told(planned) == _told(expected)
    assert {r[0] for r in planned.select("action").distinct().collect()} == {"embed", "reuse", "unchanged", "delete"}
    assert _told(held.to_embed(planned)) == _told(indexing.embed_needed(expected, chunks))
    best = chunks.select("id", "content_hash").join(vectors, "id").groupBy("content_hash").agg(F.max_by("vector", "id").alias("vector"))
    assert _told(held.vectors(new)) == _told(best.join(new.select("content_hash").distinct(), "content_hash", "left_semi"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    kept = [spark.conf.get(name) for name in names]
    try:
        spark.conf.set(names[0], "-1")  # as with a run too large to broadcast
        for partitions in ("4", "200"):
            spark.conf.set(names[1], partitions)
            frames = (held.of(scanned), held.plan(new, scanned), held.to_embed(held.plan(new, scanned)), held.vectors(new))
            assert [_shuffled_scans(df) for df in frames] == [["joined"] * n for n in (1, 2, 3, 1)]
        assert _shuffled_scans(held.places.groupBy("chunk_index").count()) == []  # a plan without use for buckets reads plainly
    finally:
        for name, value in zip(names, kept, strict=True):
            spark.conf.set(name, value)


def test_a_hot_file_is_spread(spark, tables, tmp_path):
    chunks, vectors, _, _ = tables
    held = colocated.write(chunks, vectors, str(tmp_path / "ix"), 6)
    per_file = held.places.where("source_path = 'p0'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert len(per_file) > 2 and max(r["n"] for r in per_file) < 150


def test_awkward_rows_and_writing_again(spark, tables, tmp_path):
    chunks, vectors, new, scanned = tables
    path = str(tmp_path / "ix")
    colocated.write(chunks, vectors, path, 4)
    odd = spark.createDataFrame([("a", "p", 0, "h"), ("b", "p", 0, "h"), ("c", None, 1, "h"), ("d", "p", None, "x"), ("e", "p", 2, None), ("f", "p", 3, "alone")], "id string, " + NEW)
    held = colocated.write(odd, spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<float>"), path, 3)
    assert _told(held.places.select("source_path", "chunk_index", "content_hash")) == _told(spark.createDataFrame([("p", 0, "h"), ("p", 0, "h"), ("p", 3, "alone")], NEW))
    assert [tuple(r) for r in held.contents.collect()] == [("h", [2.0])]
    none = colocated.write(chunks.limit(0), vectors.limit(0), path, 3)
    assert {r["action"] for r in none.plan(new, scanned).collect()} == {"embed"}
    assert none.vectors(new).count() == 0
