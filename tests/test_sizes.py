"""What a task holds at a time, and how often texts are read, whatever the size of batches and tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import identity
from quillspark.operators import chunking, keyword, store


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.split() for t in texts], pa.list_(pa.string()))], names=["id", "t"])


TEXTS = ["a b a", "", "running runs b", "c " * 9, "a", "b c"]


@pytest.mark.parametrize("words", [1, 4, 1 << 19])
def test_postings_come_in_parts(monkeypatch, words):
    monkeypatch.setattr(keyword, "WORDS_AT_A_TIME", words)
    out = [b.to_pylist() for b in keyword._postings(iter([_batch([]), _batch(TEXTS).slice(0, 6), _batch(["z", *TEXTS]).slice(1)]))]
    got = sorted((r["id"], r["term"], r["len"], r["tf"], r["positions"]) for rows in out for r in rows)
    own = [(0, "a", 3, 2, [0, 2]), (0, "b", 3, 1, [1]), (2, "b", 3, 1, [2]), (2, "run", 3, 2, [0, 1]), (3, "c", 9, 9, [*range(9)]), (4, "a", 1, 1, [0]), (5, "b", 2, 1, [0]), (5, "c", 2, 1, [1])]
    assert got == sorted([*own, *((i + 1, *rest) for i, *rest in own)])
    assert all(sum(r["tf"] for r in rows) <= max(words, 9) for rows in out)


def test_counts_come_in_parts(monkeypatch):
    monkeypatch.setattr(keyword, "WORDS_AT_A_TIME", 4)
    out = list(keyword._counted(iter([_batch(TEXTS)]), phrases=[["run"], ["a", "b"]]))
    assert [r["_len"] for b in out for r in b.to_pylist()] == [3, 0, 3, 9, 1, 2]
    assert [r["_tf"] for b in out for r in b.to_pylist()] == [[0, 1], [0, 0], [2, 0], [0, 0], [0, 0], [0, 0]]
    assert len(out) > 1


def test_a_task_hands_on_its_best_of_each_query():
    """Not those of each batch."""
    batches = [_batch(["a", "b a", "a a"]), _batch(["a", "c", "a a a"])]
    out = [r for b in keyword._best(iter(batches), {"a": 0, "b": 1}, [(7, [0]), (9, [1])], np.array([1.0, 1.0]), 2.0, 2) for r in b.to_pylist()]
    assert [(r["query"], r["id"]) for r in out] == [(7, 2), (7, 2), (9, 1)]
    assert out[0]["score"] >= out[1]["score"]


def test_sources_are_handed_on_in_parts(spark, monkeypatch):
    source = "def f():\n    return 1\n"
    monkeypatch.setattr(chunking, "SOURCES_AT_A_TIME", 2 * len(source))
    out = list(chunking._syntax_trees(iter([pa.array([source] * 5 + [None, "def", "x = 1"])])))
    assert [len(x) for x in out] == [2, 2, 4]
    assert [x and len(x) for a in out for x in a.to_pylist()] == [1, 1, 1, 1, 1, None, None, None]
    rows = spark.createDataFrame([(i, source * (i % 3) or None) for i in range(50)], "id int, p string").coalesce(1)
    got = rows.select("id", F.size(chunking.syntax_tree(F.col("p"), F.split("p", "\n"))).alias("n")).collect()
    assert all(r.n == r.id % 3 for r in got if r.id % 3)


def test_stored_bm25_reads_postings_once(spark):
    docs = spark.createDataFrame([(0, "of the hend in the"), (1, "in the of"), (2, "hend"), (3, "the of")], "id long, content string")
    found = keyword.bm25_index(keyword.postings(docs), 4, 11, [["of", "the"], ["hend"], ["in", "the"]])
    assert {r.id for r in found.collect()} == {0, 1, 2}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1


def test_a_segment_makes_its_postings_once(spark, tmp_path, monkeypatch):
    """And a merge takes those that are stored."""
    seen, made = spark.sparkContext.accumulator(0), keyword.postings

    def counted(chunks):
        rows = made(chunks)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(keyword, "postings", counted)

    def rows(texts):
        own = spark.createDataFrame([(str(i), t) for i, t in texts.items()], "id string, content string")
        own = own.select("id", "content", identity.content_hash(F.col("content")).alias("content_hash"), F.concat(F.lit("/"), "id").alias("source_path"), F.lit("r").alias("repo"), F.lit("text").alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("timestamp").alias("indexed_at"))
        return own, own.select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))

    held = store.SnapshotStore(spark, str(tmp_path), embed_dim=1)
    held.commit(*rows({i: f"word{i} same" for i in range(6)}))
    assert seen.value == 12
    held.change(*rows({i: f"word{i} other" for i in range(4)}), held.read()[0].where("id < '4'").select("id", "content"))
    assert seen.value == 20 and len(held.manifest()["segments"]) == 1
    posted = {(r.term, r.id) for r in held.postings().rows.collect()}
    assert posted == {(w, str(i)) for i in range(6) for w in (f"word{i}", "other" if i < 4 else "same")}
    assert held.manifest()["terms"] == 12


@pytest.mark.parametrize("sent", [0, 10])
def test_dead_ids_meet_texts_without_shuffling_them(spark, tmp_path, monkeypatch, sent):
    """Up to so many, whatever Spark thinks of the tables' sizes; and postings are written where they are made."""
    monkeypatch.setattr(store, "FEW_DEAD", 0)
    monkeypatch.setattr(store, "SENT_DEAD", sent)
    monkeypatch.setattr(store, "RELEASED", 1)
    held = store.SnapshotStore(spark, str(tmp_path), embed_dim=1)

    def rows(ids, word):
        own = spark.createDataFrame([(f"{i:02}", f"word{i % 7} {word}") for i in ids], "id string, content string").repartition(3)
        own = own.select("id", "content", identity.content_hash(F.col("content")).alias("content_hash"), F.concat(F.lit("/"), "id").alias("source_path"), F.lit("r").alias("repo"), F.lit("text").alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("timestamp").alias("indexed_at"))
        return own, own.select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))

    held.commit(*rows(range(40), "same"))
    held.change(*rows(range(3), "other"), held.read()[0].where("id < '03'").select("id", "content"))
    assert len(held.manifest()["segments"]) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = held.snapshot()
        for table in (live.chunks, live.vectors, live.postings.rows):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(id" in plan) == (sent == 0)
        assert {(r.id, r.content) for r in live.chunks.collect()} == {(f"{i:02}", f"word{i % 7} {'other' if i < 3 else 'same'}") for i in range(40)}
        assert {(r.term, r.id) for r in live.postings.rows.collect()} == {(w, f"{i:02}") for i in range(40) for w in (f"word{i % 7}", "other" if i < 3 else "same")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = held.manifest()["segments"][0]["version"]
    placed = held._table(first, "postings", store.POSTINGS).select(F.input_file_name().alias("f"), "term", F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()
    assert all(a.term <= b.term for a, b in zip(placed, placed[1:]) if a.f == b.f)
