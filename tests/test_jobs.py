"""The jobs on growing copies of tables, against their SQL and plain Python."""

import json
import math
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from jobs import batch_search, index_documents, registry
from quillspark.functions import text

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, source string, path string, batch string"


def _told(rows):
    return sorted(tuple(r.asDict().items()) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_job_matches_sql(spark, name):
    got = registry.queries()[name](spark, str(SF))
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    expected = con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    want = expected.fetchall()
    at = [expected.columns.index(c) for c in order]
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want) and want


def _add(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(path))


def test_index_takes_what_is_new(spark, tmp_path):
    table, out, cp = (str(tmp_path / n) for n in ("documents", "out", "cp"))
    state = lambda: {(r.source_path, r.chunk_index): r.content for r in index_documents.current(spark, out).collect()}
    _add(spark, table, [(1, "one", "a", "x", "y"), (2, "# two\nbody\n# more\nend", "a", None, None), (3, "three", "b", "", "")])
    assert index_documents.run(spark, table, out, cp) == {"rows": 3, "batches": 1}
    assert state() == {("/a/1.txt", 0): "one", ("/a/2.txt", 0): "# two\nbody", ("/a/2.txt", 1): "# more\nend", ("/b/3.txt", 0): "three"}
    before = _told(index_documents.current(spark, out).collect())
    # nothing new: nothing read, nothing changed
    assert index_documents.run(spark, table, out, cp) == {"rows": 0, "batches": 0}
    assert _told(index_documents.current(spark, out).collect()) == before
    # an edit, an emptied document, the same text again, a new one, odd rows, and a path twice
    _add(spark, table, [(2, "# two\nedited", "a", "x", "y"), (3, None, "b", "x", "y"), (1, "one", "a", "x", "y"), (4, "new", "a", "x", "y"), (4, "new", "a", "x", "y"), (None, "no id", None, "x", "y"), (5, "abc", "b", "x", "y"), (5, "abd", "b", "x", "y")])
    assert index_documents.run(spark, table, out, cp) == {"rows": 8, "batches": 1}
    assert state() == {("/a/1.txt", 0): "one", ("/a/2.txt", 0): "# two\nedited", ("/a/4.txt", 0): "new", ("/null/null.txt", 0): "no id", ("/b/5.txt", 0): "abd"}
    wrote = spark.read.parquet(f"{out}/files").where("batch = 1")
    assert {r.source_path for r in wrote.collect()} == {"/a/2.txt", "/b/3.txt", "/a/4.txt", "/null/null.txt", "/b/5.txt"}  # not the unchanged one


def test_two_runs_equal_one(spark, tmp_path):
    """Growing input in two runs, in several batches each, ends as the whole does in one run."""
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    docs.where("doc_id % 3 = 0").repartition(3).write.parquet(grown)
    index_documents.run(spark, grown, str(tmp_path / "g"), str(tmp_path / "gcp"), files_per_batch=1)
    docs.where("doc_id % 3 <> 0").repartition(2).write.mode("append").parquet(grown)
    assert index_documents.run(spark, grown, str(tmp_path / "g"), str(tmp_path / "gcp"), files_per_batch=1) == {"rows": docs.where("doc_id % 3 <> 0").count(), "batches": 2}
    docs.write.parquet(whole)
    index_documents.run(spark, whole, str(tmp_path / "w"), str(tmp_path / "wcp"))
    rows = [_told(index_documents.current(spark, str(tmp_path / n)).drop("batch").collect()) for n in "gw"]
    assert rows[0] == rows[1] and rows[0]


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    table, out, cp = (str(tmp_path / n) for n in ("documents", "out", "cp"))
    _add(spark, table, [(1, "one", "a", "x", "y")])
    index_documents.run(spark, table, out, cp)
    _add(spark, table, [(1, "edited", "a", "x", "y"), (2, "two", "a", "x", "y")])
    write = index_documents._write

    def fails(rows, path, *parts):
        if path.endswith("/files"):
            raise RuntimeError("stopped")
        write(rows, path, *parts)

    monkeypatch.setattr(index_documents, "_write", fails)
    with pytest.raises(Exception, match="stopped"):
        index_documents.run(spark, table, out, cp)
    assert {r.content for r in index_documents.current(spark, out).collect()} == {"one"}  # half a batch isn't seen
    monkeypatch.setattr(index_documents, "_write", write)
    index_documents.run(spark, table, out, cp)
    assert sorted(r.content for r in index_documents.current(spark, out).collect()) == ["edited", "two"]


def test_index_of_an_empty_table(spark, tmp_path):
    table, out, cp = (str(tmp_path / n) for n in ("documents", "out", "cp"))
    _add(spark, table, [])
    assert index_documents.run(spark, table, out, cp)["rows"] == 0
    assert index_documents.current(spark, out).collect() == []


def _brute(docs, queries, top_k):
    """BM25 of each query's distinct stems over all documents, by its formula."""
    stem = lambda t: [text.Porter.stem(w) for p in text.phrases(" ".join(x if len(x) > 1 else x + "_" for x in t.split())) for w in p]
    held = {i: stem(t or "") for i, t in docs}
    n, average = len(held), sum(map(len, held.values())) / max(len(held), 1)
    out = set()
    for q, t in queries:
        terms = set(stem(t or ""))
        df = {w: sum(w in x for x in held.values()) for w in terms}
        scored = []
        for i, x in held.items():
            tf = Counter(x)
            if any(tf[w] for w in terms):
                scored.append((-round(sum(max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / average)) for w in terms if tf[w]), 6), i))
        out |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top_k])}
    return out


def test_batch_search_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch_search.keyword, "QUERIES_A_SCAN", 2)  # several blocks
    docs = [(i, t) for i, t in enumerate(["the token expired", "tokens expire and expire again", "nothing here", "", None, "token", "token", "a b c"])]
    queries = [(1, "expired tokens"), (2, "here nothing"), (3, "unknown"), (4, ""), (5, None), (-7, "token token a"), (8, "again")]
    paths = [str(tmp_path / n) for n in ("docs", "queries", "out")]
    spark.createDataFrame([(i, t, "s", 1, 2.0) for i, t in docs] + [(None, "token", "s", 1, 2.0)], "doc_id long, text string, source string, rank int, score double").repartition(3).write.parquet(paths[0])
    spark.createDataFrame([(i, t, "x") for i, t in queries] + [(None, "token", "x")], "item_id long, text string, source string").write.parquet(paths[1])
    for _ in range(2):
        told = batch_search.run(spark, *paths, top_k=2)
        got = {(r.item_id, r.rank, r.doc_id, r.score) for r in spark.read.parquet(paths[2]).collect()}
        assert got == _brute(docs, queries, 2) and told == {"documents": 9, "queries": 8, "answers": len(got)}
    spark.createDataFrame([], "doc_id long, text string, source string").write.mode("overwrite").parquet(paths[0])
    assert batch_search.run(spark, *paths)["answers"] == 0


def test_command_lines(tmp_path):
    """Each job runs by itself, from its config file and arguments."""
    shutil.copy(SF / "documents.parquet", tmp_path / "documents.parquet")
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"documents": f"{tmp_path}/documents.parquet", "output": f"{tmp_path}/out", "checkpoint": "", "files_per_batch": 5}))
    run = lambda *more: subprocess.run([sys.executable, "-m", "jobs.index_documents", "--config", str(config), *more], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "no value for checkpoint" in run().stderr
    told = run("--checkpoint", f"{tmp_path}/cp")
    assert told.returncode == 0 and "read 200 new rows in 1 batches" in told.stderr, told.stderr
    assert (tmp_path / "out" / "files" / "batch=0").is_dir()
