"""Search, splitting, store and streams on small fixtures, against independent oracles where there are any."""

import sqlite3
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import files, text, vectors
from quillspark.operators import chunking, indexing, keyword, results, search, store
from quillspark.sources import tree
from quillspark.streaming import watch

CORPUS = [
    "The token expired and the user must validate_token again",
    "validate the token before use",
    "Café résumé naïve tokens: auth.py error",
    "auth py is not a phrase, error auth.py",
    "nothing here",
    "",
]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    for name, tokenizer in (("plain", "unicode61 remove_diacritics 1"), ("stemmed", "porter unicode61 remove_diacritics 1")):
        con.execute(f"CREATE VIRTUAL TABLE {name} USING fts5(id UNINDEXED, content, tokenize = '{tokenizer}')")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(CORPUS)))
    return con


def _docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "id long, content string")


@pytest.mark.parametrize("query", ["token expired", "expire", "validates tokens", "errors.auth error.auths", "auth.py error", "validate_token token token", "cafe resume", "a b c"])
def test_bm25_equals_full_text_search(spark, fts, query):
    match = " OR ".join('"' + t.replace('"', '""') + '"' for t in query.split() if len(t) > 1)
    expected = {i: -s for i, s in fts.execute("SELECT id, rank FROM stemmed WHERE stemmed MATCH ?", (match,))} if match else {}
    total = sum(r.len for r in keyword.lengths(_docs(spark)).collect())
    for got in (keyword.bm25(_docs(spark), text.phrases(query)), keyword.bm25_index(keyword.postings(_docs(spark)), len(CORPUS), total, text.phrases(query))):
        found = {r.id: r.score for r in got.collect()}
        assert found.keys() == expected.keys()
        assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_search_finds_other_forms(spark):
    chunks = _docs(spark).selectExpr("id", "content", "concat('/', id) AS source_path", "'r' AS repo", "'text' AS language", "1 AS start_line", "1 AS end_line")
    for word in ("expire", "expires", "expired"):
        assert [r.id for r in search.bm25_search(chunks, word).collect()] == [0]


@pytest.mark.parametrize("word,stem", [("running", "run"), ("expired", "expir"), ("ponies", "poni"), ("caresses", "caress"), ("relational", "relat"), ("hopping", "hop"), ("as", "as"), ("sky", "sky"), ("adoption", "adopt"), ("controlling", "control")])
def test_porter(word, stem):
    assert text.Porter.stem(word) == stem


def test_porter_equals_full_text_search():
    import random

    rng = random.Random(3)
    ends = ["", "s", "es", "ies", "ed", "ing", "ational", "izer", "fulness", "ement", "ion", "ly", "y", "ative", "icate", "ous", "al", "e", "ll"]
    words = sorted({"".join(rng.choice("abcdefgilmnoprstuy") for _ in range(rng.randint(2, 6))) + rng.choice(ends) for _ in range(1500)})
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t (rowid, x) VALUES (?, ?)", list(enumerate(words, 1)))
    got = {doc: term for term, doc in con.execute("SELECT term, doc FROM v")}
    assert all(w.startswith(text.Porter.stem(w)[:-1]) for w in words)  # what ad hoc search goes by
    wrong = [(w, got[i], text.Porter.stem(w)) for i, w in enumerate(words, 1) if got[i] != text.Porter.stem(w)]
    assert not wrong


def test_fusion_worked_example(spark):
    near = spark.createDataFrame([("throttle", 0), ("auth", 1), ("payment", 2)], "id string, rank int")
    said = spark.createDataFrame([("rate_limiter", 0), ("throttle", 1), ("architecture", 2)], "id string, rank int")
    got = {r.id: round(r.score, 4) for r in search.rrf(near, said).collect()}
    assert got["throttle"] == 0.0325 and got["rate_limiter"] == 0.0164 and got["auth"] == 0.0161


def test_filters_apply_after_the_cut(spark):
    chunks = spark.createDataFrame([(i, f"word {i}", f"/f{i}", "a" if i < 12 else "b", "text", 1, 1) for i in range(20)], "id long, content string, source_path string, repo string, language string, start_line int, end_line int")
    vecs = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)], "id long, vector array<float>")
    got = search.vector_search(chunks, vecs, [1.0, 0.0], 2, repo="b").collect()
    assert got == []  # the ten nearest are all in a
    assert [r.id for r in search.vector_search(chunks, vecs, [1.0, 0.0], 3, repo="b").collect()] == [12, 13, 14]
    with pytest.raises(ValueError):
        search.search(chunks, vecs, [1.0, 0.0], mode="other")


def test_overlap_dedup_is_greedy(spark):
    rows = [("a", 1, 20, 0), ("a", 10, 30, 1), ("b", 1, 20, 2), ("a", 25, 40, 3)]
    frame = spark.createDataFrame(rows, "source_path string, start_line int, end_line int, rank int")
    assert sorted(r["rank"] for r in results.dedup_overlap(frame).collect()) == [0, 2, 3]


def test_overlap_dedup_of_one_large_file(spark):
    """10^5 ranges of one path, against a list that is searched whole."""
    import random

    rng = random.Random(2)
    rows = [("p", a := rng.randint(1, 10**6), a + rng.randint(0, 400), k) for k in range(100_000)]
    kept, taken = [], bytearray(10**6 + 500)
    for _, a, b, k in rows:
        if not any(taken[a : b + 1]):
            taken[a : b + 1] = b"x" * (b + 1 - a)
            kept.append(k)
    frame = spark.createDataFrame([*rows, (None, 1, 2, -1), ("q", 5, 4, -2), ("q", None, 4, -3)], "source_path string, start_line int, end_line int, rank int")
    assert sorted(r["rank"] for r in results.dedup_overlap(frame).collect()) == kept


def test_context_keeps_the_first_block(spark):
    rows = spark.createDataFrame([("b", 1, 2, "text", "x " * 50), ("a", 1, 2, "text", "y " * 50), ("a", 3, 4, "note", "z")], "source_path string, start_line int, end_line int, language string, content string")
    packed = results.pack_context(rows, 10).collect()
    assert [(r.position, r.source_path) for r in packed] == [(1, "a")]
    headers = [r.block.split("\n")[0] for r in results.pack_context(rows, 10_000).orderBy("position").collect()]
    assert headers == ["# a  (text)", "# [memory]", "# b  (text)"]


def test_windows_and_headings(spark):
    body = "\n".join(f"l{i}" for i in range(40))
    got = spark.createDataFrame([(body,)], "x string").select(chunking.windows(chunking.lines(F.col("x"))).alias("c")).first().c
    assert [(c.start_line, c.end_line) for c in got] == [(1, 40), (33, 40)]
    doc = "intro\n# A\ntext\n\n# B\n#\n"
    got = spark.createDataFrame([(doc,)], "x string").select(chunking.headings(chunking.lines(F.col("x"))).alias("c")).first().c
    assert [(c.content, c.start_line, c.end_line) for c in got] == [("intro", 1, 1), ("# A\ntext", 2, 4), ("# B", 5, 5), ("#", 6, 6)]


def test_python_and_declarations(spark):
    source = "import a\nimport b\nimport c\n\n@deco\ndef f():\n    return 1\n\nclass K:\n    def m(self):\n        pass\n"
    rows = spark.createDataFrame([("p", source, "python"), ("bad", "def (:\n", "python"), ("t", "import x\nexport async function go() {\n}\ninterface I {\n}\n", "typescript"), ("r", "pub fn a() {}\nfn\nb() {}\n", "rust")], "k string, content string, language string")
    got = {r.k: [(c.start_line, c.end_line) for c in r.c] for r in rows.select("k", chunking.split(F.col("content"), F.col("language")).alias("c")).collect()}
    assert got == {"p": [(1, 5), (6, 7), (9, 11), (10, 11)], "bad": [(1, 1)], "t": [(1, 1), (2, 3), (4, 5)], "r": [(1, 1), (2, 3)]}


def test_no_chunk_is_oversized(spark):
    big = "\n".join("x" * 500 for _ in range(100)) + "\n" + "y" * 20_000
    got = spark.createDataFrame([(big, "yaml"), (None, "yaml"), ("  \n", "yaml")], "content string, language string").select(chunking.split(F.col("content"), F.col("language"), python=False).alias("c")).collect()
    assert all(len(c.content) <= C.MAX_CHUNK_CHARS for c in got[0].c) and got[1].c in ([], None) and got[2].c == []


@pytest.mark.parametrize("path,skip", [("node_modules/x.js", True), (".git/config", True), ("a/.env", True), ("k.pem", True), ("yarn.lock", True), ("src/a.py", False), ("README.md", False), (".x.md", False), (".x", True)])
def test_skipped_paths(spark, path, skip):
    assert spark.createDataFrame([(path,)], "p string").select(files.skipped(F.col("p")).alias("s")).first().s is skip


def test_tree_to_index(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n\n\ndef f():\n    return 1\n")
    (tmp_path / "src" / "b.bin2").write_bytes(b"x\x00y")
    (tmp_path / "src" / "c.md").write_bytes(b"# T\nbody \xff end\n")
    (tmp_path / "src" / "d.log").write_text("ignored\n")
    (tmp_path / "node_modules" / "e.js").write_text("x")
    (tmp_path / C.IGNORE_FILE).write_text("# comment\n*.log\n")
    rows = tree.read_tree(spark, str(tmp_path))
    got = {r.source_path.rsplit("/", 1)[1]: (r.language, r.content) for r in rows.collect()}
    assert got == {"a.py": ("python", "import os\n\n\ndef f():\n    return 1\n"), "c.md": ("markdown", "# T\nbody  end\n")}
    assert {p.rsplit("/", 1)[1] for p in tree.walk(str(tmp_path))} >= {"a.py", "c.md"}
    assert not any("node_modules" in p for p in tree.walk(str(tmp_path)))


def test_incremental_runs(spark, tmp_path):
    def chunks_of(*contents):
        return chunking.chunk(spark.createDataFrame([(f"/{i}.yaml", "r", "yaml", c) for i, c in enumerate(contents)], "source_path string, repo string, language string, content string"))

    held = store.SnapshotStore(spark, str(tmp_path / "index"), "hashed-bag-of-words")
    chunks, vecs = held.read()
    chunks, vecs = indexing.apply(chunks_of("a b c", "a b c", "d e"), chunks, vecs, "2024-01-01")
    held.commit(chunks, vecs)
    chunks, vecs = held.read()
    assert chunks.count() == vecs.count() == 3
    again = chunks_of("a b c", "a b c", "d e")
    assert indexing.run_stats(indexing.plan(again, chunks), chunks).first().asDict() == {"embedded": 0, "reused": 0, "unchanged": 3, "deleted": 0}
    edited = chunks_of("a b c", "d e", "f")
    assert indexing.run_stats(indexing.plan(edited, chunks), chunks).first().asDict() == {"embedded": 1, "reused": 1, "unchanged": 1, "deleted": 0}
    after, after_vecs = indexing.apply(edited, chunks, vecs, "2024-01-02")
    held.commit(after, after_vecs)
    after, after_vecs = held.read()
    assert {r.content for r in after.collect()} == {"a b c", "d e", "f"} and after_vecs.count() == 3
    want = {i: vectors.hash_embed(t) for i, t in enumerate(["a b c", "d e", "f"])}
    for r in after.join(after_vecs, "id").collect():
        assert r.vector == pytest.approx(want[int(r.source_path[1])], abs=1e-6)
    path = str(tmp_path / "out.jsonl")
    store.export_jsonl(after, after_vecs, path, "hashed-bag-of-words")
    assert store.import_jsonl(spark, path, C.EMBED_DIM).count() == 3
    with pytest.raises(store.ImportMismatch):
        store.import_jsonl(spark, path, 384)


def _store(spark, path):
    return store.SnapshotStore(spark, str(path), "hashed-bag-of-words")


def _project(root):
    (root / "p" / ".git").mkdir(parents=True)
    (root / "p" / "sub").mkdir()
    (root / "p" / "__init__.py").write_text("import os\n\n\ndef start():\n    # token expired\n    return 1\n")
    (root / "p" / "sub" / "a.yaml").write_text("a: 1\n")
    (root / "p" / ".notes.md").write_text("# Notes\nhidden but shown\n")
    (root / "p" / "link.md").symlink_to(root / "p" / ".notes.md")
    (root / "free.md").write_text("# Free\nno repository here\n")


def test_directory_to_search(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    _project(root)
    held = _store(spark, tmp_path / "index")
    told = indexing.index_path(held, str(root), "2024-01-01")
    chunks, vecs = held.read()
    rows = {r.source_path.removeprefix(str(root)): r.repo.removeprefix(str(root)) for r in chunks.collect()}
    assert rows == {"/p/__init__.py": "/p", "/p/sub/a.yaml": "/p", "/p/.notes.md": "/p", "/free.md": ""}
    assert told["embedded"] == chunks.count() == vecs.count()
    one = vectors.HashEmbedder().embed_query("token expired")
    for mode in ("bm25", "vector", "hybrid"):
        stored = [(r.id, round(r.score, 9)) for r in held.search(one, "expires token", 2, mode=mode).collect()]
        assert stored == [(r.id, round(r.score, 9)) for r in search.search(chunks, vecs, one, "expires token", 2, mode=mode).collect()]
        assert chunks.where(F.col("id") == stored[0][0]).first().source_path.endswith("__init__.py")
    version = held.manifest()["version"]
    assert indexing.index_path(held, str(root), "2024-01-02")["unchanged"] == chunks.count() and held.manifest()["version"] == version
    # an emptied file loses its rows; one file is indexed by itself
    (root / "p" / "sub" / "a.yaml").write_text("")
    assert indexing.index_path(held, str(root / "p" / "sub" / "a.yaml"), "2024-01-03")["deleted"] == 1
    assert {r.source_path.removeprefix(str(root)) for r in held.read()[0].collect()} == {"/p/__init__.py", "/p/.notes.md", "/free.md"}
    answer = results.told(held, vectors.HashEmbedder(), "expired", 1, mode="bm25")
    assert answer.startswith(f"### {root}/p/__init__.py (lines") and answer.endswith("```\n")
    assert results.told(held, vectors.HashEmbedder(), "") == "Empty query."
    assert results.told(held, vectors.HashEmbedder(), "zzzz", mode="bm25") == "No relevant results found."
    assert "unknown mode" in results.told(held, vectors.HashEmbedder(), "x y", mode="other")
    packed = results.context(held.search(one, "token free", 50), 1000).collect()
    assert [r.position for r in packed] == [1, 2, 3]


def test_service(spark, tmp_path):
    import json
    import threading
    import urllib.request

    from quillspark import service

    root = tmp_path / "src"
    root.mkdir()
    _project(root)
    assert service.Service().answer("POST", "/search", {"query": "x"})[0] == 503
    assert service.Service().answer("GET", "/status")[1]["status"] == "not_initialised"
    own = service.Service(_store(spark, tmp_path / "index"), vectors.HashEmbedder(), home=str(tmp_path))
    assert own.answer("POST", "/index", {"path": str(tmp_path / "none")})[0] == 404
    assert own.answer("POST", "/index", {"path": "/"})[0] == 400 and own.answer("GET", "/other")[0] == 404
    assert own.answer("POST", "/search", {"query": "x", "mode": "other"})[0] == 422
    assert own.answer("POST", "/index", {"path": str(root)}) == (200, {"indexed": 4, "path": str(root)})
    assert own.answer("POST", "/v1/embeddings", {"input": "a b"})[1]["data"][0]["embedding"] == vectors.hash_embed("a b")
    server = service.serve(own, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        asked = urllib.request.Request(f"{at}/search", json.dumps({"query": "expires", "top_k": 1}).encode())
        found = json.load(urllib.request.urlopen(asked, timeout=60))["results"]
        assert len(found) == 1 and found[0]["source_path"].endswith("__init__.py")
        status = json.load(urllib.request.urlopen(f"{at}/status", timeout=60))
        assert status["chunks"] == 4 and {r["repo"] for r in status["repos"]} == {str(root), str(root / "p")}
    finally:
        server.shutdown()


def test_display(spark):
    rows = spark.createDataFrame([("1", "x", "/home/u/a.py", "r", "python", 1, 2, 0.5), ("2", "y", "/n", "r", "note", 1, 1, 0.75)], "id string, content string, source_path string, repo string, language string, start_line int, end_line int, score double")
    assert [(r.place, r.title) for r in results.displayed(rows).collect()] == [(2, "#2  /home/u/a.py  lines 1-2  score=0.5000"), (1, "#1  memory  score=0.7500")]
    assert [r.p for r in rows.select(results.short_path(F.col("source_path"), "/home/u").alias("p")).collect()] == ["~/a.py", "/n"]
    assert results.bar(1, 4, 8) == "[##......] 1/4 ( 25%)" and results.bar(0, 0, 4) == "[....] 0/0 (  0%)"


def test_rebuild_embeds_anew(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    _project(root)
    held = _store(spark, tmp_path / "index")
    indexing.index_path(held, str(root), "2024-01-01")
    noted = spark.createDataFrame([("a note", "", "2024-01-01 00:00:00")], "text string, tags string, at string").withColumn("at", F.to_timestamp("at"))
    held.commit(*store.add_notes(*held.read(), noted))

    class Other(vectors.HashEmbedder):
        model_name = "other"

        def embed(self, texts):
            return [[2.0] * self.dim for _ in texts]

    (root / "p" / "sub" / "a.yaml").write_text("b: 2\n")
    with pytest.raises(store.ImportMismatch):
        store.SnapshotStore(spark, held.path, "other").read()
    new = store.SnapshotStore(spark, held.path, "other")
    assert sum(indexing.rebuild(new, "2024-01-02", Other()).values()) == 4
    chunks, vecs = new.read()
    assert chunks.count() == vecs.count() == 5 and {r.vector[0] for r in vecs.collect()} == {2.0}
    assert chunks.where("content = 'b: 2'").count() == 1 and chunks.where(F.col("repo") == C.NOTE_REPO).count() == 1


def test_a_reader_always_finds_a_snapshot(spark, tmp_path, monkeypatch):
    held = _store(spark, tmp_path / "index")
    rows = chunking.chunk(spark.createDataFrame([("/a.yaml", "r", "yaml", "a b c")], "source_path string, repo string, language string, content string"))
    held.commit(*indexing.apply(rows, *held.read(), "2024-01-01"))
    before = held.manifest()
    broken = _store(spark, tmp_path / "index")
    monkeypatch.setattr(broken, "_numbers", lambda: [])  # a writer that missed the commit before its own
    with pytest.raises(OSError):
        broken.commit(*held.read())
    assert held.manifest() == before and held.read()[0].count() == 1
    for _ in range(2):
        held.commit(*held.read())
    assert held.vacuum(1) == 2 and held.read()[0].count() == held.read()[1].count() == 1


def test_upsert_keeps_one_row_per_id(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    batch = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id long, v string").coalesce(1)
    assert sorted(map(tuple, store.upsert(old, batch).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_cascade_and_prefixes(spark):
    rows = spark.createDataFrame([("1", "/a/b"), ("2", "/a"), ("3", "/ab")], "id string, source_path string")
    vecs = spark.createDataFrame([("1", [1.0]), ("3", [2.0])], "id string, vector array<float>")
    assert store.count_prefix(rows, "/a").first().removed == 2 and store.count_prefix(rows, "/A", strict_compat=True).first().removed == 3
    kept, kept_vecs = indexing.remove(spark.createDataFrame([("/a",)], "path string"), rows, vecs)
    assert [r.id for r in kept.collect()] == [r.id for r in kept_vecs.collect()] == ["3"]


def test_queries_are_embedded_once():
    class Counting(vectors.HashEmbedder):
        calls = 0

        def embed_query(self, text):
            self.calls += 1
            return super().embed_query(text)

    cached = vectors.CachedEmbedder(inner := Counting(), 2)
    assert cached.embed_query("a b") == cached.embed_query("a b") == vectors.hash_embed("a b") and inner.calls == 1
    cached.embed_query("c"), cached.embed_query("d"), cached.embed_query("a b")
    assert inner.calls == 4


def test_embed_batches_are_bounded():
    import pandas as pd

    many = vectors.batches(pd.Series([10] * 1000))
    assert many.value_counts().max() <= C.BATCH_ROWS
    long = vectors.batches(pd.Series([2000] * 50))
    assert (long.value_counts() * 2000**2).max() <= C.BATCH_AREA


def test_ignore_and_roots(spark):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/a/d.py",), ("/z/q.py",)], "path string")
    got = {r.path: r.repo for r in files.repository(paths, spark.createDataFrame([("/a",), ("/a/b",)], "repo string")).collect()}
    assert got == {"/a/b/c.py": "/a/b", "/a/d.py": "/a", "/z/q.py": "/z"}
    rules = spark.createDataFrame([("/a", "*.py"), ("/a/b", "x/")], "dir string, pattern string")
    assert {r.path: r.ignored for r in files.ignored(paths, rules).collect()} == {"/a/b/c.py": False, "/a/d.py": True, "/z/q.py": False}
    rules = spark.createDataFrame([("/a", "[!d].py"), ("/z", "[pq].py/")], "dir string, pattern string")
    assert {r.path: r.ignored for r in files.ignored(paths, rules).collect()} == {"/a/b/c.py": True, "/a/d.py": False, "/z/q.py": True}


def test_stream_debounce(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    events = [("/x.py", "created", at(0), 0, "r"), ("/x.py", "modified", at(1), 1, "r"), ("/y.py", "created", at(2), 2, "r"), ("/z.png", "created", at(2), 3, "r"), ("/x.py", "deleted", at(20), 4, "r"), ("/late.py", "created", "2024-01-01 01:00:00", 5, "r")]
    schema = "path string, event_type string, ts timestamp, seq long, root string"
    spark.createDataFrame([Row(*e) for e in events], "path string, event_type string, ts string, seq long, root string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    bursts = watch.debounce(watch.watched(stream), "5 seconds", "10 seconds")
    query = bursts.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda frame, _: seen.extend(frame.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.path, r.event_type) for r in seen}
    assert got == {("/x.py", "modified"), ("/y.py", "created"), ("/x.py", "deleted")}
    batch = watch.debounce(watch.watched(spark.read.schema(schema).parquet(str(tmp_path / "in"))), "5 seconds")
    assert {(r.path, r.event_type) for r in batch.collect()} == got | {("/late.py", "created")}


def test_live_changes_reach_the_store(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    _project(root)
    held = _store(spark, tmp_path / "index")
    (root / "moved.md").write_text("# Free\nno repository here\n")
    (root / "p" / "sub" / "a.yaml").write_text("changed: 1\n")
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    events = [(f"{root}/free.md", "moved", at(0), 0, "r", f"{root}/moved.md"), (f"{root}/p/sub/a.yaml", "modified", at(1), 1, "r", None), ("/late.py", "created", "2024-01-01 01:00:00", 2, "r", None)]
    schema = "path string, event_type string, ts timestamp, seq long, root string, dest_path string"
    spark.createDataFrame(events, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    indexing.index_path(held, str(root), "2024-01-01")
    (root / "free.md").unlink()
    (root / "p" / "sub" / "a.yaml").write_text("changed: 2\n")
    query = watch.live(held, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), [], str(tmp_path / "cp"), gap_ms=5000)
    try:
        for _ in range(300):  # the last burst comes without a later event
            if {r.content for r in held.read()[0].where("source_path like '%a.yaml'").collect()} == {"changed: 2"}:
                break
            time.sleep(0.3)
    finally:
        query.stop()
    chunks, vecs = held.read()
    rows = {r.source_path.removeprefix(str(root)): r.content for r in chunks.collect()}
    assert "/free.md" not in rows and "/moved.md" in rows and rows["/p/sub/a.yaml"] == "changed: 2"
    assert chunks.join(vecs, "id").count() == chunks.count() == vecs.count()


def test_moves_and_notes(spark):
    moved = watch.expand_moves(spark.createDataFrame([("/a", "moved", "/b"), ("/c", "created", None)], "path string, event_type string, dest_path string")).collect()
    assert {(r.path, r.event_type) for r in moved} == {("/a", "deleted"), ("/b", "created"), ("/c", "created")}
    rows = spark.createDataFrame([("use argon", "auth, decisions", "2024-01-01 00:00:00"), ("plain", "", "2024-01-02 00:00:00")], "text string, tags string, at string").withColumn("at", F.to_timestamp("at"))
    made = store.notes(rows)
    assert [r.content for r in store.list_notes(made).collect()] == ["plain", "[tags: auth, decisions]\nuse argon"]
    note = made.where("content = 'plain'").first().source_path
    assert store.delete_source(made, note).count() == 1
    gone, found = store.delete_note(made, note)
    assert gone.count() == 1 and found.first().found


def test_functions_stay_picklable_after_use(spark):
    """Modules travel by value, so nothing in them may hold a JVM handle once a query has run."""
    from pyspark import cloudpickle

    one = spark.createDataFrame([("running", b"x", "def f():\n    pass\n")], "w string, b binary, p string")
    assert [tuple(r) for r in one.select(text.stem("w"), tree.decode("b")).collect()] == [("run", "x")]
    one.select(chunking.syntax_tree(F.col("p"), F.split("p", "\n"))).collect()
    for function in (keyword._counted, keyword._postings, tree._contents, chunking._syntax_trees):
        cloudpickle.dumps(function)
