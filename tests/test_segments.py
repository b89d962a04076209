"""The segment store, incremental runs over it, and the rules on every path into the index."""

import json
import random
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark import service
from quillspark.functions import identity, vectors
from quillspark.operators import indexing, store
from quillspark.sources import tree
from quillspark.streaming import watch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def _store(spark, path):
    return store.SnapshotStore(spark, str(path), "hashed-bag-of-words")


def _rows(spark, held: dict):
    """Chunks and vectors of paths with one chunk each."""
    rows = spark.createDataFrame([(p, t) for p, t in held.items()], "source_path string, content string")
    rows = rows.select(
        identity.chunk_id(F.col("source_path"), F.lit(0)).alias("id"), "content", identity.content_hash(F.col("content")).alias("content_hash"), "source_path",
        F.lit("r").alias("repo"), F.lit("text").alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("2024-01-01").cast("timestamp").alias("indexed_at"),
    )
    vecs = indexing.embed(rows.select("content_hash", "content").dropDuplicates(["content_hash"]))
    return rows, rows.select("id", "content_hash").join(vecs, "content_hash").select("id", "vector")


@pytest.mark.parametrize("few", [0, 2, 500])
def test_changes_equal_a_rewrite(spark, tmp_path, monkeypatch, few):
    """Random changes segment by segment: tables, searches and counts are those of one whole rewrite."""
    monkeypatch.setattr(store, "FEW_DEAD", few)  # dead ids by a join, by both, by name
    rng = random.Random(5)
    held, state = _store(spark, tmp_path / "index"), {}
    words = ["token", "expired", "auth", "config", "limit", "other", "thing"]
    for step in range(4):
        new = {f"/d/{rng.randrange(12)}": " ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.choice([1, 2, 9]))}
        drop = [p for p in state if p not in new and rng.random() < 0.2]
        chunks, _ = held.read()
        gone = chunks.where(F.col("source_path").isin([*new, *drop])).select("id", "content")
        held.change(*_rows(spark, new), gone, files=1 if step % 2 else None)
        state = {p: t for p, t in state.items() if p not in drop} | new
        chunks, vecs = held.read()
        assert {r.source_path: r.content for r in chunks.collect()} == state
        assert sorted(r.id for r in vecs.collect()) == sorted(r.id for r in chunks.collect())
    told = held.manifest()
    assert told["chunks"] == len(state) and told["terms"] == sum(len(t.split()) for t in state.values())
    assert len(told["segments"]) <= 4
    assert len({s["at"] for s in told["segments"]}) == len(told["segments"]) and any(s["dead"] for s in told["segments"][1:]) == (len(told["segments"]) > 1)
    whole = _store(spark, tmp_path / "whole")
    whole.commit(*_rows(spark, state))
    query = vectors.hash_embed("token limit")
    for mode in ("bm25", "vector", "hybrid"):
        a, b = ([(r.source_path, round(r.score, 9)) for r in s.search(query, "token expired limit", 5, mode=mode).collect()] for s in (held, whole))
        assert a == b
    assert sorted(map(tuple, held.postings().rows.drop("positions").collect())) == sorted(map(tuple, whole.postings().rows.drop("positions").collect()))
    held.vacuum(1)
    assert {r.source_path for r in held.read()[0].collect()} == set(state)


def test_segments_stay_few(spark, tmp_path):
    """Their number is logarithmic in the rows, and a small change doesn't touch a large segment."""
    held = _store(spark, tmp_path / "index")
    held.commit(*_rows(spark, {f"/big/{k}": f"word{k}" for k in range(100)}))
    first = held.manifest()["segments"][0]
    for k in range(6):
        held.change(*_rows(spark, {f"/n/{k}": "new one"}), held.read()[0].where("false").select("id", "content"), files=1)
        told = held.manifest()
        assert told["segments"][0] == first and len(told["segments"]) <= 5 and told["chunks"] == 101 + k
    sizes = [s["chunks"] + s["dead"] for s in held.manifest()["segments"]]
    assert all(sizes[i] >= store.MERGE_FACTOR * sum(sizes[i + 1 :]) for i in range(len(sizes) - 1))


def test_a_stale_writer_fails_and_nothing_is_lost(spark, tmp_path):
    held = _store(spark, tmp_path / "index")
    held.commit(*_rows(spark, {"/a": "one"}))
    late = _store(spark, tmp_path / "index")
    stale = late.snapshot()
    held.change(*_rows(spark, {"/b": "two"}), held.read()[0].where("false").select("id", "content"))
    for write in (lambda: late.commit(*_rows(spark, {"/c": "three"})), lambda: late.commit(stale.chunks, stale.vectors, stale.number), lambda: late.change(*_rows(spark, {"/c": "three"}), stale.chunks.where("false").select("id", "content"))):
        with pytest.raises(store.StaleBase):
            write()
    assert {r.source_path for r in held.read()[0].collect()} == {"/a", "/b"}
    late.snapshot()
    late.change(*_rows(spark, {"/c": "three"}), late.read()[0].where("false").select("id", "content"))
    assert {r.source_path for r in held.read()[0].collect()} == {"/a", "/b", "/c"}


def test_of_two_writers_at_once_one_publishes(spark, tmp_path, monkeypatch):
    """Both pass the look at the newest number; the rename lets one through."""
    held, other = _store(spark, tmp_path / "index"), _store(spark, tmp_path / "index")
    base = held.snapshot().number
    held.commit(*_rows(spark, {"/a": "one"}))
    monkeypatch.setattr(other, "_base", lambda _: base)
    with pytest.raises(store.StaleBase):
        other.commit(*_rows(spark, {"/b": "two"}))
    assert {r.source_path for r in held.read()[0].collect()} == {"/a"}


def test_old_manifests_are_not_needed(spark, tmp_path):
    held = _store(spark, tmp_path / "index")
    for k in range(4):
        held.change(*_rows(spark, {f"/{k}": "x y"}), held.read()[0].where("false").select("id", "content"), files=1)
    assert held.vacuum(1) == 3 and held.read()[0].count() == 4
    named = {s["version"] for s in held.manifest()["segments"]}
    assert {p.name for p in (tmp_path / "index").iterdir()} - {"manifests", "staged"} == named


class Counting(vectors.HashEmbedder):
    """Leaves a file for each text it embeds; one text makes it fail."""

    def __init__(self, folder, fails="", slow=0.0):
        self.folder, self.fails, self.slow = str(folder), fails, slow

    def embed(self, texts):
        import uuid
        from pathlib import Path

        time.sleep(self.slow)
        if self.fails and self.fails in texts:
            raise RuntimeError("embedder is down")
        for t in texts:
            Path(self.folder, uuid.uuid4().hex).write_text(t)
        return super().embed(texts)


def _seen(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def _tree(root, n=12):
    root.mkdir()
    for k in range(n):
        (root / f"f{k}.yaml").write_text(f"content of {k}\n")


def test_a_failed_run_leaves_whole_batches(spark, tmp_path):
    _tree(tmp_path / "src")
    (tmp_path / "calls").mkdir()
    held = _store(spark, tmp_path / "index")
    batch = {r.path.rsplit("/", 1)[1]: r.b for r in tree.scan(spark, str(tmp_path / "src")).select("path", F.pmod(F.xxhash64("path"), F.lit(3)).alias("b")).collect()}
    victim = next(n for n, b in batch.items() if b == 1)
    with pytest.raises(Exception, match="embedder is down"):
        indexing.index_path(held, str(tmp_path / "src"), "2024-01-01", Counting(tmp_path / "calls", f"content of {victim[1:-5]}"), batches=3)
    done = {r.source_path.rsplit("/", 1)[1] for r in held.read()[0].collect()}
    assert done == {n for n, b in batch.items() if b == 0}
    before = _seen(tmp_path / "calls")
    told = indexing.index_path(held, str(tmp_path / "src"), "2024-01-02", Counting(tmp_path / "calls"), batches=3)
    assert told["unchanged"] == len(done) and told["embedded"] == 12 - len(done) and held.read()[0].count() == 12
    fresh = list(_seen(tmp_path / "calls"))
    for t in before:
        fresh.remove(t)
    assert sorted(fresh) == sorted(f"content of {n[1:-5]}" for n, b in batch.items() if b != 0)


def test_a_run_is_interrupted_by_its_tag(spark, tmp_path):
    _tree(tmp_path / "src")
    (tmp_path / "calls").mkdir()
    held, failed = _store(spark, tmp_path / "index"), []

    def work():
        try:
            indexing.index_path(held, str(tmp_path / "src"), "2024-01-01", Counting(tmp_path / "calls", slow=2.0), batches=6, tag="index-run")
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(600):
        if (held._numbers() or [0])[-1] >= 1:
            break
        time.sleep(0.1)
    while thread.is_alive():
        spark.sparkContext.cancelJobsWithTag("index-run")
        time.sleep(0.2)
    thread.join()
    assert failed
    rows = held.read()[0].count()
    assert 0 < rows < 12 and held.read()[1].count() == rows
    told = indexing.index_path(held, str(tmp_path / "src"), "2024-01-02", Counting(tmp_path / "calls"))
    assert told["unchanged"] == rows and told["embedded"] == 12 - rows


def test_statistics_are_those_of_the_plan(spark, tmp_path):
    """What is counted in flight equals run_stats over the plan."""
    root = tmp_path / "src"
    _tree(root, 6)
    held = _store(spark, tmp_path / "index")
    indexing.index_path(held, str(root), "2024-01-01")
    (root / "f0.yaml").write_text("edited\n")
    (root / "f1.yaml").write_text("")
    (root / "f2.yaml").write_text("content of 3\n")
    (root / "copy.yaml").write_text("edited\n")
    chunks, _ = held.read()
    listed = tree.scan(spark, str(root))
    from quillspark.operators import chunking

    new = chunking.chunk(tree.read_files(listed))
    planned = indexing.plan(new, chunks)
    expected = indexing.run_stats(planned, chunks).first().asDict()
    got = indexing.index_path(held, str(root), "2024-01-02")
    assert {k: got[k] for k in expected} == expected == {"embedded": 1, "reused": 2, "unchanged": 3, "deleted": 1}


# ---- rules on every path into the index


def _secrets(root):
    (root / "node_modules").mkdir(parents=True)
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "keep").mkdir()
    for name in ("credentials.json", "package-lock.json", "a.min.js", "node_modules/x.js", "ok.md", "private.md", "sub/private.md", "sub/deep/private.md", "keep/private.md", ".env"):
        (root / name).write_text(f"# text of {name}\n")
    (root / C.IGNORE_FILE).write_text("# rules\nprivate.md\n")
    (root / "keep" / C.IGNORE_FILE).write_text("nothing\n")


ALLOWED = {"ok.md", "keep/private.md"}


def _names(held, root):
    return {r.source_path.removeprefix(f"{root}/") for r in held.read()[0].collect()}


def test_rules_hold_for_a_directory_and_a_rebuild(spark, tmp_path):
    root = tmp_path / "src"
    _secrets(root)
    held = _store(spark, tmp_path / "index")
    indexing.index_path(held, str(root), "2024-01-01")
    assert _names(held, root) == ALLOWED
    indexing.rebuild(held, "2024-01-02")
    assert _names(held, root) == ALLOWED


def test_rules_hold_below_the_ignore_file(spark, tmp_path):
    """A scan that begins below an ignore file finds it by walking up."""
    root = tmp_path / "src"
    _secrets(root)
    held = _store(spark, tmp_path / "index")
    indexing.index_path(held, str(root / "sub"), "2024-01-01")
    assert _names(held, root) == set()


def test_rules_hold_for_single_files_and_requests(spark, tmp_path):
    root = tmp_path / "src"
    _secrets(root)
    held = _store(spark, tmp_path / "index")
    own = service.Service(held, vectors.HashEmbedder(), home=str(tmp_path))
    for name in ("credentials.json", "node_modules/x.js", "sub/deep/private.md"):
        assert own.answer("POST", "/index", {"path": str(root / name)}) == (200, {"indexed": 0, "path": str(root / name)})
    for name in ALLOWED:
        assert own.answer("POST", "/index", {"path": str(root / name)})[1]["indexed"] == 1
    assert _names(held, root) == ALLOWED


def test_rules_hold_for_live_changes(spark, tmp_path):
    root = tmp_path / "src"
    _secrets(root)
    held = _store(spark, tmp_path / "index")
    paths = [str(p) for p in root.rglob("*") if p.is_file()]
    changes = spark.createDataFrame([(str(root), p, "modified") for p in paths], "root string, path string, event_type string")
    watch.handler(held)(changes, 0)
    assert _names(held, root) == ALLOWED


def test_scan_equals_a_walk(spark, tmp_path):
    root = tmp_path / "src"
    _secrets(root)
    (root / "keep" / ".git").mkdir()
    (root / "keep" / "in").mkdir()
    (root / "keep" / "in" / "x.py").write_text("x = 1\n")
    (root / "link.md").symlink_to(root / "ok.md")
    (root / "huge.md").write_text("x" * (C.MAX_FILE_BYTES + 1))
    got = {r.path.removeprefix(f"{root}/"): r.repo.removeprefix(str(tmp_path)) for r in tree.scan(spark, [str(root), str(root / "keep"), str(tmp_path / "none")]).collect()}
    assert got == {"ok.md": "/src", "keep/private.md": "/src/keep", "keep/in/x.py": "/src/keep"}
    walked = {p.removeprefix(f"{root}/") for p in tree.walk(str(root))}
    assert set(got) == {p for p in walked if p in {"ok.md", "keep/private.md", "keep/in/x.py"}} and walked > set(got)
    remote = {r.path: r.repo for r in tree.scan(spark, f"file://{root}").collect()}
    assert {p.split("src/")[1] for p in remote} == set(got)


def test_contents_that_are_gone_are_left_out(spark, tmp_path):
    root = tmp_path / "src"
    _tree(root, 3)
    listed = tree.scan(spark, str(root))
    (root / "f1.yaml").unlink()
    assert {r.source_path[-7:] for r in tree.read_files(listed).collect()} == {"f0.yaml", "f2.yaml"}


def test_service_refuses_odd_requests(spark, tmp_path):
    own = service.Service(_store(spark, tmp_path / "index"), vectors.HashEmbedder(), home=str(tmp_path))
    for top_k in (0, -1, 10**6, True, "x"):
        assert own.answer("POST", "/search", {"query": "x", "top_k": top_k})[0] == 422
    for body in ([], "x", 3):
        assert own.answer("POST", "/search", body)[0] == 422
    assert json.dumps(own.answer("POST", "/search", None)[1])
