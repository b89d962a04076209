"""Debouncing with timers, and changes found by comparing listings."""

import shutil
import time
from datetime import datetime

from pyspark.sql import functions as F

from quillspark.operators import store
from quillspark.plans import catalog
from quillspark.sources import changes
from quillspark.streaming import watch

EVENT = "path string, event_type string, ts timestamp, seq long, root string"


def _until(done, seconds=120):
    end = time.time() + seconds
    while not done():
        assert time.time() < end, "nothing came"
        time.sleep(0.2)


def _events(spark, folder, rows):
    frame = spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def _run(spark, tmp_path, seen, **how):
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    return watch.run(stream, lambda frame, _: seen.extend(tuple(r) for r in frame.collect()), str(tmp_path / "cp"), **how)


def test_the_last_burst_needs_no_later_event(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    _events(spark, tmp_path / "in", [("/x.py", "created", at(0), 0, "r"), ("/x.py", "modified", at(1), 1, "r"), ("/y.py", "created", at(2), 2, "r"), ("/z.png", "created", at(2), 3, "r"), ("/x.py", "deleted", at(20), 4, "r"), (None, "created", at(20), 5, "r"), ("/o.py", "created", at(1), 6, None)])
    seen = []
    query = _run(spark, tmp_path, seen, gap_ms=5000)
    try:
        want = {("/x.py", "modified", at(0)), ("/y.py", "created", at(0)), ("/x.py", "deleted", at(20)), ("/o.py", "created", at(1))}
        told = lambda: {(p, e, str(b)) for _, b, p, e in seen}
        _until(lambda: told() == want)
        # what is pending when a query stops comes out after a restart from its checkpoint
        _events(spark, tmp_path / "in", [("/late.py", "created", "2024-01-01 01:00:00", 7, "r")])
        _until(lambda: any(p["numInputRows"] for p in query.recentProgress[-3:]))
    finally:
        query.stop()
    query = _run(spark, tmp_path, seen, gap_ms=5000)
    try:
        _until(lambda: ("/late.py", "created", "2024-01-01 01:00:00") in told())
        assert len(seen) == 5
    finally:
        query.stop()


def test_a_burst_that_goes_on_comes_out_after_the_longest_wait(spark, tmp_path):
    seen, n = [], 0
    _events(spark, tmp_path / "in", [("/x.py", "modified", "2024-01-01 00:00:00", 0, "r")])
    query = _run(spark, tmp_path, seen, gap_ms=60_000, longest_ms=4_000)
    try:
        end = time.time() + 60
        while not seen:
            assert time.time() < end
            n += 1
            _events(spark, tmp_path / "in", [("/x.py", "modified", f"2024-01-01 00:00:{n:02d}", n, "r")])
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r[2:] for r in seen] == [("/x.py", "modified")]


def test_bursts_equal_the_batch(spark, tmp_path):
    """Events of sf0.01 in order, in several batches: the bursts of watch_live."""
    sf = "/root/testdata/sf0.01"
    rows = watch.expand_moves(catalog._events(spark, sf)).select("path", "event_type", "ts", "seq", "root").orderBy("ts", "seq")
    ordered = rows.repartitionByRange(4, "ts").sortWithinPartitions("ts", "seq")
    ordered.write.parquet(str(tmp_path / "all"))
    (tmp_path / "in").mkdir()
    seen, stream = [], spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, p in enumerate(sorted((tmp_path / "all").glob("part-*"))):
        shutil.copy(p, tmp_path / "in" / f"part-{k}.parquet")
        time.sleep(1.1)  # a file stream goes by the files' times
    want = {(r.root, r.burst_start, r.path, r.event_type) for r in catalog.QUERIES["watch_live"](spark, sf).collect()}
    newest = {root: max(b for r, b, *_ in want if r == root) for root, *_ in want}
    query = watch.run(stream, lambda frame, _: seen.extend((r.root, str(r.burst_start)[:19], r.path, r.event_type) for r in frame.collect()), str(tmp_path / "cp"), gap_ms=120_000, longest_ms=10**9, processingTime="100 milliseconds")
    try:
        # a root's last burst still waits for its silence of two minutes
        _until(lambda: all(b == newest[r] for r, b, *_ in want - set(seen)), 90)
    finally:
        query.stop()
    assert set(seen) <= want and len(seen) == len(set(seen))


def test_listings_compared(spark, tmp_path):
    root, folder = tmp_path / "src", str(tmp_path / "watch")
    root.mkdir()
    for n in ("a.py", "b.py", "c.py", "credentials.json"):
        (root / n).write_text("x\n")
    roots = [str(root), str(tmp_path / "none")]
    told = lambda v: {(r.path.rsplit("/", 1)[1], r.event_type) for r in changes._held(spark, f"{folder}/events", changes.EVENTS).where(f"version = {v}").collect()}
    assert changes.poll(spark, roots, folder) == 1 and told(1) == set()
    (root / "a.py").write_text("longer\n")
    (root / "b.py").unlink()
    (root / "d.py").write_text("new\n")
    (root / "credentials.json").write_text("never told\n")
    assert changes.poll(spark, roots, folder) == 2 and told(2) == {("a.py", "modified"), ("b.py", "deleted"), ("d.py", "created")}
    assert changes.poll(spark, roots, folder) == 3 and told(3) == set()
    # a root that is away keeps its files; when it is back, only what changed is told
    root.rename(tmp_path / "away")
    assert changes.poll(spark, roots, folder) == 4 and told(4) == set()
    (tmp_path / "away" / "c.py").unlink()
    (tmp_path / "away").rename(root)
    assert changes.poll(spark, roots, folder) == 5 and told(5) == {("c.py", "deleted")}


def test_a_stopped_poll_is_made_good(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "src", str(tmp_path / "watch")
    root.mkdir()
    (root / "a.py").write_text("x\n")
    changes.poll(spark, [str(root)], folder)
    (root / "b.py").write_text("y\n")
    monkeypatch.setattr(changes, "_tell", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    try:
        changes.poll(spark, [str(root)], folder)
    except RuntimeError:
        pass
    monkeypatch.undo()
    (root / "c.py").write_text("z\n")
    assert changes.poll(spark, [str(root)], folder) == 3
    rows = spark.read.parquet(f"{folder}/events").collect()
    assert {(r.path[-4:], r.version) for r in rows} == {("b.py", 2), ("c.py", 3)}


def test_follow_brings_changes_to_the_store(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.md").write_text("# One\n")
    (root / "b.md").write_text("# Two\n")
    held = store.SnapshotStore(spark, str(tmp_path / "index"), "hashed-bag-of-words")
    query = watch.follow(held, [str(root), str(tmp_path / "none")], str(tmp_path / "watch"), str(tmp_path / "cp"))
    names = lambda: {(r.source_path.rsplit("/", 1)[1], r.content) for r in held.read()[0].collect()}
    try:
        assert names() == {("a.md", "# One"), ("b.md", "# Two")}
        (root / "a.md").write_text("# Changed\n")
        (root / "b.md").unlink()
        (root / "c.md").write_text("# Three\n")
        changes.poll(spark, [str(root)], str(tmp_path / "watch"), datetime.now())
        _until(lambda: names() == {("a.md", "# Changed"), ("c.md", "# Three")})
    finally:
        query.stop()
