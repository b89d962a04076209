"""Merging, deleting, notes, export and import, and snapshots of the index tables."""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import identity
from quillspark.operators import keyword, search
from quillspark.schema import CHUNKS, EXPORT, POSTINGS, VECTORS
from quillspark.sources.shared import release


def last_by_id(batch: DataFrame, order: str | None = None) -> DataFrame:
    """Of rows with one id the last by ``order``; without one the last as the batch lists them."""
    w = Window.partitionBy("id").orderBy(F.desc(order or "_place"))
    if order is None:
        batch = batch.withColumn("_place", F.monotonically_increasing_id())
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_place")


def upsert(existing: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``batch`` in place of those with their ids; of repeated ids the last row counts."""
    new = last_by_id(batch, order)
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new.select(*existing.columns))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix itself or lies below it, component by component."""
    return (path == prefix.rstrip("/")) | path.startswith(prefix.rstrip("/") + "/")


def delete_source(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("source_path") != path)


def count_prefix(chunks: DataFrame, prefix: str, strict_compat: bool = False) -> DataFrame:
    """How many chunks ``delete_prefix`` removes, as one row ``removed``."""
    return chunks.agg(F.count(F.when(_by_prefix(prefix, strict_compat), 1)).alias("removed"))


def _by_prefix(prefix: str, strict_compat: bool) -> Column:
    return F.col("source_path").ilike(prefix + "%") if strict_compat else under(F.col("source_path"), prefix)


def delete_prefix(chunks: DataFrame, prefix: str, strict_compat: bool = False) -> DataFrame:
    """``strict_compat`` deletes by an unescaped, case-blind LIKE instead of by path components."""
    return chunks.where(~_by_prefix(prefix, strict_compat))


def delete_index(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the chunks named by (source_path, chunk_index)."""
    ids = gone.select(identity.chunk_id(F.col("source_path"), F.col("chunk_index")).alias("id"))
    return chunks.join(ids, "id", "left_anti")


def cascade(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the ids: all of them change in the same snapshot."""
    return [t.join(ids, "id", "left_anti") for t in tables]


def notes(rows: DataFrame) -> DataFrame:
    """Chunks from notes (text, tags, at)."""
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    content = identity.tagged(F.col("text"), F.col("tags"))
    path = F.concat(F.lit(C.NOTE_PREFIX), identity.note_id(F.col("text"), at))
    return rows.select(
        identity.chunk_id(path, F.lit(0)).alias("id"), content.alias("content"), identity.content_hash(content).alias("content_hash"), path.alias("source_path"),
        F.lit(C.NOTE_REPO).alias("repo"), F.lit(C.NOTE_LANGUAGE).alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("at").alias("indexed_at"),
    )


def list_notes(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("repo") == C.NOTE_REPO).orderBy(F.desc("indexed_at"), "id")


def delete_note(chunks: DataFrame, note: str) -> tuple[DataFrame, DataFrame]:
    """The chunks without a note, and whether it was there as one row ``found``."""
    path = note if note.startswith(C.NOTE_PREFIX) else C.NOTE_PREFIX + note
    return delete_source(chunks, path), chunks.agg(F.coalesce(F.bool_or(F.col("source_path") == path), F.lit(False)).alias("found"))


def forget_route(targets: DataFrame, files: DataFrame) -> DataFrame:
    """``targets`` (target) with ``route``: note, file (listed in files.path) or prefix."""
    known = targets.join(files.select(F.col("path").alias("target")).distinct().withColumn("_file", F.lit(True)), "target", "left")
    route = F.when(identity.is_note_id(F.col("target")), "note").when(F.col("_file"), "file").otherwise("prefix")
    return known.select("target", route.alias("route"))


def case_duplicates(files: DataFrame) -> DataFrame:
    """Paths to drop among (file_key, path, canonical): all spellings of a file but the canonical one."""
    w = Window.partitionBy("file_key").orderBy(F.desc("canonical"), "path")
    return files.select("file_key", "path", "canonical").distinct().withColumn("_n", F.row_number().over(w)).where("_n > 1").select("file_key", "path")


def export_rows(chunks: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    return chunks.join(vectors, "id").withColumn("embed_model", F.lit(model))


def export_jsonl(chunks: DataFrame, vectors: DataFrame, path: str, model: str | None = None) -> None:
    export_rows(chunks, vectors, model).write.mode("overwrite").json(path)


class ImportMismatch(ValueError):
    """An import file whose vectors don't fit the index."""


def import_jsonl(spark: SparkSession, path: str, dim: int, model: str | None = None) -> DataFrame:
    """Rows of an export; malformed lines fail the read, other dimensions or models raise ImportMismatch."""
    rows = spark.read.schema(EXPORT).option("mode", "FAILFAST").json(path)
    first = rows.select(F.size("vector").alias("dim"), "embed_model").limit(1).collect()
    if first and first[0]["dim"] != dim:
        raise ImportMismatch(f"vectors have {first[0]['dim']} dimensions, the index {dim}")
    if first and model and first[0]["embed_model"] not in (None, model):
        raise ImportMismatch(f"vectors come from {first[0]['embed_model']}, the index uses {model}")
    return rows


def import_merge(existing: DataFrame, rows: DataFrame, replace: bool = False) -> DataFrame:
    """Imported rows merged by id; ``replace`` first drops what the index has of their repositories (notes stay)."""
    if replace:
        repos = rows.select("repo").where(F.col("repo") != C.NOTE_REPO).distinct()
        existing = existing.join(repos, "repo", "left_anti").select(*existing.columns)
    return upsert(existing, rows)


def add_notes(chunks: DataFrame, vectors: DataFrame, rows: DataFrame, embedder=None) -> tuple[DataFrame, DataFrame]:
    """The tables with notes (text, tags, at) embedded and merged in."""
    from quillspark.operators import indexing

    made = notes(rows).dropDuplicates(["id"])
    fresh = indexing.embed(made.select("content_hash", "content").dropDuplicates(["content_hash"]), embedder)
    own = made.select("id", "content_hash").join(fresh, "content_hash").select("id", "vector")
    return upsert(chunks, made.select(*chunks.columns)), upsert(vectors, own)


class StaleBase(OSError):
    """A commit made from a snapshot that isn't the newest any more."""


@dataclass
class Snapshot:
    """What a manifest names: its number, the live tables and the stored keyword index."""

    number: int
    told: dict
    chunks: DataFrame
    vectors: DataFrame
    postings: search.Postings | None


#: The newest segments are merged as soon as one has fewer rows than this many times all newer ones: their number stays logarithmic.
MERGE_FACTOR = 2
#: Dead ids of a segment up to which readers name them in a filter.
FEW_DEAD = 500
#: Chunks of a segment from which on their shuffle files are deleted before postings are written.
RELEASED = 10_000
#: Dead ids up to which they are sent to all rows; beyond, rows are dealt by id to meet them.
SENT_DEAD = 1_500_000


class SnapshotStore:
    """Index tables as segments of Parquet files, listed by numbered manifests.

    A segment is written once: chunks, vectors and postings, and under ``dead`` the ids of
    chunks in older segments that it replaces or removes. What is live is the union of all
    segments without the rows that a newer segment has declared dead; a change therefore
    writes its own rows only. After a change, small neighbouring segments are merged, newest
    first, by the same union. ``commit`` writes all tables anew as one segment.

    A manifest is published under the number after its base's by a rename that fails where
    that number exists, so of two writers with one base the second gets ``StaleBase`` and
    nothing is lost. The base is the snapshot that the writer's thread read last, or the one
    it names. Readers take the newest manifest. ``vacuum`` deletes what old ones named.
    """

    def __init__(self, spark: SparkSession, path: str, embed_model: str | None = None, embed_dim: int = C.EMBED_DIM):
        self.spark, self.path = spark, path.rstrip("/")
        self.model, self.dim = embed_model, embed_dim
        self._seen = threading.local()
        self._few: dict[str, list[str]] = {}

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs("manifests")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _told(self, number: int) -> dict:
        fs, p = self._fs(f"manifests/{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest manifest; empty where nothing was committed yet."""
        numbers = self._numbers()
        return self._told(numbers[-1]) if numbers else {}

    def snapshot(self, any_model: bool = False) -> Snapshot:
        """The newest snapshot, which becomes the base of this thread's next commit."""
        number = (self._numbers() or [0])[-1]
        told = self._told(number) if number else {}
        if told and self.model and not any_model and told.get("embed_model") not in (None, self.model):
            raise ImportMismatch(f"the index was made with {told['embed_model']}")
        self._seen.number = number
        segments = told.get("segments", [])
        chunks, vectors = (self._live(segments, name, schema) for name, schema in (("chunks", CHUNKS), ("vectors", VECTORS)))
        return Snapshot(number, told, chunks, vectors, search.Postings(self._live(segments, "postings", POSTINGS), told["chunks"], told["terms"]) if told else None)

    def _table(self, version: str, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{version}/{name}")

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        """(id, _until): ids that a segment declares dead in older ones, with its place."""
        parts = [self._table(s["version"], "dead", "id string").withColumn("_until", F.lit(s["at"])) for s in segments if s["dead"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _named(self, segment: dict) -> list[str]:
        """The dead ids of a segment that declares few; segments don't change, so each is read once."""
        if segment["version"] not in self._few:
            self._few[segment["version"]] = [r[0] for r in self._table(segment["version"], "dead", "id string").collect()]
        return self._few[segment["version"]]

    def _live(self, segments: list[dict], name: str, schema) -> DataFrame:
        """The union of the segments' rows without those that a newer segment declares dead: by name where a segment declares few, else by a join.

        Texts and postings aren't shuffled for that join unless there are very many dead ids.
        """
        if not segments:
            return self.spark.createDataFrame([], schema)
        few = [s for s in segments if 0 < s["dead"] <= FEW_DEAD]
        many = [s for s in segments if s["dead"] > FEW_DEAD]
        newest, parts, mixed = max((s["at"] for s in many), default=0), [], []
        for s in segments:
            rows = self._table(s["version"], name, schema)
            if ids := sorted({i for n in few if n["at"] > s["at"] for i in self._named(n)}):
                rows = rows.where(~F.col("id").isin(ids))
            if s["at"] < newest:
                mixed.append(rows.withColumn("_at", F.lit(s["at"])))
            else:
                parts.append(rows)
        if mixed:
            rows, dead = reduce(DataFrame.unionByName, mixed), self._dead(many)
            if sum(s["dead"] for s in many) <= SENT_DEAD:
                dead = F.broadcast(dead)
            gone = (rows["id"] == dead["id"]) & (rows["_at"] < dead["_until"])
            parts.append(rows.join(dead, gone, "left_anti").drop("_at"))
        return reduce(DataFrame.unionByName, parts)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(chunks, vectors) of the newest snapshot."""
        held = self.snapshot()
        return held.chunks, held.vectors

    def postings(self) -> search.Postings | None:
        """The stored keyword index of the newest snapshot."""
        return self.snapshot().postings

    def search(self, query: list[float] | None, words: str = "", top_k: int = 10, repo: str | None = None, mode: str = "hybrid", include_notes: bool = True) -> DataFrame:
        """Search over the newest snapshot; keyword modes read the postings of the query's terms only."""
        held = self.snapshot()
        return search.search(held.chunks, held.vectors, query, words, top_k, repo, mode, include_notes, held.postings)

    def explain(self, query: list[float], words: str, top_k: int = 8, repo: str | None = None) -> DataFrame:
        held = self.snapshot()
        return search.explain(held.chunks, held.vectors, query, words, top_k, repo, held.postings)

    def staged(self, rows: DataFrame, label: str, *counted: Column) -> tuple[DataFrame, dict]:
        """Rows written below the store and read back, and what was counted on the way: later steps see exactly these rows, whatever is lost."""
        path, seen = f"{self.path}/staged/{label}-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, *(counted or (F.count(F.lit(1)).alias("n"),))).write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        out._staged = path
        return out, seen.get

    def unstage(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, p = self._fs(t._staged.removeprefix(f"{self.path}/"))
            fs.delete(p, True)

    def _write(self, chunks: DataFrame, vectors: DataFrame, dead: DataFrame | None, at: int, files: int | None, postings: DataFrame | None = None) -> tuple[dict, int]:
        """Writes a segment; returns what a manifest says of it and its count of terms.

        Chunks are clustered by repository and path, and each file of postings is sorted by
        term, so that their statistics prune; ids, paths and hashes carry Bloom filters for
        lookups of a few. ``files`` deals a small segment to so many files without looking at
        its rows first. Postings are made from the text, unless ``postings`` has them, and
        only once. They are the largest table, so those of a large segment are sorted where
        they are made, without a shuffle; shuffle files of the chunks go before that.
        """
        version = uuid.uuid4().hex
        base = f"{self.path}/{version}"

        def clustered(rows: DataFrame, *keys: str) -> DataFrame:
            return (rows.repartitionByRange(*keys) if files is None else rows.repartition(files, keys[0])).sortWithinPartitions(*keys)

        def write(rows: DataFrame, name: str, bloom: tuple[str, ...], *counted: Column) -> dict:
            seen, out = Observation(), rows
            if counted:
                out = rows.observe(seen, *counted)
            w = out.write.option("compression", "zstd")
            for c in bloom:
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "100000")
            w.parquet(f"{base}/{name}")
            return seen.get if counted else {}

        n = F.count(F.lit(1)).alias("n")

        def texts() -> tuple[int, int]:
            count = write(clustered(chunks.select(*CHUNKS.names), "repo", "source_path", "chunk_index"), "chunks", ("id", "source_path", "content_hash"), n)["n"]
            if files is None and count >= RELEASED:
                release(self.spark)
            rows = postings.select(*POSTINGS.names) if postings is not None else keyword.postings(self._table(version, "chunks", CHUNKS).select("id", "content"))
            dealt = rows if files is None else rows.repartition(files, "term")
            return count, write(dealt.sortWithinPartitions("term", "id"), "postings", ("term",), F.coalesce(F.sum("tf"), F.lit(0)).alias("n"))["n"]

        def rest() -> int:
            own = vectors.select(*VECTORS.names)
            write(own if files is None else own.repartition(files, "id"), "vectors", ("id",))
            return write(dead.select("id") if files is None else dead.select("id").coalesce(1), "dead", ("id",), n)["n"] if dead is not None else 0

        with ThreadPoolExecutor(1) as other:  # tables that don't need each other are written side by side
            later = other.submit(inheritable_thread_target(self.spark)(rest))
            count, terms = texts()
            return {"version": version, "at": at, "chunks": count, "dead": later.result()}, terms

    def _publish(self, number: int, told: dict) -> None:
        """Writes the manifest under its number, unless there is one."""
        jvm = self.spark.sparkContext._jvm
        fs, new = self._fs(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        _, place = self._fs(f"manifests/{number:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(place), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(place):
                raise StaleBase(f"another writer has published snapshot {number} of {self.path}") from e
            raise
        self._seen.number = number

    def _base(self, base: int | None) -> int:
        seen = getattr(self._seen, "number", None) if base is None else base
        newest = (self._numbers() or [0])[-1]
        if seen is not None and seen != newest:  # before any work; the rename decides
            raise StaleBase(f"snapshot {newest} of {self.path} is newer than {seen}, which this commit is made from")
        return newest

    def _manifest(self, segments: list[dict], chunks: int, terms: int) -> dict:
        return {"version": segments[-1]["version"], "segments": segments, "schema_version": C.SCHEMA_VERSION, "embed_model": self.model, "embed_dim": self.dim, "chunks": chunks, "terms": terms}

    def commit(self, chunks: DataFrame, vectors: DataFrame, base: int | None = None) -> str:
        """Writes all tables anew as one segment and publishes it."""
        number = self._base(base) + 1
        segment, terms = self._write(chunks, vectors, None, number, None)
        self._publish(number, self._manifest([segment], segment["chunks"], terms))
        return segment["version"]

    def change(self, rows: DataFrame, vectors: DataFrame, gone: DataFrame, base: int | None = None, files: int | None = None) -> str:
        """Publishes a segment with new ``rows`` and their vectors, in which the live chunks ``gone`` (id, content) are dead.

        A row that replaces a live chunk of its id must have that chunk in ``gone``.
        """
        number = self._base(base) + 1
        told = self._told(number - 1) if number > 1 else {}
        gone, lost = self.staged(keyword.lengths(gone.select("id", "content")), "gone", F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("terms"))
        segment, terms = self._write(rows, vectors, gone, number, files)
        self.unstage(gone)
        segments = self._merged([*told.get("segments", []), segment])
        self._publish(number, self._manifest(segments, told.get("chunks", 0) + segment["chunks"] - lost["n"], told.get("terms", 0) + terms - lost["terms"]))
        return segments[-1]["version"]

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The segments after merging the newest ones where sizes ask for it; one merge takes all it must."""
        size = [s["chunks"] + s["dead"] for s in segments]
        first = len(segments)
        for i in range(len(segments) - 2, -1, -1):
            if size[i] < MERGE_FACTOR * sum(size[i + 1 :]):
                first = i
        if first >= len(segments) - 1:
            return segments
        own = segments[first:]
        dead = None
        if first:  # what they declare dead in older ones stays so
            held = self._dead(own)
            dead = held.select("id").distinct() if held is not None else None
        chunks, vectors, postings = (self._live(own, name, schema) for name, schema in (("chunks", CHUNKS), ("vectors", VECTORS), ("postings", POSTINGS)))
        merged, _ = self._write(chunks, vectors, dead, own[-1]["at"], None, postings)
        fs, p = self._fs(own[-1]["version"])  # this change's own, which no manifest names
        fs.delete(p, True)
        return [*segments[:first], merged]

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all snapshots but the newest ``keep``, and returns how many; unpublished folders stay, a writer may be at work."""
        numbers = self._numbers()
        old, new = numbers[: -max(keep, 1)], numbers[-max(keep, 1) :]
        named = {s["version"] for n in new for s in self._told(n)["segments"]}
        for number in old:
            unused = {s["version"] for s in self._told(number)["segments"]} - named
            for name in (*unused, f"manifests/{number:012d}.json"):
                fs, p = self._fs(name)
                fs.delete(p, True)
        return len(old)
