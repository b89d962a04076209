"""Reading directory trees."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import constants as C
from quillspark.functions import files
from quillspark.sources.shared import scratch


def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore") if b is not None else None)


def decode(content: Column) -> Column:
    """UTF-8, without the bytes that aren't."""
    return F.pandas_udf(_decoded, T.StringType())(content)


def walk(root: str) -> Iterator[str]:
    """Paths of files below a local root; no links, no pruned or hidden directories."""
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in C.PRUNED_DIRS and not d.startswith(".") and not os.path.islink(os.path.join(top, d)))
        yield from (p for n in sorted(names) if not os.path.islink(p := os.path.join(top, n)))


@lru_cache(4096)
def canonical(path: str) -> str:
    """The spelling of a path that its directories list."""
    head, tail = os.path.split(path)
    if not tail:
        return path
    head = canonical(head)
    try:
        names = os.listdir(head)
    except OSError:
        return os.path.join(head, tail)
    return os.path.join(head, tail if tail in names else next((n for n in names if n.lower() == tail.lower()), tail))


def _split(path: str):
    """(file system, place in it, what stands before the place) of a path; None and the path for local ones."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return None, path, ""
    if scheme == "file":
        return None, "/" + rest.lstrip("/"), ""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system, place, path[: len(path) - len(place)]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _listing(system, place: str) -> list[tuple[str, int, int, bool]] | None:
    """(name, bytes, time in microseconds, whether a directory) of what a directory holds, or of the file itself under ""; no links."""
    if system is None:
        try:
            if not os.path.isdir(place):
                own = os.stat(place)
                return [("", own.st_size, own.st_mtime_ns // 1000, False)]
            told = []
            with os.scandir(place) as entries:
                for e in entries:
                    if not e.is_symlink():
                        own = e.stat()
                        told.append((e.name, own.st_size, own.st_mtime_ns // 1000, e.is_dir()))
            return told
        except OSError:
            return None
    from pyarrow import fs

    own = system.get_file_info(place)
    if own.type == fs.FileType.NotFound:
        return None
    if own.type == fs.FileType.File:
        return [("", own.size, (own.mtime_ns or 0) // 1000, False)]
    return [(f.base_name, f.size or 0, (f.mtime_ns or 0) // 1000, f.type == fs.FileType.Directory) for f in system.get_file_info(fs.FileSelector(place))]


def _there(system, place: str) -> bool:
    if system is None:
        return os.path.exists(place)
    from pyarrow import fs

    return system.get_file_info(place).type != fs.FileType.NotFound


def _rules(system, place: str) -> list[str]:
    """The patterns of an ignore file; none if it can't be read."""
    try:
        if system is None:
            with open(place, encoding="utf-8") as f:
                text = f.read()
        else:
            with system.open_input_file(place) as f:
                text = f.read().decode()
    except (OSError, UnicodeDecodeError):
        return []
    return [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]


def _above(system, place: str) -> tuple[str | None, list[str]]:
    """The nearest directory with a ``.git``, and the patterns of the nearest ignore file, at or above a directory."""
    repo = rules = None
    while repo is None or rules is None:
        if repo is None and _there(system, f"{place.rstrip('/')}/.git"):
            repo = place
        if rules is None and _there(system, own := f"{place.rstrip('/')}/{C.IGNORE_FILE}"):
            rules = _rules(system, own)
        if place in ("", "/") or "/" not in place:
            break
        place = os.path.dirname(place)
    return repo, rules or []


def ignored(path: str, rules: list[str]) -> bool:
    """Whether a pattern of the nearest ignore file matches the name or a part of the path, as ``files.ignored`` tells it in Spark."""
    parts = path.split("/")
    return any(any(map(re.compile(files.glob_regex(r.rstrip("/")), re.DOTALL).match, parts)) for r in rules)


#: What a round of a scan finds: files to look at, and directories that the next round lists.
ENTRY = "path string, length long, modified long, directory boolean, single boolean, root string, repo string, rules array<string>"


def _found(batches):
    """Lists directories; git roots and ignore rules come down with each of them, and are looked for above the first."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = ["path", "length", "modified", "directory", "single", "root", "repo", "rules"]
    for batch in batches:
        rows = []
        for path, root, repo, rules in zip(*(batch.column(c).to_pylist() for c in ("path", "root", "repo", "rules")), strict=True):
            system, place, head = _split(path)
            held = _listing(system, place)
            if held is None:
                continue
            if rules is None:  # where a scan begins
                repo, rules = _above(system, os.path.dirname(place) if held and held[0][0] == "" else place)
                repo = head + repo if repo else None
            own = {n for n, *_ in held}
            if ".git" in own:
                repo = path
            if C.IGNORE_FILE in own:
                rules = _rules(system, f"{place.rstrip('/')}/{C.IGNORE_FILE}")
            for name, size, time, directory in held:
                at = f"{path.rstrip('/')}/{name}" if name else path
                if directory:
                    if name not in C.PRUNED_DIRS and not name.startswith("."):
                        rows.append((at, 0, 0, True, False, root, repo, rules))
                elif not ignored(_split(at)[1], rules):
                    rows.append((at, size, time, False, not name, root, repo, []))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)


def top(root: str) -> str:
    """A root as scans name it: in its directories' spelling, links followed."""
    system, place, _ = _split(root)
    return (canonical(os.path.realpath(place)).rstrip("/") or "/") if system is None else root.rstrip("/")


def scan(spark: SparkSession, roots: str | list[str], within: list[str] | None = None) -> DataFrame:
    """(path, length, modified, root, repo) of the files to index below directories, and of single files.

    Executors list directories, round by round from the roots down, so no list of paths
    comes to the driver; rounds are stored in the shared folder. Every file, single ones too,
    passes the ignore files, the skip rules and the size gate. Names are judged below the
    root they are found under; a single file's below the one of ``within`` that holds it, else
    by its whole path. Roots that don't exist are left out.
    """
    tops = [top(root) for root in ([roots] if isinstance(roots, str) else roots)]
    folder = scratch(spark, "scan")
    due = spark.createDataFrame([(t, t, None, None) for t in dict.fromkeys(tops)], "path string, root string, repo string, rules array<string>")
    k = 0
    while True:
        due.repartition(max(1, len(tops) // DIRS_A_TASK) if not k else due.sparkSession.sparkContext.defaultParallelism).mapInArrow(_found, ENTRY).write.parquet(f"{folder}/{k:04d}")
        due = spark.read.schema(ENTRY).parquet(f"{folder}/{k:04d}").where("directory").select("path", "root", "repo", "rules")
        if due.isEmpty():
            break
        k += 1
    found = spark.read.schema(ENTRY).parquet(*(f"{folder}/{i:04d}" for i in range(k + 1))).where(~F.col("directory") & files.small(F.col("length")))
    below = lambda w: F.when(F.col("path").startswith(w.rstrip("/") + "/"), F.substring("path", len(w.rstrip("/")) + 2, 1 << 30))
    known = sorted({canonical(os.path.realpath(w)) if _split(w)[0] is None else w for w in within or []}, key=len, reverse=True)
    own = F.coalesce(*map(below, known), F.col("path")) if known else F.col("path")
    relative = F.when(F.col("single"), own).otherwise(F.substring("path", F.length(F.rtrim(F.col("root"), F.lit("/"))) + 2, F.length("path")))
    kept = found.where(~files.skipped(relative) & (F.col("single") | ~files.pruned(relative)))
    best = kept.groupBy("path").agg(F.min_by(F.struct("length", "modified", "root", "repo"), F.struct(F.col("single"), F.length("root"))).alias("f"))
    home = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return best.select("path", "f.length", "f.modified", "f.root", F.coalesce("f.repo", home).alias("repo"))


#: Roots or single files that a task of a scan's first round looks at.
DIRS_A_TASK = 200


def _contents(batches):
    """Paths with their bytes, whatever file names start with (Spark's own source hides names with a dot or an underscore)."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for path, repo in zip(batch.column("path").to_pylist(), batch.column("repo").to_pylist(), strict=True):
            system, place, _ = _split(path)
            try:
                with (system or fs.LocalFileSystem()).open_input_file(place) as f:
                    held = f.read()
            except (FileNotFoundError, PermissionError):
                continue  # gone since it was listed, or not ours to read
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([repo], pa.string()), pa.array([held], pa.binary())], names=["path", "repo", "content"])


#: Files that a task reads.
FILES_A_TASK = 2000


def read_files(listed: DataFrame) -> DataFrame:
    """Text files among scanned ones (path, repo): (source_path, repo, language, content). Files that are left out are never read."""
    tasks = max(1, -(-listed.count() // FILES_A_TASK))
    kept = listed.select("path", "repo").repartition(tasks).mapInArrow(_contents, "path string, repo string, content binary")
    kept = kept.where(~files.is_binary(F.col("content"))).select("path", "repo", decode("content").alias("content"))
    return kept.select(F.col("path").alias("source_path"), "repo", files.language(F.col("path")).alias("language"), "content")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files to index below a root: (source_path, repo, language, content)."""
    return read_files(scan(spark, root))
