"""Expressions over file paths: globs, skipping, languages, repositories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C


def glob_regex(glob: str) -> str:
    """A shell pattern (``*``, ``?``, ``[...]``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "[" and close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(ch, re.escape(ch))
        i += 1
    return f"^{out}$"


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows it, unless the name starts there."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in C.LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(suffix(path))), F.lit("unknown"))


def pruned(path: Column) -> Column:
    """Whether a directory on the way is never entered: listed ones and hidden ones."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, C.PRUNED_DIRS))) | F.exists(parts, lambda p: p.rlike(r"^\.[^.]"))


def skipped(path: Column) -> Column:
    """Whether a file is left out by its path relative to the root."""
    listed = reduce(lambda a, b: a | b, (name(path).rlike(glob_regex(g)) for g in C.SKIPPED_NAMES))
    hidden = name(path).startswith(".") & ~suffix(path).isin(*C.SHOWN_DOTFILES)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, C.PRUNED_DIRS))) | listed | hidden


def ancestors(path: Column) -> Column:
    """All directories above a path, from the root on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def nearest(files: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``files`` with the deepest of ``roots`` (a column of directories) above each path, or null."""
    above = files.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("_dir"))
    found = above.join(roots.select(F.col(column).alias("_dir")).distinct(), "_dir").groupBy("path").agg(F.max_by("_dir", F.length("_dir")).alias(column))
    return files.join(found, "path", "left")


def repository(files: DataFrame, git_roots: DataFrame) -> DataFrame:
    """``files`` (path) with ``repo``: the nearest git root, else the file's directory."""
    own = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return nearest(files, git_roots, "repo").withColumn("repo", F.coalesce("repo", own))


def ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``files`` with ``ignored``: whether a pattern (dir, pattern) of the nearest ignore file matches the name or a part of the path."""
    rules = patterns.where(~F.col("pattern").startswith("#") & (F.trim("pattern") != "")).select("dir", F.trim("pattern").alias("pattern"))
    regex = F.udf(lambda p: glob_regex(p.rstrip("/")), "string")  # a handful of rows
    grouped = rules.withColumn("regex", regex("pattern")).groupBy("dir").agg(F.collect_set("regex").alias("rules"))
    near = nearest(files, patterns, "dir").join(grouped, "dir", "left")
    parts = F.split(F.col("path"), "/")
    return near.withColumn("ignored", F.coalesce(F.exists("rules", lambda r: F.exists(parts, lambda p: F.rlike(p, r))), F.lit(False))).drop("rules")


def small(length: Column) -> Column:
    """Whether a file of so many bytes is indexed."""
    return length <= C.MAX_FILE_BYTES


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, C.BINARY_SNIFF_BYTES)) > 0
