"""Splitters: a text column to an array of chunks (content, start_line, end_line)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import constants as C
from quillspark.functions import identity
from quillspark.schema import RAW_CHUNK

BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
_NONE = f"cast(array() as array<{RAW_CHUNK.simpleString()}>)"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not anew wherever a lambda mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def lines(text: Column) -> Column:
    """Lines at any line break, without an empty one after the last."""
    return _let(F.split(text, BREAKS, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _chunk(content: Column, start: Column, end: Column) -> Column:
    return F.struct(content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def _full(chunks: Column) -> Column:
    return F.filter(chunks, lambda c: c["content"].rlike(r"(?U)\S"))


def windows(rows: Column, first: Column | None = None) -> Column:
    """Overlapping windows of lines; blank ones drop out. ``first``: line number of the first line."""
    return _let(rows, lambda r: _windows(r, F.lit(1) if first is None else first))


def _windows(rows: Column, first: Column) -> Column:
    n = F.size(rows)
    made = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(C.CHUNK_STRIDE)),
        lambda i: _chunk(F.array_join(F.slice(rows, i + 1, F.lit(C.CHUNK_LINES)), "\n"), first + i, first + F.least(i + C.CHUNK_LINES, n) - 1),
    )
    return F.when(n > 0, _full(made)).otherwise(F.expr(_NONE))


def _sections(rows: Column, starts: Column, strip: bool) -> Column:
    """Chunks from each start (1-based, ascending) to the line before the next."""
    n = F.size(rows)

    def section(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1) - 1, n)
        content = F.array_join(F.slice(rows, at, F.greatest(end - at + 1, F.lit(0))), "\n")
        return _chunk(_strip(content) if strip else content, at, end)

    return _full(F.transform(starts, section))


def headings(rows: Column) -> Column:
    """A section from each line that starts with ``#``, and one for what comes before."""
    return _let(rows, _headings)


def _headings(rows: Column) -> Column:
    marks = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: F.coalesce(F.get(rows, i - 1).startswith("#"), F.lit(False)) & (i > 1))
    made = _let(F.concat(F.array(F.lit(1)), marks), lambda m: _sections(rows, m, strip=True))
    return _let(made, lambda m: F.when(F.size(m) > 0, m).otherwise(_windows(rows, F.lit(1))))


def declarations(text: Column, rows: Column, pattern: str) -> Column:
    """A chunk from each declaration to the next, and one for what comes before the first.

    Boundaries are counted in newlines. A pattern is tried on each line with its line
    break, so a declaration whose words stand on different lines isn't seen.
    """
    own = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.concat(x, F.lit("\n")).rlike("(?U)" + pattern), i + 1))
    marks = F.filter(own, lambda i: i.isNotNull())
    return _let(rows, lambda r: _let(marks, lambda m: _declared(r, m)))


def _declared(rows: Column, marks: Column) -> Column:
    first = F.get(marks, F.lit(0))
    before = _strip(F.array_join(F.slice(rows, F.lit(1), F.greatest(first - 1, F.lit(0))), "\n"))
    preamble = F.when(first > 1, _full(F.array(_chunk(before, F.lit(1), first - 1)))).otherwise(F.expr(_NONE))
    made = F.when(F.size(marks) > 0, F.concat(preamble, _sections(rows, marks, strip=False))).otherwise(F.expr(_NONE))
    return _let(made, lambda m: F.when(F.size(m) > 0, m).otherwise(_windows(rows, F.lit(1))))


#: Bytes of sources whose chunks are handed on together.
SOURCES_AT_A_TIME = 1 << 20


def _declared_nodes(text: str | None) -> list[tuple[str, int, int]] | None:
    """Functions, classes and methods of a Python source with their lines; None where it has none or doesn't parse."""
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return None
    rows = text.splitlines()
    tops = [n for n in body if isinstance(n, kinds)]
    nodes = [m for n in tops for m in [n, *(x for x in (n.body if isinstance(n, ast.ClassDef) else []) if isinstance(x, kinds[:2]))]]
    out = []
    head = "\n".join(rows[: tops[0].lineno - 1]).strip() if tops else ""
    if len(head.splitlines()) > 2:
        out.append((head, 1, tops[0].lineno - 1))
    for n in nodes:
        content = "\n".join(rows[n.lineno - 1 : n.end_lineno])
        if content.strip():
            out.append((content, n.lineno, n.end_lineno))
    return out or None


def _syntax_trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Chunks of each source, handed on some sources at a time: a task never holds those of a whole Arrow batch."""
    kind = pa.list_(pa.struct([pa.field("content", pa.string()), pa.field("start_line", pa.int32()), pa.field("end_line", pa.int32())]))
    names = ("content", "start_line", "end_line")
    for batch in batches:
        held, size = [], 0
        for text in batch:
            text = text.as_py()
            found = None if text is None else _declared_nodes(text)
            held.append(found and [dict(zip(names, c, strict=True)) for c in found])
            size += len(text or "")
            if size >= SOURCES_AT_A_TIME:
                yield pa.array(held, kind)
                held, size = [], 0
        if held:
            yield pa.array(held, kind)


def syntax_tree(text: Column, rows: Column) -> Column:
    return F.coalesce(F.arrow_udf(_syntax_trees, T.ArrayType(RAW_CHUNK))(text), windows(rows))


def split_oversized(chunks: Column) -> Column:
    """Chunks over the size limit cut into windows of their lines, each at most the limit long."""

    def parts(c: Column) -> Column:
        cut = F.transform(windows(lines(c["content"]), c["start_line"]), lambda p: _chunk(F.substring(p["content"], 1, C.MAX_CHUNK_CHARS), p["start_line"], p["end_line"]))
        return F.when(F.length(c["content"]) <= C.MAX_CHUNK_CHARS, F.array(c)).otherwise(_full(cut))

    return F.flatten(F.transform(chunks, parts))


_HEADED = ("markdown", "rst", "text")


def split(text: Column, language: Column, python: bool = True, kinds: set[str] | None = None) -> Column:
    """Chunks by the splitter of a language, none over the size limit. ``kinds``: the languages there are, if known."""
    rows = lines(text)
    wanted = lambda kind: kinds is None or kind in kinds
    by = F.when(language.isin(*_HEADED), headings(rows)) if any(map(wanted, _HEADED)) else F.when(F.lit(False), F.expr(_NONE))
    for kind, pattern in C.DECLARATIONS.items():
        if wanted(kind):
            by = by.when(language == kind, declarations(text, rows, pattern))
    if python:
        by = by.when(language == "python", syntax_tree(text, rows))
    return F.when(text.rlike(r"(?U)\S"), split_oversized(by.otherwise(windows(rows)))).otherwise(F.expr(_NONE))


def chunk(files: DataFrame, python: bool = True, kinds: set[str] | None = None) -> DataFrame:
    """Rows of the index, without time and vector, from files (source_path, repo, language, content).

    Python sources take their own branch, so other files never pass through a Python worker.
    ``kinds`` names the languages there are, if known: the plan is made for these only.
    """
    python = python and (kinds is None or "python" in kinds)
    keep = files.select("source_path", "repo", "language", "content")

    def made(rows: DataFrame, with_python: bool) -> DataFrame:
        rows = rows.select("source_path", "repo", "language", F.posexplode(split(F.col("content"), F.col("language"), with_python, kinds)).alias("chunk_index", "c"))
        content = F.col("c.content")
        return rows.select(
            identity.chunk_id(F.col("source_path"), F.col("chunk_index")).alias("id"), content.alias("content"), identity.content_hash(content).alias("content_hash"),
            "source_path", "repo", "language", "chunk_index", F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"),
        )

    if not python:
        return made(keep, False)
    return made(keep.where("language <> 'python'"), False).unionByName(made(keep.where("language = 'python'"), True))
