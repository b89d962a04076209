"""Quality rules: a table of thresholds compiled into one projection.

Everything is computed inside the scan of ``documents`` from built-in expressions; nothing
is shuffled and no user function runs. Words are runs of characters other than 0x20 and
0x09-0x0D. Windows of three words are compared by 64-bit hashes: for a text of 20,000
words the chance that two unlike windows agree anywhere is 1e-11.

Defined results: null and blank texts have no words, fail the base rules and aren't
kept. A null id stays null. Repeated rows are judged one by one. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for on as at was by this an are "
    "der die und von zu das mit den im ein eine ist nicht auch sich für auf "
    "le la les de des et en un une du que qui dans pour par sur avec "
    "el los las una por para con del se su es no lo al y"
).split()

#: name, expression over the base statistics, and the smallest and largest value that passes (None: no bound).
#: Ratios are integers in percent or per mille of whole counts, so every engine agrees on them.
RULES: list[tuple[str, str, int | None, int | None]] = [
    ("length_ok", "n_words", 50, 1_000_000),
    ("word_length_ok", "100 * word_chars div n_words", 200, 1500),
    ("symbols_ok", "100 * n_symbols div n_words", None, 50),
    ("stop_words_ok", "1000 * n_stop_words div n_words", 20, None),
    ("lines_ok", "100 * n_dup_lines div n_lines", None, 50),
    ("repeats_ok", "100 * n_repeat_words div n_words", None, 50),
]


def statistics(text: Column) -> dict[str, Column]:
    """Expressions of the base statistics; those over words take the column ``_words``."""
    words, text = F.col("_words"), F.coalesce(text, F.lit(""))
    n = F.size(words)
    # windows of three words, as (hash, position), sorted: equal windows stand side by side
    windows = F.expr("transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i))")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "_sorted": F.when(n >= 3, F.sort_array(windows)),
        "n_words": n.cast("long"),
        "word_chars": F.coalesce(F.length(F.array_join(words, "")), F.lit(0)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    }


#: Positions of windows whose hash stands next to an equal one, in order; each covers up to three words anew.
REPEATED = "filter(_sorted, (x, k) -> x.h <=> get(_sorted, k + 1).h OR x.h <=> get(_sorted, k - 1).h)"
COVERED = "aggregate(array_sort(transform(coalesce(_again, array()), x -> x.i)), struct(0L AS n, -3 AS last), (s, i) -> struct(s.n + least(3, i - s.last) AS n, i AS last), s -> s.n)"


def quality_rules(docs: DataFrame, rules: list[tuple[str, str, int | None, int | None]] = RULES) -> DataFrame:
    """One row per document: the base statistics, base_failed, kept, and a verdict for each rule.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows of three.
    """
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE, -1), lambda w: w != "")
    out = docs.select(F.col("doc_id"), F.col("text"), words.alias("_words"))
    out = out.select("doc_id", *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    out = out.select("*", F.expr(REPEATED).alias("_again")).select("*", F.expr(COVERED).alias("n_repeat_words"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = {}
    for name, expression, least, most in rules:
        value = F.expr(f"coalesce({expression.replace('div n_words', 'div nullif(n_words, 0)').replace('div n_lines', 'div nullif(n_lines, 0)')}, 0)")
        verdicts[name] = (F.lit(True) if least is None else value >= least) & (F.lit(True) if most is None else value <= most)
    kept = ~base
    for passed in verdicts.values():
        kept &= passed
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"]
    return out.select("doc_id", *stats, base.alias("base_failed"), kept.alias("kept"), *(v.alias(k) for k, v in verdicts.items()))


def oracle(rules: list[tuple[str, str, int | None, int | None]] = RULES) -> str:
    """DuckDB SQL with the same result."""
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdicts = []
    for name, expression, least, most in rules:
        value = f"coalesce({expression.replace('div n_words', '// nullif(n_words, 0)').replace('div n_lines', '// nullif(n_lines, 0)')}, 0)"
        verdicts.append(" AND ".join(["true"] + [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)) + f" AS {name}")
    every = " AND ".join(r[0] for r in rules)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
k AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT doc_id, g FROM k GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT k.doc_id, i + unnest([0, 1, 2]) AS pos FROM k JOIN again USING (doc_id, g)) GROUP BY 1),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(coalesce(array_to_string(ws, ''), ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({listed})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(verdicts)} FROM s)
SELECT * EXCLUDE (n_words), n_words, NOT base_failed AND {every} AS kept FROM v
"""
