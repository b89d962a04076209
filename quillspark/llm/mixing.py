"""Mixing sources by temperature: token shares raised to an exponent found by bisection.

A source with n tokens gets the weight n ** a / sum(n ** a). The exponent is the largest
that meets a target entropy, or the smallest that keeps every source within a repetition
limit. Each aggregation over the table of sources takes five bisection steps at once (the
31 inner nodes of their decision tree), so only exponents reach the driver.

The weights are realised as a permutation of each source in hash order, cut into blocks by
key prefix: whole passes first, then documents in that order until the source's budget is
spent. Running totals come from totals of blocks, summed up at two levels, plus a running sum
inside each block, so no task ever holds a source; blocks have up to ``BLOCK_DOCS`` documents
or so.

Defined results: null and blank texts have no tokens. Null sources form a source of their
own. A source without tokens costs nothing and gets one copy of each row. Rows with a null
id and repeated rows are rows like others: the former stand by the hash of their text, and
equal rows side by side in the permutation. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.runtime import materialise, unused

BLOCK_DOCS = 200
MAX_REPETITION = 2.0
STEPS = 30


def _tree(lo: float, hi: float) -> list[float]:
    return [lo + (hi - lo) * k / 32 for k in range(1, 32)]


def find_exponent(sources: DataFrame, budget: Column, target_entropy: float | None, max_repetition: float | None) -> float:
    """Bisects the exponent in [0, 1] over (tokens) rows; ``budget`` is an expression over N, the sum of tokens."""
    lo, hi = 0.0, 1.0
    sized = sources.where("tokens > 0")
    for _ in range(STEPS // 5):
        at = _tree(lo, hi)
        z = [F.sum(F.pow("tokens", F.lit(a))).alias(f"z{i}") for i, a in enumerate(at)]
        zl = [F.sum(F.pow("tokens", F.lit(a)) * F.lit(a) * F.log("tokens")).alias(f"l{i}") for i, a in enumerate(at)]
        sums = sized.agg(F.sum("tokens").alias("N"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), *z, *zl).select("*", budget.alias("B")).first()
        if sums["N"] is None:
            return 1.0
        fits = []
        for i, a in enumerate(at):
            if target_entropy is not None:  # entropy of the weights, which falls as the exponent grows
                fits.append(math.log(sums[f"z{i}"]) - sums[f"l{i}"] / sums[f"z{i}"] < target_entropy)
            else:  # the smallest source repeats most
                spent = sums["B"] if sums["B"] is not None else sums[f"z{i}"] * sums["most"] ** (1 - a)
                fits.append(spent * sums["least"] ** (a - 1) / sums[f"z{i}"] <= max_repetition)
        k = fits.index(True) if True in fits else 31
        lo, hi = ([lo, *at][k], [*at, hi][k])
    return round(hi if target_entropy is None else lo, 6)


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION, budget: int | str | None = None, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight of its source, position and copies.

    ``budget``: tokens to emit; None for as many as the input has, "cover" for the least
    with which every source gets a whole pass. ``position``: tokens of the source before the
    document in its permutation. ``copies``: how often the document is emitted.
    """
    rows = docs.select("doc_id", "source", "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))
    rows = rows.select("doc_id", "source", "n_tokens", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.md5("text")), F.lit("")))).alias("_key"))
    rows = materialise(rows, "tokens")
    sources = materialise(rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    wanted = F.lit(None).cast("double") if budget == "cover" else F.col("N").cast("double") if budget is None else F.lit(float(budget))
    exponent = find_exponent(sources, wanted, target_entropy, max_repetition)
    power = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent))).otherwise(F.lit(0.0))
    total = sources.agg(F.sum(power).alias("z"), F.sum("tokens").alias("N"), F.max("tokens").alias("most")).select("*", wanted.alias("B")).first()
    z = total["z"] or 1.0
    spend = float(total["N"] or 0) if budget is None else z * float(total["most"] or 1) ** (1 - exponent) if budget == "cover" else float(budget)
    quota = F.floor(F.round(power / z, 9) * F.lit(spend) + F.lit(0.5 if budget == "cover" else 0.0))
    if budget == "cover":  # rounded weights fall short by whole documents once there are billions of tokens
        quota = F.greatest(quota, F.col("tokens"))
    sources = sources.select("_source", "tokens", F.round(power / z, 9).alias("weight"), F.when(F.col("tokens") > 0, quota).alias("quota"), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / BLOCK_DOCS))).cast("int").alias("_digits"))
    placed = rows.join(sources.hint("broadcast") if _bounded(sources) else sources, "_source").withColumn("_block", F.expr("substring(_key, 1, _digits)"))
    blocks = placed.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("n"))
    # two levels, so that no task sums up more than the root of a source's blocks
    blocks = blocks.withColumn("_head", F.expr("substring(_block, 1, length(_block) div 2)"))
    heads = blocks.groupBy("_source", "_head").agg(F.sum("n").alias("m"))
    heads = heads.select("_source", "_head", (F.sum("m").over(Window.partitionBy("_source").orderBy("_head")) - F.col("m")).alias("_far"))
    ahead = blocks.withColumn("_near", F.sum("n").over(Window.partitionBy("_source", "_head").orderBy("_block")) - F.col("n")).join(heads, ["_source", "_head"])
    ahead = ahead.select("_source", "_block", (F.col("_near") + F.col("_far")).alias("ahead"))
    inside = Window.partitionBy("_source", "_block").orderBy("_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_before", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    out = placed.join(ahead, ["_source", "_block"]).withColumn("position", F.col("_before") + F.col("ahead"))
    whole, rest = F.expr("quota div tokens"), F.expr("quota % tokens")
    copies = F.when(F.col("quota").isNull(), F.lit(1)).otherwise(whole + F.when(F.col("position") < rest, 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "n_tokens", "weight", "position", copies.alias("copies"))


#: Sources up to this count are sent to all tasks; more are joined by key.
BROADCAST_SOURCES = 10_000


def _bounded(sources: DataFrame) -> bool:
    return len(sources.limit(BROADCAST_SOURCES + 1).select(F.lit(1)).collect()) <= BROADCAST_SOURCES


def realise(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mixture says.

    Rows that repeat an id, a source and a length all get the largest count among them;
    rows with a null id are rows like others.
    """
    n, copies, copy = (unused(docs, c) for c in ("n", "copies", "copy"))
    counted = mix(docs, **how).groupBy("doc_id", "source", "n_tokens").agg(F.max("copies").alias(copies))
    tokens = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    keyed = docs.withColumn(n, tokens)
    on = keyed["doc_id"].eqNullSafe(counted["doc_id"]) & keyed["source"].eqNullSafe(counted["source"]) & (keyed[n] == counted["n_tokens"])
    joined = keyed.join(counted, on, "inner").select(*(keyed[c] for c in docs.columns), counted[copies])
    return joined.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5('7:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY 1),
b(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS m, (SELECT max(tokens) FROM s) AS mx,
      (SELECT sum(tokens) FROM s) * pow((SELECT min(tokens) FROM s), (lo + hi) / 2 - 1) / (SELECT sum(pow(tokens, (lo + hi) / 2)) FROM s) <= {MAX_REPETITION} AS ok FROM b WHERE k < {STEPS})),
e AS (SELECT round(hi, 6) AS a FROM b WHERE k = {STEPS}),
w AS (SELECT source, tokens, round(pow(tokens, a) / (SELECT sum(pow(tokens, a)) FROM s), 9) AS weight, (SELECT sum(tokens) FROM s) AS total FROM s, e),
q AS (SELECT source, tokens::BIGINT AS tokens, weight, floor(weight * total)::BIGINT AS quota FROM w),
p AS (SELECT d.*, (sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS position FROM d)
SELECT doc_id, p.source, n_tokens, weight, position, (quota // tokens + CASE WHEN position < quota % tokens THEN 1 ELSE 0 END)::BIGINT AS copies FROM p JOIN q USING (source)
"""
