"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

Statistics of each text (built-in expressions only) feed small boosted trees on the driver.
Every path from a root to a node is a rule, a conjunction of thresholds. A logistic model
with an L1 penalty gives the rules weights, most of them zero, and the rest become one
expression that Spark evaluates inside the scan.

It learns from at most ``SAMPLE`` labelled rows, those with the smallest hash of their id,
outside the held-out fifth. Labels, languages, sources and ids are no inputs of the score.

Defined results: null and blank texts have all statistics zero and get the score that
follows. A null id is hashed as the empty string. Repeated rows get equal scores.
Labels that repeat an id with one mark count once; an id with both marks teaches nothing.
Without labels of both classes each score is the share of label 1 among those there are
(0.5 if none). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.quality_rules import SPACE, STOP_WORDS
from quillspark.llm.runtime import read_table

SAMPLE = 20_000
CUTOFF = 0.3
TREES, DEPTH, RATE, LEAST_LEAF = 24, 3, 0.3, 20
CUTS = 24  # thresholds tried per statistic
PENALTY = 0.002

FEATURES = ["n_words", "word_length", "symbols", "capitals", "digits", "bars", "exclaims", "stop_words", "distinct_words", "distinct_pairs", "dup_lines", "line_words", "stops"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of FEATURES as doubles."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id"), text.alias("_t"), words.alias("_w"), lines.alias("_l"))
    n, chars = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_t"), F.lit(1))

    def count(pattern: str) -> Column:
        return F.regexp_count("_t", F.lit(pattern))

    pairs = F.expr("transform(_w, (w, i) -> xxhash64(w, get(_w, i + 1)))")
    made = {
        "n_words": F.size("_w"),
        "word_length": F.length(F.array_join("_w", "")) / n,
        "symbols": count(r"[#*$%&<>]") / n,
        "capitals": count(r"\p{Lu}") / chars,
        "digits": count(r"[0-9]") / chars,
        "bars": count(r"\|") / n,
        "exclaims": count(r"!") / n,
        "stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))) / n,
        "distinct_words": F.size(F.array_distinct("_w")) / n,
        "distinct_pairs": F.size(F.array_distinct(pairs)) / n,
        "dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))) / F.greatest(F.size("_l"), F.lit(1)),
        "line_words": F.size("_w") / F.greatest(F.size("_l"), F.lit(1)),
        "stops": count(r"[.,;:?]") / n,
    }
    # a generator, so that a filter on the score isn't pushed below with a copy of each statistic for each rule
    row = F.struct(*(F.coalesce(made[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES))
    return rows.select("doc_id", F.explode(F.array(row)).alias("_s")).select("doc_id", "_s.*")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _tree(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray):
    """Rules (lists of (feature, threshold, above)) of one tree's nodes, and its values by row."""
    rules, value = [], np.zeros(len(x))

    def grow(rows: np.ndarray, path: list, depth: int):
        if path:
            rules.append(path)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            for f, tried in enumerate(cuts):
                bins = np.searchsorted(tried, x[rows, f], "left")
                gs, hs, ns = (np.bincount(bins, w, len(tried) + 1).cumsum()[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, tried[int(gain.argmax())]))
        if best[1] is None:
            value[rows] = g / (h + 1)
            return
        f, t = best[1]
        above = x[rows, f] > t
        grow(rows[~above], [*path, (f, float(t), False)], depth + 1)
        grow(rows[above], [*path, (f, float(t), True)], depth + 1)

    grow(np.arange(len(x)), [], 0)
    return rules, value


def _holds(x: np.ndarray, rule: list) -> np.ndarray:
    return np.all([(x[:, f] > t) == above for f, t, above in rule], axis=0)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, list]]]:
    """An intercept and the weighted rules that the penalty leaves."""
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for f in range(x.shape[1])]
    raised, rules = np.full(len(y), np.log(share / (1 - share))), []
    rng = np.random.default_rng(0)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raised))
        part = rng.random(len(y)) < 0.7
        found, value = _tree(x, cuts, (y - p) * part, p * (1 - p) * part)
        rules += found
        raised += RATE * value
    unique = {tuple(sorted(r)): r for r in rules}
    columns = {}
    for r in unique.values():
        hit = _holds(x, r)
        if LEAST_LEAF <= hit.sum() <= len(y) - LEAST_LEAF:
            columns.setdefault(hit.tobytes(), (r, hit))
    kept = [r for r, _ in columns.values()]
    z = np.stack([hit for _, hit in columns.values()], axis=1).astype(float) if columns else np.zeros((len(y), 0))
    centre, scale = z.mean(0), np.maximum(z.std(0), 1e-9)
    zs = (z - centre) / scale
    w, b = np.zeros(zs.shape[1]), np.log(share / (1 - share))
    look, at, step = w.copy(), b, 1 / (0.25 * max(np.linalg.norm(zs, 2) ** 2 / len(y), 1e-9) + 0.25)
    momentum = 1.0
    for _ in range(600):  # FISTA
        error = 1 / (1 + np.exp(-(zs @ look + at))) - y
        moved = look - step * (zs.T @ error) / len(y)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b = at - step * error.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, at = new_w + (momentum - 1) / after * (new_w - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new_w, new_b, after
    raw = w / scale
    return float(b - (raw * centre).sum()), [(float(v), r) for v, r in zip(raw, kept, strict=True) if abs(v) > 1e-9]


def compiled(intercept: float, rules: list[tuple[float, list]]) -> Column:
    """The score as one expression over the statistics."""
    total = F.lit(intercept)
    for weight, rule in rules:
        holds = F.lit(True)
        for f, t, above in rule:
            holds &= (F.col(FEATURES[f]) > t) if above else (F.col(FEATURES[f]) <= t)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[float, list]]]:
    """Fits the rules to labelled documents outside the held-out fifth."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("_y")).where("doc_id is not null and _y is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").drop("_most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample)
    got = rows.select("_y", *FEATURES).toPandas().to_numpy(float)
    return fit(got[:, 1:], (got[:, 0] > 0.5).astype(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from ``cutoff`` on)."""
    out = statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(*learn(docs, labels, sample)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cutoff, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that the classifier doesn't reject, whole; judged within the scan."""
    model = compiled(*learn(docs, labels, sample))
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("doc_id"), "text")
    return statistics(packed).where(model >= cutoff).select(*(F.col(f"doc_id.`{c}`").alias(c) for c in names))


def query(spark, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
