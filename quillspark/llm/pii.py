"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base spans of four kinds come from regular expressions, checks of digits included, all as
built-in expressions inside the scan; positions follow from the lengths of the pieces
between matches. They and strings with the make of a digest, the seeds of a fifth kind
(``secret``), seed a graph between lexical patterns and instances. The patterns of an
occurrence are the last one, two and three tokens to its left (a word or a sign each), and
the last one with the first to its right. Rounds of aggregation score both: a pattern by the
share of the distinct candidates in it that are of a kind, an instance by the best pattern of
each of its contexts. Patterns with enough distinct support and a high score then claim
candidates that no base expression matches but that have the make of their kind: tokens, runs
of digit groups with blanks between them, and keys. Of claims that overlap the longest holds.
Seeds of secrets are spans only where a pattern claims them.

The expressions are written so that their matches equal the plain ones listed under BASE,
but no run of characters is scanned twice: possessive repeats, and starts only where a run
starts or the match before ended. Texts without a digit or an at sign hold no candidate and
aren't scanned further.

Defined results: a null text is empty and has no spans. A null id stays null. Repeated rows
get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import materialise

#: Kinds in the order of results, with the plain expression each stands for.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time; ``card`` leaves out runs too short to pass.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": BASE["phone"],
}
#: A text without these characters has no match of the kind.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Tokens that may be identifiers: they have a digit, an at sign or two colons in a row.
TOKEN = r"(?<!\S)(?:[^\s0-9@:]++|:(?!:))*+(?:[0-9@]|::)\S*+"
#: A text without any of these has neither base spans nor candidates.
SOME = "[0-9@]|::"
#: Runs that may be keys, whole, and what they need: a letter and two digits.
KEY = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"
#: Keys that seed the kind: lower-case hexadecimal strings as long as digests are.
KEY_SEED = r"^(?=.*[a-f])(?=.*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Groups of digits with blanks, brackets, dots and hyphens between them; a group that letters follow at once isn't part of it.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9]++(?![\p{L}_@+:/%])(?:[\x20().-]++[0-9]++(?![\p{L}_@+:/%]))++"
#: The longest beginnings of a run, cut between groups, that have as many digits as a phone and a card may have.
CUTS = tuple(rf"^[^0-9]*(?:[0-9][\x20().-]*){{0,{n - 1}}}[0-9](?![0-9])" for n in (15, 19))
#: What a token or run needs besides its context to be claimed for a kind.
MAKE = {
    "email": r"^\S*[A-Za-z0-9]\S*@\S*[A-Za-z0-9]",
    "ip": r"^\D*[0-9A-Fa-f]+([.:][0-9A-Fa-f]+){3,}\D*$|^[^\w:]*[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{1,4})*::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?[^\w:]*$",
    "card": r"^\D*([0-9][\x20-]?){12,19}\D*$",
    "phone": r"^\D*([0-9][\x20().-]*){7,15}\D*$",
    "secret": r"^(?=.*[A-Za-z])(?=.*[0-9].*[0-9])[A-Za-z0-9_+/=-]{16,}$",
}
#: All kinds in the order of results.
KINDS = [*BASE, "secret"]

ROUNDS = 3
#: Distinct seed instances that a pattern needs, and the scores from which patterns and instances count.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 0.8, 0.8
_CHUNK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    value = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.substring(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(d, i, F.lit(1)) > "4", 9).otherwise(0)),
    )
    return value % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    if kind == "ip":  # each part's value, leading zeros or not
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (F.length(_digits(x)) <= 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not anew wherever a lambda mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


_NO_SPANS = "cast(array() as array<struct<x: string, s: int>>)"


def spans(text: Column, pattern: str) -> Column:
    """All matches in order: array of (x: the match, s: code points before it)."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # one more piece than matches; the last pairs with null
    sizes = F.zip_with(found, between, lambda m, p: F.struct(m.alias("x"), F.length(p).alias("gap"), F.length(m).alias("n")))
    return _let(F.filter(sizes, lambda m: m["x"].isNotNull()), _placed)


def _placed(sizes: Column) -> Column:
    """Running totals by chunk, so that appending to arrays stays cheap for any number of matches."""
    begins = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(_CHUNK)))

    def placed(chunk: Column, at: Column) -> Column:
        empty = F.struct(at.alias("at"), F.expr(_NO_SPANS).alias("out"))
        return F.aggregate(chunk, empty, lambda a, m: F.struct((a["at"] + m["gap"] + m["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(m["x"].alias("x"), (a["at"] + m["gap"]).alias("s")))).alias("out")))

    totals = F.transform(begins, lambda k: F.aggregate(F.slice(sizes, k, F.lit(_CHUNK)), F.lit(0), lambda a, m: a + m["gap"] + m["n"]))
    ahead = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
    parts = _let(ahead, lambda h: F.transform(begins, lambda k: placed(F.slice(sizes, k, F.lit(_CHUNK)), F.get(h, ((k - 1) / _CHUNK).cast("int")))["out"]))
    return F.coalesce(F.flatten(parts), F.expr(_NO_SPANS))


def _base(text: Column) -> Column:
    """Base spans: array of (k: order of the kind, s, e, x)."""

    def of(order: int, kind: str) -> Column:
        got = F.filter(spans(text, LINEAR[kind]), lambda m: _passes(kind, m["x"]))
        got = F.transform(got, lambda m: F.struct(F.lit(order).alias("k"), m["s"].alias("s"), (m["s"] + F.length(m["x"])).alias("e"), m["x"].alias("x")))
        return F.when(F.contains(text, F.lit(NEEDED[kind])), got).otherwise(F.expr("cast(array() as array<struct<k: int, s: int, e: int, x: string>>)"))

    return F.concat(*(of(i, k) for i, k in enumerate(BASE)))


#: Words and signs of a context.
_ATOM = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def _patterns(text: Column, start: Column, end: Column) -> Column:
    """The patterns that a span stands in, the longest first, lower-cased; from 64 characters to its left and 32 to its right."""
    before = F.lower(F.substring(text, F.greatest(start - 63, F.lit(1)), F.least(start, F.lit(64))))
    after = F.lower(F.substring(text, end + 1, F.lit(32)))

    def made(left: Column, right: Column) -> Column:
        last = lambda n: F.when(F.size(left) >= n, F.concat(F.lit(f"{n} "), F.array_join(F.slice(left, -n, n), " ")))
        around = F.when((F.size(left) >= 1) & (right != ""), F.concat(F.lit("r "), F.element_at(left, -1), F.lit(" _ "), right))
        return F.filter(F.array(last(3), last(2), last(1), around), lambda p: p.isNotNull())

    atoms = F.regexp_extract_all(before, F.lit(_ATOM), F.lit(0))
    return _let(F.struct(atoms.alias("l"), F.regexp_extract(after, _ATOM, 0).alias("r")), lambda c: F.when(F.size(c["l"]) > 0, made(F.slice(c["l"], F.greatest(F.size(c["l"]) - 2, F.lit(1)), F.lit(3)), c["r"])).otherwise(F.expr("cast(array() as array<string>)")))


def _runs(text: Column, base: Column) -> Column:
    """Beginnings of digit runs before any base span in them, as far as they hold a blank and enough digits."""
    found = F.filter(spans(text, RUN), lambda t: t["x"].rlike(r"[0-9].*\x20.*[0-9]") & t["x"].rlike(r"([0-9][^0-9]*){7}"))

    def cut(t: Column) -> Column:
        ends = F.array_min(F.transform(F.filter(base, lambda b: b["e"] > t["s"]), lambda b: b["s"]))
        before = F.substring(t["x"], F.lit(1), F.least(F.length(t["x"]), ends - t["s"]))
        heads = F.array_distinct(F.array(*(F.regexp_extract(before, c, 0) for c in CUTS)))
        return F.transform(heads, lambda x: F.struct(x.alias("x"), t["s"].alias("s")))

    return F.filter(F.flatten(F.transform(found, cut)), lambda t: t["x"].rlike(r"[0-9].*\x20.*[0-9]") & t["x"].rlike(r"([0-9][^0-9]*){7}"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (k, s, e, x, p) and free candidates outside them (seed: kind of a seed or null, s, e, x, p); p: patterns."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("some", F.col("text").rlike(SOME))
    only = lambda made, kind: F.when(F.col("some"), made).otherwise(F.expr(f"cast(array() as array<struct<{kind}>>)"))
    rows = rows.select("*", only(_base(F.col("text")), "k: int, s: int, e: int, x: string").alias("base"), only(spans(F.col("text"), TOKEN), "x: string, s: int").alias("tokens"))
    rows = rows.select("*", only(_runs(F.col("text"), F.col("base")), "x: string, s: int").alias("runs"))
    # only what has enough digits or an at sign, or the make of an address, can be of a kind
    made = F.filter("tokens", lambda t: t["x"].rlike(r"@|([0-9].*){4}") | t["x"].rlike(MAKE["ip"]))
    # a piece of a run that has no kind's make would only count against what the run follows
    inside = lambda t: F.exists("runs", lambda r: (r["s"] <= t["s"]) & (t["s"] + F.length(t["x"]) <= r["s"] + F.length(r["x"])))
    whole = F.filter(made, lambda t: reduce(lambda a, b: a | b, (t["x"].rlike(MAKE[k]) for k in BASE)) | ~inside(t))
    keys = F.filter(spans(F.col("text"), KEY), lambda t: t["x"].rlike(MAKE["secret"]))
    rows = rows.select("doc_id", "text", "some", "base", only(F.concat(whole, F.col("runs")), "x: string, s: int").alias("made"), only(keys, "x: string, s: int").alias("keys"))
    # a token that a key fills but for signs around it is that key
    same = lambda t: F.exists("keys", lambda k: (t["s"] <= k["s"]) & (k["s"] + F.length(k["x"]) <= t["s"] + F.length(t["x"])) & (F.length(F.regexp_replace(t["x"], "[A-Za-z0-9_+/=-]", "")) + F.length(k["x"]) == F.length(t["x"])))
    free = F.concat(F.filter("made", lambda t: ~same(t)), F.col("keys"))
    free = F.filter(free, lambda t: ~F.exists("base", lambda b: (b["s"] < t["s"] + F.length(t["x"])) & (t["s"] < b["e"])))
    free = F.transform(free, lambda t: F.struct(F.when(t["x"].rlike(KEY_SEED), F.lit(KINDS.index("secret"))).alias("seed"), t["s"].alias("s"), (t["s"] + F.length(t["x"])).alias("e"), t["x"].alias("x"), _patterns(F.col("text"), t["s"], t["s"] + F.length(t["x"])).alias("p")))
    base = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e"), b["x"].alias("x"), _patterns(F.col("text"), b["s"], b["e"]).alias("p")))
    return rows.select("doc_id", base.alias("base"), only(free, "seed: int, s: int, e: int, x: string, p: array<string>").alias("free"))


def _of_make() -> Column:
    return reduce(lambda a, b: a | b, ((F.col("kind") == i) & F.col("x").rlike(MAKE[k]) for i, k in enumerate(KINDS)))


def bootstrap(found: DataFrame) -> DataFrame:
    """Claims (context, x, k) from the graph of scanned documents (``base`` and ``free`` columns); a context is its longest pattern."""
    seeds = found.select(F.explode("base").alias("b")).select("b.p", "b.x", "b.k")
    free = found.select(F.explode("free").alias("f")).select("f.p", "f.x", F.col("f.seed").alias("k"))
    places = materialise(seeds.union(free).where(F.size("p") > 0).select(F.get("p", F.lit(0)).alias("context"), "x", "k", "p").distinct(), "graph")
    edges = materialise(places.select("context", "x", "k", F.explode("p").alias("pattern")), "edges")
    pairs = edges.select("pattern", "x").distinct()
    total = pairs.groupBy("pattern").agg(F.count("*").alias("n"))
    seeded = edges.where("k is not null").select("x", F.col("k").alias("kind"), F.lit(1.0).alias("sx")).distinct()
    support = edges.where("k is not null").select("pattern", "x", F.col("k").alias("kind")).distinct().groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    support = materialise(support.join(total, "pattern"), "support")
    scores, patterns = seeded, None
    for _ in range(ROUNDS):
        # patterns: the share of their distinct instances that are of the kind
        of_kind = pairs.join(scores, "x").groupBy("pattern", "kind").agg(F.sum("sx").alias("mass"))
        patterns = materialise(of_kind.join(support, ["pattern", "kind"]).select("pattern", "kind", (F.col("mass") / F.col("n")).alias("sp")), "patterns")
        # instances: one minus the chance that the best patterns of all their contexts are wrong; seeds stay certain
        claimed = edges.where("k is null").join(patterns, "pattern").where(_of_make()).groupBy("context", "x", "kind").agg(F.max("sp").alias("sp"))
        claimed = claimed.groupBy("x", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sp"), F.lit(1e-6)))))).alias("sx"))
        scores = materialise(seeded.union(claimed).groupBy("x", "kind").agg(F.max("sx").alias("sx")), "scores")
    good = patterns.where(F.col("sp") >= PATTERN_SCORE).select("pattern", "kind")
    sure = scores.where(F.col("sx") >= INSTANCE_SCORE).select("x", "kind")
    secret = KINDS.index("secret")
    open_ = edges.where(F.col("k").isNull() | (F.col("k") == secret))
    best = open_.join(good, "pattern").where(_of_make()).join(sure, ["x", "kind"]).groupBy("context", "x").agg(F.min("kind").alias("k"))
    return materialise(best, "claims")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans by kind, base_sha256, all spans, and how many spans and secrets were added."""
    found = materialise(scanned(docs).withColumn("_row", F.monotonically_increasing_id()), "found")
    claims = bootstrap(found)
    free = found.select("_row", F.explode("free").alias("f")).where(F.size("f.p") > 0).select("_row", F.get("f.p", F.lit(0)).alias("context"), "f.x", "f.s", "f.e")
    added = free.join(claims, ["context", "x"]).groupBy("_row").agg(F.collect_list(F.struct("k", "s", "e")).alias("added"))
    # a run may be claimed with a token in it, or at two lengths
    wider = "b.s < a.e and a.s < b.e and (b.e - b.s > a.e - a.s or b.e - b.s = a.e - a.s and b.s < a.s)"
    added = added.withColumn("added", F.expr(f"filter(added, a -> not exists(added, b -> {wider}))"))
    names = F.array(*(F.lit(k) for k in KINDS))

    def told(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda b: F.concat_ws(":", F.get(names, b["k"]), b["s"].cast("string"), b["e"].cast("string"))), ",")

    base = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    every = F.array_sort(F.concat(base, F.coalesce("added", F.expr("cast(array() as array<struct<k: int, s: int, e: int>>)"))))
    return found.join(added, "_row", "left").select(
        "doc_id",
        *(F.size(F.expr(f"filter(base, b -> b.k = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(every).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
        F.size(F.expr(f"filter(coalesce(added, array()), a -> a.k = {KINDS.index('secret')})")).cast("long").alias("n_secret"),
        F.size(every).cast("long").alias("n_spans"),
    )
