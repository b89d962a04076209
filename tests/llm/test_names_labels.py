"""Columns with the names the stages would use themselves, and labels that contradict each other."""

import random

from quillspark.llm import decontaminate, mixing, quality_classifier

WORDS = ["the", "of", "river", "stone", "light", "field", "glass", "wind", "paper", "road"]


def _rows(n=40):
    rng = random.Random(4)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    return [(k, text(rng.randint(20, 60)), "en", f"s{k % 3}" if k % 4 else "hot", k) for k in range(n)]


#: What intermediate columns are or have been called.
CLASHES = ["_row", "row", "ROW_", "_n", "n", "N_", "copies", "_copies", "copy", "_copy", "n_tokens", "_t", "_w", "_l", "kept", "item_id"]


def _clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"concat('{c}:', doc_id) as `{c}`" for c in CLASHES))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rows = _rows()
    rows += [(100, rows[3][1], "en", "s1", 1), (None, "a row without an id and some words", "en", None, 1)]
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as n", "2 as kept", "'y' as shingle").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").selectExpr("*", "'z' as text", "1 as n_words").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _clashing(spark, rows)
    names, docs_in = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    told = lambda frame: {tuple(map(str, r)) for r in frame.collect()}
    left = told(docs)
    assert left and left <= told(docs_in)  # every value is the one that came in
    assert not [r for r in left if r[0] in ("5", "100")]  # the item's document and the copy
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == docs.count()


def test_copies_keep_columns_of_any_name(spark):
    docs = _clashing(spark, _rows())
    out = mixing.realise(docs, budget="cover", max_repetition=2.0)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}


def test_items_with_columns_of_any_name(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = spark.createDataFrame([(1, rows[5][1]), (2, rows[6][1])], "item_id long, text string")
    clashing = plain.selectExpr("*", "'x' as doc_id", "1 as n", "'y' as shingle", "0 as size", "'s' as source", "true as kept")
    got = [sorted(map(tuple, decontaminate.contaminated(docs, b).collect()), key=str) for b in (plain, clashing)]
    assert got[0] == got[1] and {r[0] for r in got[0]} >= {5, 6}


def test_contradicting_labels_teach_nothing(spark):
    rows = [(k, ("the river of the field and the road " * 8) if k % 2 else "$$ | ! " * 40, "en", "s", 1) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(k, k % 2) for k in range(60)]
    odd = [(k, q) for k in range(60, 80) for q in (0, 1)]  # both marks
    schema = "doc_id long, quality int"
    score = lambda marks: {r.doc_id: r.score for r in quality_classifier.score(docs, spark.createDataFrame(marks, schema)).collect()}
    clean = score(labels)
    assert clean[1] > 0.5 > clean[0]
    assert score(labels + odd) == clean == score([*odd, *labels, *labels])  # repeated marks count once
