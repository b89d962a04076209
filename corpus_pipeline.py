"""The corpus pipeline: five stages from documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next one's documents. All but the last return the columns of
``documents``; the last returns what reading the token files gives for each document.

Defined results: null and blank texts have all statistics zero, and the classifier decides on
them like on others; what it keeps is no copy of anything, holds no test item and becomes an
end id. Copies and test items are told row by row, so rows with a null or a repeated id
neither shield each other nor go with one another: of equal texts the row with the smallest
id stays, null ids last. Repeated rows fold to one. Rows that share an id, a source and a
length are repeated as often as each other by the mixture. Ties go by id. Empty tables give
an empty result; without labels nothing is rejected. Other columns pass through all but the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, near_dedup, quality_classifier, token_output
from quillspark.llm.runtime import new_path, numbered, read_table, unused

#: Similarity in percent from which the near-duplicate stage links documents.
SIMILAR_PERCENT = 80
#: Copies of a document that the mixture may hold at most.
MOST_COPIES = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, doesn't reject."""
    return quality_classifier.accepted(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    row = unused(docs, "row")
    rows = numbered(docs, row)
    found = near_dedup.near_duplicates(rows.select(rows[row].alias("doc_id"), "text"), SIMILAR_PERCENT)
    dropped = found.where("not kept").select(found["doc_id"].alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    row = unused(docs, "row")
    rows = numbered(docs, row)
    found = decontaminate.contaminated(rows.select(rows[row].alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(found["doc_id"].alias(row)).distinct(), row, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of smaller sources twice as far as the weights ask for it."""
    return mixing.realise(docs, budget="cover", max_repetition=MOST_COPIES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what they hold."""
    return token_output.token_output(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("token_output", tokens),
]

#: The classifier, union-find over signatures and the tokenizer can't be told in SQL; a test holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
