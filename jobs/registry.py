"""The jobs as registered queries: each runs twice into a folder of its own and returns what stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import batch_search, index_documents
from quillspark import constants as C
from quillspark.plans import catalog
from quillspark.sources.shared import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks after two runs over the whole table; the second finds nothing new."""
    folder = _folder(spark, "job1_index_documents")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    rows = index_documents.current(spark, f"{folder}/index")
    return rows.select("source_path", "repo", "language", "chunk_index", "start_line", "end_line", "content_hash")


def job2_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of ``benchmark``."""
    folder = _folder(spark, "job2_batch_search")
    for _ in range(2):
        batch_search.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return batch_search.read(spark, folder).select("item_id", "rank", "doc_id", "score", "source")


_WINDOW = f"SELECT source_path, repo, start_line + i AS start_line, start_line + least(i + {C.CHUNK_LINES}, len(l)) - 1 AS end_line, substr(array_to_string(l[i + 1:i + {C.CHUNK_LINES}], chr(10)), 1, {C.MAX_CHUNK_CHARS}) AS content"
JOB1_SQL = f"""
WITH {catalog.CTE}, {catalog.LINES.format("content")}, {catalog.HEADINGS},
al AS (SELECT c.source_path, repo, start_line, end_line, he.content FROM he JOIN c USING (id) WHERE he.content <> ''),
bl AS (SELECT *, string_split(content, chr(10)) AS l FROM al WHERE length(content) > {C.MAX_CHUNK_CHARS}),
bw AS ({_WINDOW} FROM (SELECT *, unnest(range(0, len(l), {C.CHUNK_STRIDE})) AS i FROM bl)),
fin AS (SELECT source_path, repo, start_line, end_line, content FROM al WHERE length(content) <= {C.MAX_CHUNK_CHARS} UNION ALL SELECT source_path, repo, start_line, end_line, content FROM bw WHERE {catalog.BLANK} <> '')
SELECT source_path, repo, 'text' AS language, (row_number() OVER (PARTITION BY source_path ORDER BY start_line, end_line) - 1)::INT AS chunk_index, start_line::INT AS start_line, end_line::INT AS end_line, sha256(content) AS content_hash FROM fin
"""
JOB2_SQL = f"""
WITH c AS (SELECT doc_id AS id, coalesce(text, '') AS content FROM documents UNION ALL SELECT -1 - item_id, coalesce(text, '') FROM benchmark), {catalog.STEMS},
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok WHERE id >= 0),
q AS (SELECT -1 - id AS item_id, unnest(list_distinct(t)) AS term FROM tok WHERE id < 0),
p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM tok WHERE id >= 0) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT item_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), {C.BM25_LEAST_IDF}) * tf * {C.BM25_K1 + 1} / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * l / a))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM w)
SELECT item_id, rank::INT AS rank, id AS doc_id, score, source FROM r JOIN documents ON id = doc_id WHERE rank <= 10
"""


def queries() -> dict:
    return {"job1_index_documents": job1_index_documents, "job2_batch_search": job2_batch_search}


def oracle_sql() -> dict[str, str]:
    return {"job1_index_documents": JOB1_SQL, "job2_batch_search": JOB2_SQL}
