"""Benchmark decontamination by containment search over MinHash samples.

Test items are short and documents long, so a similarity of whole sets says nothing; what
counts is which share of an item's word shingles a document holds. Items are partitioned
by size. Of each item a MinHash sample is taken (its smallest shingle under each of k hash
functions, k from the upper size of its partition; all shingles of the smallest items), and
documents are probed for the sampled shingles. A document with at least the wanted share
of an item misses all k samples with a probability of (1 - share) ** k, 1e-8 or less.
Each document and item that meet are verified by exact containment of all shingles.

Documents have no signature. A share t of an item of q shingles is a Jaccard similarity of
t / (u / q + 1 - t) with a document of u; for 30 in 5,000 that is 0.005, and to find it in
99 of 100 cases takes 920 bands of one row, more than the document has samples worth storing.

The items are the query set: one block of at most ``BLOCK_BYTES`` of text at a time is
indexed on the driver and sent to executors, which search all documents in place; its hits
are stored and the block is released before the next one, so a benchmark of any size needs
the memory of one block, and documents are never shuffled.

Defined results: shingles are runs of five words, A-Z lower-cased; a text of fewer
words has its whole sequence as its one shingle, so it meets only equally short equal
texts; null and blank texts or items meet nothing. Repeated items and rows each give their
own result rows. A null item id or document id stays null in them. Empty tables give an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import map_arrow, materialise, read_table
from quillspark.llm.words import mix, raw, slices, split

WORDS, SHARE = 5, 0.8
BLOCK_BYTES = 8 << 20
#: Chance of missing an item whose share is just reached.
MISS = 1e-8
HITS = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class Index:
    """Shingle sets of a block of items, by item and as an inverted sample."""

    def __init__(self, ids: list, texts: list, share: float, words: int):
        data, off = raw(pa.array(texts, pa.string()))
        h, at = split(data, off, fold=True).shingles(words)
        self.ids, self.share = ids, share
        self.sets, self.at, self.size = h, at, np.diff(at)
        tries = int(np.ceil(np.log(MISS) / np.log(max(1 - share, 1e-9))))
        keys, owners = [], []
        # size partitions: powers of two; the sample of a partition grows with its upper size
        level = np.ceil(np.log2(np.maximum(self.size, 1))).astype(int)
        for lv in np.unique(level[self.size > 0]):
            k = min(1 << int(lv), tries + int(lv))
            items = np.flatnonzero((level == lv) & (self.size > 0))
            size = self.size[items]
            begin = np.cumsum(size) - size
            own = h[np.repeat(at[items] - begin, size) + np.arange(size.sum())]
            owner = np.repeat(items, size)
            taken = np.repeat(size <= k, size)  # all of what is smaller than its sample
            for seed in mix(np.arange(1, k + 1).astype(np.uint64)) | np.uint64(1):
                mixed = mix(own * seed)
                taken |= mixed == np.repeat(np.minimum.reduceat(mixed, begin), size)
            keys.append(own[taken])
            owners.append(owner[taken])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, h: np.ndarray, at: np.ndarray):
        """(document, item, shared) of the sorted sets h[at[i]:at[i+1]] that hold enough of an item."""
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, h[maybe], "left"), np.searchsorted(self.keys, h[maybe], "right")
        found = maybe[hi > lo]
        lo, hi = lo[hi > lo], hi[hi > lo]
        n = hi - lo
        if not len(found):
            return
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.repeat(np.searchsorted(at, found, "right") - 1, n)
        pairs = np.unique(np.stack([doc, self.owners[entry]], axis=1), axis=0)
        for d, i in pairs.tolist():
            doc_set, item = h[at[d] : at[d + 1]], self.sets[self.at[i] : self.at[i + 1]]
            shared = int((doc_set[np.minimum(np.searchsorted(doc_set, item), len(doc_set) - 1)] == item).sum())
            if shared >= self.share * len(item) - 1e-9:
                yield d, i, shared


def _probe(batches, block, words: int):
    index = block.value
    for batch in batches:
        for rows, data, off in slices(batch):
            h, at = split(data, off, fold=True).shingles(words)
            out = list(index.search(h, at))
            if out:
                docs, items, shared = (np.array(x) for x in zip(*out, strict=True))
                size = index.size[items]
                columns = [rows.column("doc_id").take(pa.array(docs)), pa.array([index.ids[i] for i in items], pa.int64()), pa.array(size.astype(np.int64)), pa.array(shared.astype(np.int64)), pa.array(shared / size)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, words: int = WORDS) -> DataFrame:
    """One row per document and item where the document holds at least ``share`` of the item's shingles."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // (BLOCK_BYTES // 2)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = part.orderBy("item_id", "text").collect()  # one block: about half of BLOCK_BYTES
        block = spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], share, words))
        found.append(materialise(map_arrow(texts, partial(_probe, block=block, words=words), HITS), "hits"))
        block.destroy()
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, words: int = WORDS) -> DataFrame:
    """The documents that hold no item; rows with a null id stay."""
    hits = contaminated(docs, benchmark, share, words).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def oracle(share_percent: int = 80) -> str:
    """DuckDB SQL with the same result for texts of five words or more."""

    def shingled(table: str, key: str) -> str:
        return f"""SELECT {key}, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
  WHEN len(ws) > 0 THEN [chr(10) || array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table})"""

    return f"""
WITH i AS ({shingled("benchmark", "item_id")}), d AS ({shingled("documents", "doc_id")}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, c::BIGINT AS n_shared, c / n AS containment FROM m JOIN n USING (item_id) WHERE 100 * c >= {share_percent} * n
"""
