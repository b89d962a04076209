"""Token ids of a corpus, coded into checksummed blocks and read back.

Layout: a Parquet table whose rows are segments. A segment holds whole documents, in
ascending id order over all segments, and about four million tokens (more only for one
longer document): the directory (doc_ids, counts), the partition and the tokens before it
there, and the payload of ``token_coder``. Parquet is only the container: writers on lost
executors start over, and readers take segments from any of Spark's file systems.

Where a vocabulary never joins tokens over white space, which is tried when its file is
opened, the library encodes each distinct word once and ids are gathered from there; words
are told apart by their bytes. Other vocabularies are encoded text by text.

Defined results: null and blank texts give the end id alone. Rows with a null id come
first. Rows with equal ids follow each other by their text. Empty tables give an empty
result. The id -2**63 stands for a null id in the files and is read back as null. Other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.runtime import map_arrow, new_path
from quillspark.llm.token_coder import BLOCK, LANES, decode, encode
from quillspark.llm.words import slices, split

#: Distinct words that a task keeps encoded; beyond it starts anew.
CACHED_WORDS = 600_000
_SLICE = 1 << 21  # bytes of text encoded at a time
#: Words that the library encodes as one text, and the word that parts them there.
_TOGETHER, _MARK = 4096, b"\x01"

SEGMENTS = "part int, before long, n_tokens long, doc_ids array<long>, counts array<long>, payload binary"


def parts_at_blanks(tokenizer) -> bool:
    """Whether the library encodes words with a blank between them as it does each alone.

    Tried on every blank and all pairs of words of different makes; vocabularies that join
    over blanks show on the first of them.
    """
    words = ["a", "the", "B", "don't", "'s", "x1", "42", "7", "é", "ß", "ñandú", "中文", "😀", ".", ",", "--", "(a)", "a.b", "_x_", "$9", "</w>", "Ġa", "▁a", "\u0301", "\u00a0", _MARK.decode()]
    pairs = [(a, blank, b) for a in words for b in words for blank in " \t\n\v\f\r"] + [("", " ", w) for w in words] + [(w, "  ", "") for w in words]
    encoded = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    alone = dict(zip(["", *words], encoded(["", *words]), strict=True))
    return all(ids == alone[a] + alone[b] for ids, (a, _, b) in zip(encoded(["".join(p) for p in pairs]), pairs, strict=True))


def _ends(data: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each word as integers: with its length, all of a word up to sixteen bytes."""
    padded = np.concatenate((np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    drop = np.uint64(8) * (8 - np.minimum(w.end - w.start, 8)).astype(np.uint64)
    whole = drop < 64
    return np.where(whole, eight[w.start + 8] << drop, 0), np.where(whole, eight[w.end] >> drop, 0)


class _ByWord:
    """Encodes words once and gathers the ids of texts."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end = tokenizer, end_id
        mark = tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.size, self.start = np.array([self.end]), np.ones(1, np.int64), np.zeros(1, np.int64)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids and how many each has. Between marks if these alone have the mark's id, else word by word."""
        if self.mark is not None:
            text = (b" " + _MARK + b" ").join(words).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter((i for ids in each for i in ids), np.int64), np.array([len(ids) for ids in each], np.int64)

    def _add(self, words: list[bytes]) -> None:
        parts = [self._encoded(words[k : k + _TOGETHER]) for k in range(0, len(words), _TOGETHER)]
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
        self.size = np.concatenate([self.size, *(size for _, size in parts)])
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _unlike(data, w, first, inverse) -> bool:
        """Whether two unlike words of a slice have one hash."""
        size = w.end - w.start
        rep = first[inverse]
        if (size != size[rep]).any() or any((x != x[rep]).any() for x in _ends(data, w)):
            return True
        long = np.flatnonzero((size > 16) & (rep != np.arange(len(rep))))
        return any((data[w.start[i] : w.end[i]] != data[w.start[rep[i]] : w.end[rep[i]]]).any() for i in long)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with an end id after each, and their counts."""
        if len(self.known) > CACHED_WORDS:
            self._clear()
        w = split(data, off)
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if self._unlike(data, w, first, inverse):
            return _ByText(self.tokenizer, self.end)(data, off)
        held = data.tobytes()
        words = [held[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        fresh = [x for x in words if x not in self.known]
        if fresh:
            self.known.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh)), strict=True))
            self._add(fresh)
        slot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[inverse]
        slot = np.insert(slot, w.first[1:], 0)  # the end id follows each document
        size = self.size[slot]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(w.counts + 1)
        total = np.concatenate(([0], ends[last - 1])) if len(last) else np.zeros(1, np.int64)
        return ids, np.diff(total)


class _ByText:
    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end = tokenizer, end_id

    def __call__(self, data, off):
        texts = [data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)]
        ids = [[*e.ids, self.end] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids], np.int64)


def _write(batches, vocabulary, end_id: int, by_word: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.value)
    encoder = (_ByWord if by_word else _ByText)(tokenizer, end_id)
    vocab = max(tokenizer.get_vocab_size(), end_id + 1)
    part, before = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def segment():
        nonlocal before, held
        ids = np.concatenate([x[0] for x in held])
        row = [[part], [before], [len(ids)], [np.concatenate([x[1] for x in held])], [np.concatenate([x[2] for x in held])], [encode(ids, vocab)]]
        before += len(ids)
        held = []
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["part", "before", "n_tokens", "doc_ids", "counts", "payload"])

    for batch in batches:
        for rows, data, off in slices(batch, size=_SLICE):
            ids, counts = encoder(data, off)
            held.append((ids, _ids(rows.column("doc_id")), counts))
            if sum(len(x[0]) for x in held) >= BLOCK * LANES:
                yield segment()
    if held:
        yield segment()


#: Stands for a null id in a segment's directory.
_NULL = -(1 << 63)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL).to_numpy(zero_copy_only=False)


def _read(batches):
    for batch in batches:
        for part, before, doc_ids, counts, payload in zip(*(batch.column(c) for c in ("part", "before", "doc_ids", "counts", "payload")), strict=True):
            ids = decode(payload.as_py()).astype("<u4")
            n = counts.values.to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            docs = doc_ids.values.to_numpy(zero_copy_only=False)
            crc = np.array([zlib.crc32(ids[b - k : b].tobytes()) for b, k in zip(ends.tolist(), n.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=docs == _NULL), pa.array(np.full(len(n), part.as_py(), np.int32)), pa.array(before.as_py() + ends - n), pa.array(n), pa.array(crc)],
                names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encodes all texts in ascending doc_id order and writes segments to ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; executors get its content
        text = f.read()
    by_word = parts_at_blanks(Tokenizer.from_str(text))
    vocabulary = spark.sparkContext.broadcast(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, partial(_write, vocabulary=vocabulary, end_id=end_id, by_word=by_word), SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (tokens before it), n_tokens and ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per writing task
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    rows = map_arrow(segments.select("part", "before", "doc_ids", "counts", "payload"), _read, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("at") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the token files and returns what reading them back gives for each document."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
