"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

A text is normalised here: the longest prefix that the model's compiled character map knows
is replaced, white space is trimmed, folded and escaped as the model asks, and for every
normalised byte the place of the source character it comes from is kept. The library then
merges the normalised text, under a copy of the model that normalises nothing. Pieces laid
end to end over the normalised bytes give each piece's byte span in the source.

No piece of a vocabulary like this joins white space to what stands before it (that is
checked when the model is opened), so merges never cross from a word into the white space
after it: a run of white space with the word it leads is encoded once, and ids are gathered
from there. A model with a piece that does join them encodes each text as one such run.

The compiled map is a double array: four bytes with the array's size, the array's units of
four bytes, then the replacements, each ended by a zero byte. Only models of merges with
byte fallback and without user-defined pieces are taken; others raise ValueError.

Defined results: null texts are empty, and empty ones have the begin and end ids alone.
Spans of a character's byte pieces are empty but for the last, which has the whole
character; begin and end ids stand at the text's ends. Bytes that aren't UTF-8 count as the
replacement character. Rows with null or repeated ids are encoded each for itself; empty
tables give an empty result; other columns are ignored, whatever their names. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.runtime import map_arrow
from quillspark.llm.words import slices

#: Runs that a task keeps encoded, and the length from which a run isn't kept.
CACHED_RUNS, _LONG_RUN = 600_000, 200
#: Runs that the library merges as one text.
_TOGETHER = 2048
_SLICE = 1 << 20  # bytes of text encoded at a time
_SPACE = "▁".encode()

#: Field numbers and values of the model's file.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE = 1, 3
MODEL_TYPE, SPACE_AS_SUFFIX, BYTE_FALLBACK = 3, 24, 35
CHARACTER_MAP, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
MERGES, NORMAL, USER_DEFINED, BYTE = 2, 1, 4, 6



def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in the protocol-buffer wire format."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            value |= (message[i] & 127) << shift
            shift += 7
            i += 1
            if message[i - 1] < 128:
                return value

    while i < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[i : i + size]
        i += size


def _field(number: int, value: int | bytes) -> bytes:
    def coded(n: int) -> bytes:
        return bytes([n & 127 | 128]) + coded(n >> 7) if n > 127 else bytes([n])

    return coded(number << 3) + coded(value) if isinstance(value, int) else coded(number << 3 | 2) + coded(len(value)) + value


class CharacterMap:
    """Longest-prefix lookup in a model's compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        first = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if self._known(c.encode())] if self.units else []
        #: A match can begin with these characters only.
        self.starts = re.compile("[" + "".join(map(re.escape, first)) + "]") if first else None

    def _walk(self, data: bytes, at: int, stop: int) -> tuple[int, int, int]:
        """(end, value) of the longest known prefix of data[at:stop], end = at if none is, and how far the array leads."""
        place = self._leads(self.units[0])
        end, value = at, 0
        for i in range(at, stop):
            place ^= data[i]
            unit = self.units[place]
            if unit & 0x800000FF != data[i]:
                return end, value, i
            place ^= self._leads(unit)
            if unit >> 8 & 1:
                end, value = i + 1, self.units[place] & 0x7FFFFFFF
        return end, value, stop

    @staticmethod
    def _leads(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _known(self, character: bytes) -> bool:
        return self._walk(character, 0, len(character))[2] == len(character)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The end of the longest prefix of data[at:] in the map and what replaces it."""
        end, value, _ = self._walk(data, at, len(data))
        return (end, self.replacements[value : self.replacements.index(0, value)]) if end > at else None

    def edits(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(begin, end, replacement) of a text's matches from left to right."""
        if self.starts is None:
            return
        text = data.decode()
        plain, done, seen = text.isascii(), 0, 0
        place = 0  # in bytes, of the character ``seen``
        for hit in self.starts.finditer(text):
            place += hit.start() - seen if plain else len(text[seen : hit.start()].encode())
            seen = hit.start()
            if place < done:
                continue
            if (found := self.longest(data, place)) is not None:
                yield place, found[0], found[1]
                done = found[0]


class _Slots(dict):
    """Numbers of runs in the order they first came."""

    def __init__(self):
        super().__init__()
        self.made, self.fresh = 0, []

    def __missing__(self, run: str) -> int:
        self.fresh.append(run)
        self[run] = slot = self.made
        self.made += 1
        return slot

    def taken(self) -> list[str]:
        """Runs that came since the last call."""
        out, self.fresh = self.fresh, []
        return out


class Model:
    """What a model's file says, and the library's processors for it; opened once in each task."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        trainer, normalizer, texts, kinds = {}, {}, [], []
        for number, value in _fields(content):
            if number == PIECES:
                piece = dict(_fields(value))
                texts.append(piece.get(PIECE_TEXT, b""))
                kinds.append(piece.get(PIECE_TYPE, NORMAL))
            elif number in (TRAINER, NORMALIZER):
                (trainer if number == TRAINER else normalizer).update(_fields(value))
        if trainer.get(MODEL_TYPE) != MERGES or not trainer.get(BYTE_FALLBACK) or trainer.get(SPACE_AS_SUFFIX) or USER_DEFINED in kinds:
            raise ValueError("only models of merges with byte fallback, white space before words and no user-defined pieces")
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.prefix, self.trim, self.escape = (bool(normalizer.get(k, 1)) for k in (DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES))
        self.space = _SPACE if self.escape else b" "
        mark = self.space.decode()
        #: Bytes of normalised text that a piece stands for.
        self.size = np.array([1 if k == BYTE else len(t) for t, k in zip(texts, kinds, strict=True)], np.int64)
        joins = any(re.search(f"[^{mark}]{mark}", t.decode()) for t, k in zip(texts, kinds, strict=True) if k == NORMAL)
        self.runs = re.compile(".+" if joins else f"{mark}*[^{mark}]+|{mark}+", re.DOTALL)
        self.library = SentencePieceProcessor(model_proto=content)
        # later fields override earlier ones: the same model without a map, a prefix or trimming
        bare = _field(CHARACTER_MAP, b"") + _field(DUMMY_PREFIX, 0) + _field(TRIM_SPACES, 0) + _field(ESCAPE_SPACES, 0)
        self.merger = SentencePieceProcessor(model_proto=content + _field(NORMALIZER, bare))
        self._clear()

    def _clear(self):
        self.known = _Slots()
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def normalised(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts data[off[i]:off[i+1]] the normalised bytes, the source place of each, their offsets by text, and where each text's last piece ends.

        Source places count from the text's own beginning.
        """
        n = np.diff(off)
        text_of = np.repeat(np.arange(len(n)), n)
        lead = data & 0xC0 != 0x80
        place = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        if self.map.starts is not None:
            data, place, text_of = self._mapped(data, off, place, text_of)
        blank = data == 0x20
        if self.trim:
            first = np.ones(len(data), bool)
            first[1:] = text_of[1:] != text_of[:-1]
            drop = blank & (first | np.concatenate(([False], blank[:-1])))  # at the front, or after another
            last_kept = np.full(len(n), -1)
            full = np.flatnonzero(~(blank | self._marks(data)))  # at the end the library takes a literal mark for a blank
            np.maximum.at(last_kept, text_of[full], full)
            tail = np.arange(len(data)) > last_kept[text_of]
            # a text whose blanks are trimmed off its end ends where the first of them stood
            end = n.copy()
            at = np.flatnonzero(tail & ~drop)[::-1]
            end[text_of[at]] = place[at] - off[text_of[at]]
            keep = ~(drop | tail)
            data, place, text_of, blank = data[keep], place[keep], text_of[keep], blank[keep]
        else:
            end = n.copy()
        width = np.where(blank, len(self.space), 1)
        if self.prefix:
            head = np.ones(len(data), bool)
            head[1:] = text_of[1:] != text_of[:-1]
            width = width + np.where(head, len(self.space), 0)
        source = np.repeat(place - off[text_of], width)
        out = np.repeat(data, width)
        size = np.bincount(text_of, width, len(n)).astype(np.int64) if len(data) else np.zeros(len(n), np.int64)
        begin = np.cumsum(width) - width
        marks = [begin[np.flatnonzero(head)]] if self.prefix else []
        inner = np.flatnonzero(blank)
        marks.append(begin[inner] + np.where(head[inner], len(self.space), 0) if self.prefix else begin[inner])
        for at in marks:
            for k, byte in enumerate(self.space):
                out[at + k] = byte
        return out, source, np.concatenate(([0], np.cumsum(size))), end

    def _marks(self, data: np.ndarray) -> np.ndarray:
        """Which bytes belong to a literal escape mark."""
        out = np.zeros(len(data), bool)
        if self.escape and len(data) > 2:
            at = np.flatnonzero((data[:-2] == _SPACE[0]) & (data[1:-1] == _SPACE[1]) & (data[2:] == _SPACE[2]))
            for k in range(3):
                out[at + k] = True
        return out

    def _mapped(self, data, off, place, text_of):
        """The bytes after replacing what the map knows; replaced ones all come from where their match begins."""
        width, put = np.ones(len(data), np.int64), []
        held = data.tobytes()
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            for begin, end, new in self.map.edits(held[a:b]):
                width[a + begin : a + end] = 0
                width[a + begin] = len(new)
                put.append((a + begin, new))
        at = np.cumsum(width) - width
        out = np.repeat(data, width)
        for begin, new in put:
            out[at[begin] : at[begin] + len(new)] = np.frombuffer(new, np.uint8)
        return out, np.repeat(place, width), np.repeat(text_of, width)

    def _merged(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some runs, and how many each has: as one text where no run can join the next, else one by one."""
        mark = self.space.decode()
        if all(r[0] == mark != r[-1] for r in runs):
            ids = np.asarray(self.merger.encode("".join(runs), return_type="numpy"), np.int32)
            bytes_of = np.fromiter((len(r.encode()) for r in runs), np.int64, len(runs))
            return ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(bytes_of)) + 1, prepend=0)
        lists = self.merger.encode(runs, num_threads=1)
        return np.fromiter((i for x in lists for i in x), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _add(self, runs: list[str]) -> None:
        parts = [self._merged(runs[k : k + _TOGETHER]) for k in range(0, len(runs), _TOGETHER)]
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
        self.count = np.concatenate([self.count, *(count for _, count in parts)])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends, offsets by text) of some texts, begin and end ids included."""
        if len(self.count) > CACHED_RUNS:
            self._clear()
        normal, source, cut, last = self.normalised(data, off)
        held = normal.tobytes()
        runs = [self.runs.findall(held[a:b].decode()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        flat = [r for x in runs for r in x]
        slot = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        fresh = self.known.taken()
        self._add(fresh)
        first = np.cumsum(self.count) - self.count
        count = self.count[slot]
        after = np.cumsum(count)
        total = int(after[-1]) if len(after) else 0
        ids = self.ids[np.repeat(first[slot] - (after - count), count) + np.arange(total)]
        for r in fresh:
            if len(r) > _LONG_RUN:  # its ids stay until all are cleared
                del self.known[r]
        # pieces laid end to end
        end = np.cumsum(self.size[ids])
        begin = end - self.size[ids]
        if total and end[-1] != len(normal) or not total and len(normal):
            raise ValueError("pieces don't cover the normalised text")
        per = np.concatenate(([0], after))[np.cumsum([0, *map(len, runs)])]
        begins, ends = source[begin], np.append(source, 0)[end]
        full = np.flatnonzero(np.diff(per))
        ends[per[full + 1] - 1] = last[full]
        n = np.diff(off)
        at = np.repeat(per, 2)[1:-1]  # before each text and after it
        limits = np.stack((np.zeros(len(n), np.int64), n), axis=1).ravel()
        both = np.tile([self.library.bos_id(), self.library.eos_id()], len(n))
        return np.insert(ids, at, both), np.insert(begins, at, limits), np.insert(ends, at, limits), per + 2 * np.arange(len(per))


def _encode(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    yield from _encoded(batches, Model(content.value))


def _encoded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in slices(batch, size=_SLICE):
            if any(map(_broken, rows.column("text"))):
                whole = pa.array([_broken(x) or x.as_py() for x in rows.column("text")], pa.string())
                rows = rows.set_column(rows.schema.get_field_index("text"), "text", whole)
                ((rows, data, off),) = slices(rows, size=len(data) * 3 + 1)
            ids, begins, ends, per = model.encode(data, off)
            cuts = pa.array(per.astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists], names=["doc_id", "ids", "begins", "ends"])


def _broken(text: pa.Scalar) -> str | None:
    """A text that isn't UTF-8 with the replacement character where it breaks, else None."""
    buffer = text.as_buffer()
    try:
        if buffer is not None:
            str(buffer, "utf-8")
    except UnicodeDecodeError:
        return bytes(buffer).decode("utf-8", "replace")
    return None


def _decode(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    yield from _decoded(batches, Model(content.value))


def _decoded(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        cut, ids = lists.offsets.to_numpy().tolist(), lists.values.to_numpy(zero_copy_only=False)
        texts = [model.library.decode(ids[a:b]) if b > a else "" for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digest(batches: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    """What encoding and decoding give for each document, as digests."""
    model = Model(content.value)
    for encoded in _encoded(batches, model):
        (decoded,) = _decoded(iter([encoded]), model)
        lists = [encoded.column(k) for k in ("ids", "begins", "ends")]
        cut = lists[0].offsets.to_numpy().tolist()
        ids, begins, ends = (x.flatten().to_numpy() for x in lists)
        words, spans = ids.astype("<u4"), np.stack((begins, ends), axis=1).astype("<u4")
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                encoded.column("doc_id"),
                pa.array(np.diff(cut), pa.int64()),
                pa.array([hashlib.sha256(words[a:b]).hexdigest() for a, b in parts], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded.column("text").to_pylist()], pa.string()),
                pa.array([zlib.crc32(spans[a:b]) for a, b in parts], pa.int64()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
        )


def _content(df: DataFrame, model_path: str | None):
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_path, "rb") as f:  # on the driver; executors get its content
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends): each text's pieces with begin and end ids, and the byte span of each in the text."""
    return map_arrow(_texts(docs), partial(_encode, content=_content(docs, model_path)), "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list is empty."""
    return map_arrow(encoded.select("doc_id", "ids"), partial(_decode, content=_content(encoded, model_path)), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Digests of what ``encode`` and ``decode`` give for each document, both in one pass, without their lists leaving the task."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return map_arrow(_texts(docs), partial(_digest, content=_content(docs, model_path)), schema)
