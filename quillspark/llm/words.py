"""Word and shingle hashes of Arrow text columns, vectorised with NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals the
regular expression ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_LONG = 256  # longer words are hashed whole, one by one
_SLICE = 1 << 19  # bytes of text worked on at a time


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection whose bits all depend on all bits of the input."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    code = np.arange(256)
    if fold:
        code[65:91] += 32
    return space, mix((code + 1).astype(_U) * _U(_BASE))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some documents.

    ``first`` has the offset of each document's first word (one more at the end),
    ``start`` and ``end`` the byte spans in ``data``, ``hash`` a mixed hash per word.
    """

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data, start, end, first, hash_):
        self.data, self.start, self.end, self.first, self.hash = data, start, end, first, hash_

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows of k words, the index of each one's first word, and offsets by document."""
        n = self.counts
        per = np.maximum(n - k + 1, 0)
        off = np.concatenate(([0], np.cumsum(per)))
        at = np.arange(off[-1]) + np.repeat(self.first[:-1] - off[:-1], per)
        if not len(at):
            return np.zeros(0, _U), at, off
        return rolled(self.hash, k)[at], at, off

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of k words by document, sorted; a shorter document's whole sequence is its one shingle."""
        h, _, off = self.windows(k)
        n = self.counts
        short = np.flatnonzero((n > 0) & (n < k))
        doc = np.repeat(np.arange(len(n)), np.diff(off))
        if len(short):
            own = np.array([_whole(self.hash[self.first[d] : self.first[d + 1]]) for d in short], _U)
            doc, h = np.concatenate((doc, short)), np.concatenate((h, own))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[keep], h[keep]
        return h, np.searchsorted(doc, np.arange(len(n) + 1))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """At each index the hash of k consecutive values; the last k - 1 entries mean nothing."""
    with np.errstate(over="ignore"):
        done, out, power = 0, np.zeros(len(h), _U), h
        size = 1
        # binary powers: spans of 1, 2, 4 ... values, appended as k needs them
        while True:
            if k & size:
                shifted = np.zeros_like(h)
                shifted[: len(h) - done or None] = power[done:] if done else power
                out = out * _U(pow(_BASE, size, 1 << 64)) + shifted
                done += size
            size *= 2
            if size > k:
                break
            half = size // 2
            nxt = np.zeros_like(h)
            if len(h) > half:
                nxt[:-half] = power[half:]
            power = power * _U(pow(_BASE, half, 1 << 64)) + nxt
        return mix(out + _U(k))


def _whole(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes() + len(h).to_bytes(8, "little"), digest_size=8).digest(), "little")


def split(data: np.ndarray, off: np.ndarray, fold: bool = False) -> Words:
    """Words of the documents data[off[i]:off[i+1]]; fold reads A-Z as a-z."""
    space, codes = _tables(fold)
    word = ~space[data]
    n = len(data)
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = word[cuts]
    stop[cuts - 1] = word[cuts - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(codes[data] * _powers(n, _BASE), out=total[1:])
        h = (total[e] - total[s]) * _powers(n + 1, pow(_BASE, -1, 1 << 64))[s]
        h = mix(h + (e - s).astype(_U))
    for i in np.flatnonzero(e - s > _LONG):
        word_bytes = data[s[i] : e[i]].tobytes()
        if fold:
            word_bytes = word_bytes.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        h[i] = int.from_bytes(hashlib.blake2b(word_bytes, digest_size=8).digest(), "little")
    return Words(data, s, e, np.searchsorted(s, off), h)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = _SLICE):
    """Parts of a batch with their text as (rows, data, offsets): whole documents, about ``size`` bytes unless one is longer."""
    data, off = raw(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield batch.slice(row, stop - row), data[off[row] : off[stop]], off[row : stop + 1] - off[row]
        row = stop
