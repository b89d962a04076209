"""Vectors: norms, cosine distance, and a deterministic bag-of-words embedding."""

from __future__ import annotations

import hashlib
from collections import Counter, OrderedDict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import constants as C


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length as floats; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def cosine_distance(v: Column, query: list[float]) -> Column:
    """One minus the cosine; null for zero vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    norm = F.sqrt(dot(v, v)) * F.lit(size)
    return F.when(norm > 0, 1 - dot(v, q) / norm)


def hash_embed(text: str, dim: int = C.EMBED_DIM) -> list[float]:
    """Counts of words by md5 modulo the dimension, at unit length."""
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest(), 16) % dim for w in text.lower().split())
    norm = sum(c * c for c in counts.values()) ** 0.5
    out = [0.0] * dim
    for k, c in counts.items():
        out[k] = c / norm
    return out


class HashEmbedder:
    """Offline embedder; anything with these members can stand in for it."""

    model_name, dim = "hashed-bag-of-words", C.EMBED_DIM

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hash_embed(t[: C.EMBED_CHARS], self.dim) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return hash_embed(text, self.dim)

    def unload(self) -> None:
        pass


class CachedEmbedder:
    """An embedder that remembers the vectors of its last queries."""

    def __init__(self, inner, size: int = C.QUERY_CACHE):
        self.inner, self.size, self._known = inner, size, OrderedDict()
        self.model_name, self.dim = inner.model_name, inner.dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.inner.embed(texts)

    def embed_query(self, text: str) -> list[float]:
        if text in self._known:
            self._known.move_to_end(text)
        else:
            self._known[text] = self.inner.embed_query(text)
            if len(self._known) > self.size:
                self._known.popitem(last=False)
        return list(self._known[text])

    def unload(self) -> None:
        self._known.clear()
        self.inner.unload()


def bucket(word: Column, dim: int = C.EMBED_DIM) -> Column:
    """md5 of a word modulo the dimension, from its hex digits in 32-bit parts."""
    digest = F.md5(word)
    total = F.lit(0).cast("long")
    for k in range(0, 32, 8):
        total = (total * F.lit((1 << 32) % dim) + F.conv(F.substring(digest, k + 1, 8), 16, 10).cast("long")) % dim
    return total


def batches(sizes: pd.Series, area: int = C.BATCH_AREA, rows: int = C.BATCH_ROWS) -> pd.Series:
    """Batch numbers of texts sorted by length, cut before the padded area or the row count overflows."""
    out, batch, n = [], 0, 0
    for size in sizes:
        if n and ((n + 1) * size * size > area or n + 1 > rows):
            batch, n = batch + 1, 0
        n += 1
        out.append(batch)
    return pd.Series(out, dtype="int64")
