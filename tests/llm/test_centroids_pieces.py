"""Centroid clustering against integers without shortcuts; SentencePiece against the library."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from quillspark.llm import centroids, pieces

SF = "/root/testdata/sf0.001"


# ---- centroid clustering


def _brute(rows, rounds=centroids.ROUNDS):
    """Rows (vec_id, components) clustered with Python's integers."""
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    held = [v for _, v in order[:8]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(held))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in range(len(held)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == k]
            if own:
                held[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [nearest(v) for _, v in kept]
    cap = (1 << 63) - 1
    inertia = [sum(d for d, k in found if k == c) for c in range(len(held))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in held]
    return sorted(((i, k, min(d, cap), min(inertia[k], cap), min(sum(inertia), cap), digest[k]) for (i, _), (d, k) in zip(kept, found, strict=True)), key=repr)


def _clustered(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, distance string, q string")
    return sorted(map(tuple, centroids.clusters(df.repartition(3)).collect()), key=repr)


def _vectors(seed, n, make):
    rng = random.Random(seed)
    return [(i, [float(np.float32(make(rng))) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        _vectors(1, 60, lambda r: r.gauss(0, 0.2)),
        _vectors(2, 40, lambda r: r.choice([0.0, 0.0009765625])),  # many ties
        _vectors(3, 40, lambda r: r.choice([-1, 1]) * 2.0 ** r.randint(0, 15)),
        _vectors(4, 30, lambda r: r.choice([0.5, 3e38, -3e38, 7e4])),  # beyond four bytes and beyond longs
        [*_vectors(5, 12, lambda r: r.random()), *_vectors(5, 12, lambda r: r.random()), (None, [0.25] * 64), (None, [0.5] * 64)],
        [(1, None), (2, []), (3, [0.1] * 63), (4, [0.1] * 65), (5, [float("nan")] + [0.0] * 63), (6, [float("inf")] + [0.0] * 63), (7, [None] + [0.0] * 63), (8, [0.1] * 64), (9, [-0.0001] * 64)],
    ],
    ids=["plain", "ties", "large", "wide", "repeated", "left-out"],
)
def test_clusters_by_brute_force(spark, rows):
    assert _clustered(spark, [(*r, "x", "y", "z") for r in rows]) == _brute(rows)


def test_no_vectors(spark):
    assert _clustered(spark, []) == []


def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, centroids.query(spark, SF).collect()), key=repr) == _brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 25))
def test_intervals_hold_exact_distances(seed, bits):
    """Every exact value lies in its interval, and screening changes no assignment; near ties among large components included."""
    rng = np.random.default_rng(seed)
    top = 1 << bits
    numbers = rng.integers(-top, top + 1, (8, 64))
    numbers[1] = numbers[0]
    numbers[2] = numbers[0] + rng.integers(-1, 2, 64)
    v = np.concatenate((rng.integers(-top, top + 1, (20, 64)), numbers[:3] + rng.integers(-1, 2, (3, 64)), (numbers[3:5] + numbers[4:6]) // 2))
    known = centroids.Centroids(numbers.tolist())
    low, high = known.intervals(v)
    exact = [[sum(int(b) ** 2 - 2 * int(a) * int(b) for a, b in zip(x, c, strict=True)) for c in numbers] for x in v]
    assert all(lo <= e <= hi for a, b, c in zip(low, high, exact, strict=True) for lo, hi, e in zip(a, b, c, strict=True))
    cluster, distance, _ = known.assign(v)
    for x, k, d in zip(v, cluster, distance, strict=True):
        assert (int(d), int(k)) == min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(numbers))


def test_screening_settles_most_vectors():
    rng = np.random.default_rng(0)
    _, _, again = centroids.Centroids(rng.integers(-400, 400, (8, 64)).tolist()).assign(rng.integers(-400, 400, (1000, 64)))
    assert again < 20


# ---- SentencePiece


def _content():
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def _model(rule=None, **switches):
    """The public model under another normaliser; nothing is trained."""
    import sentencepiece

    told = b""
    if rule:
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        told += pieces._field(pieces.CHARACTER_MAP, dict(pieces._fields(spec))[pieces.CHARACTER_MAP])
    for number, value in switches.items():
        told += pieces._field(getattr(pieces, number), value)
    return _content() + pieces._field(pieces.NORMALIZER, told)


def _raw(texts):
    held = [t.encode() for t in texts]
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


AWKWARD = ["", " ", "   ", "▁", "▁ ▁", " ▁  ", "a\x00b", "<s>x</s>", "<0x41>", "a" * 3000, "é é", "ｋ①㍿ﬁ", "각힣 한", "😀漢字", "\t\n  x\r\n", "¨ ¨", "  two  words  "]


@pytest.mark.parametrize("how", [(None, {}), (None, {"TRIM_SPACES": 1}), (None, {"DUMMY_PREFIX": 0}), ("nmt_nfkc", {"TRIM_SPACES": 1}), ("nmt_nfkc", {"DUMMY_PREFIX": 0}), ("nmt_nfkc_cf", {"TRIM_SPACES": 1})], ids=repr)
def test_pieces_and_spans_equal_the_library(how):
    import sentencepiece

    content = _model(how[0], **how[1])
    rng = random.Random(7)
    letters = list("ab éｋ①㍿ﬁ　\t\n▁  😀漢字Ａ½¨­​ß각한가é")
    texts = AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    library, model = sentencepiece.SentencePieceProcessor(model_proto=content), pieces.Model(content)
    ids, begins, ends, per = model.encode(*_raw(texts))
    for i, text in enumerate(texts):
        own = slice(per[i], per[i + 1])
        told = library.encode(text, return_type="proto").pieces
        n = len(text.encode())
        assert ids[own].tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert list(zip(begins[own].tolist(), ends[own].tolist(), strict=True)) == [(0, 0), *((p.begin, p.end) for p in told), (n, n)], text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text_equals_the_library(texts):
    model = _kept_model()
    ids, begins, ends, per = model.encode(*_raw(texts))
    for i, text in enumerate(texts):
        own = slice(per[i], per[i + 1])
        assert ids[own].tolist() == model.library.encode(text, add_bos=True, add_eos=True)
        covered = b"".join(text.encode()[a:b] for a, b in zip(begins[own].tolist(), ends[own].tolist(), strict=True))
        assert covered == text.encode()  # nothing is trimmed under this model


def _kept_model(kept=[]):  # noqa: B006
    if not kept:
        kept.append(pieces.Model(_content()))
    return kept[0]


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_RUNS", 5)
    model = pieces.Model(_content())
    for k in range(4):
        texts = [f"word{k} other{k} some more here {'x' * 300}{k}" for _ in range(3)]
        ids, _, _, per = model.encode(*_raw(texts))
        assert ids[per[1] : per[2]].tolist() == model.library.encode(texts[1], add_bos=True, add_eos=True)


def test_models_of_other_makes_are_refused():
    with pytest.raises(ValueError, match="byte fallback"):
        pieces.Model(_content() + pieces._field(pieces.TRAINER, pieces._field(pieces.MODEL_TYPE, 1)))


def test_round_trip_by_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=_content())
    rows = [(1, "a text  with\nblanks ", "x"), (2, None, None), (3, "", "y"), (3, "again", "y"), (None, "no id 😀", "z"), (5, "long " * 200_000, "w"), (6, "x" * 50_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    expected = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.round_trip(docs).drop("spans_crc32").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    encoded = pieces.encode(docs)
    assert sorted(map(tuple, pieces.decode(encoded).collect()), key=repr) == sorted(((i, library.decode(library.encode(t or ""))) for i, t, _ in rows), key=repr)
    assert pieces.round_trip(docs.limit(0)).collect() == []


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text union all select 2L, 'ok'")
    got = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert got == {1: "a�b", 2: "ok"}


def test_round_trip_of_the_table(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=_content())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert isinstance(next(iter(got.values())), Row)
