"""The corpus operators against brute force and on awkward input."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import decontaminate, line_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, substring_dedup, token_coder, token_output, warc
from quillspark.llm import words as W
from quillspark.llm.runtime import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, score double, label string, rep long"


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(n))


def _frame(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, s, "en", 0.5, "x", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, near copies."""
    rng = random.Random(5)
    base = _text(rng, 120)
    near = base.split()
    near[60] = "ZZZ"
    rows = [(0, base, "s"), (1, " ".join(near), "s"), (2, base.upper(), "s"), (3, None, "s"), (4, "", None), (5, " \t\n ", "s"), (6, "one two", "t"), (7, "one two", "t")]
    rows += [(8, _text(rng, 9000), "t"), (9, base + " " + _text(rng, 200), "u"), (10, base, "s"), (10, base, "s"), (None, base, "s"), (11, "é ß 😀 " * 30, "u")]
    return rows


def _shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(n, links):
    parent = {k: k for k in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in n}


def test_words_split_like_the_expression():
    texts = ["a b", "", None, "x", " y z w", "l1\nl2", "Q" * 700 + " " + "q" * 700]
    data, off = W.raw(pa.array(texts))
    assert W.split(data, off).counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    folded = W.split(data, off, fold=True)
    assert folded.hash[-1] == folded.hash[-2]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 13])
def test_rolled_hashes_tell_windows_apart(k):
    rng = np.random.default_rng(k)
    x = rng.integers(0, 3, 400)
    h = W.rolled(W.mix(x.astype(np.uint64)), k)[: 400 - k + 1]
    windows = [tuple(x[i : i + k]) for i in range(400 - k + 1)]
    assert len(set(h.tolist())) == len(set(windows)) == len(set(zip(h.tolist(), windows, strict=True)))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, awkward):
    rows = [r for r in awkward if r[0] is not None]
    sets = {i: _shingles(t) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    got = near_dedup.near_duplicates(_frame(spark, awkward)).collect()
    assert len(got) == len(awkward)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])


def test_near_duplicates_in_a_large_group(spark):
    """Copies edited so much that many miss the centre and link through others only."""
    rng = random.Random(2)
    base = _text(rng, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(150)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), "s"))
    sets = {i: _shingles(t) for i, t, _ in rows}
    want = _components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(_frame(spark, rows)).collect()} == want
    assert len(set(want.values())) > 1


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    shared, a, b = (W.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate((shared, x))) for x in (a, b)]
    regs = near_dedup.registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    assert abs((regs[0] == regs[1]).mean() - 0.8) < 0.13


def _removed(rows, span=13):
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, awkward):
    got = substring_dedup.remove_repeats(_frame(spark, awkward), with_text=True)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == _removed(awkward)


def test_substring_dedup_branches(spark):
    """Passages that overlap, meet and part in different documents, and runs of one word."""
    rng = random.Random(9)
    pool = [_text(rng, 30).split() for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(20)
            w += p[a : a + rng.randint(5, 30)] + [rng.choice(["x", "y"])] * rng.choice([0, 1, 20])
        rows.append((i, " ".join(w), "s"))
    got = substring_dedup.remove_repeats(_frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _removed(rows)


def test_substring_dedup_when_hashes_clash(spark, monkeypatch):
    """Anchors and paths known by a few bits: only the words at their places can tell them apart."""
    whole = substring_dedup.paths

    def clashing(w, span, anchor):
        akey, skey, *rest = whole(w, span, anchor)
        return akey & np.uint64(7), skey & np.uint64(3), *rest

    monkeypatch.setattr(substring_dedup, "paths", clashing)
    rng = random.Random(19)
    pool = [_text(rng, 40).split() for _ in range(5)]
    rows = []
    for i in range(25):
        parts = [(rng.choice(pool), rng.randrange(20), rng.randint(10, 30)) for _ in range(3)]
        rows.append((i, " ".join(" ".join(p[a : a + n]) for p, a, n in parts), "s"))
    got = substring_dedup.remove_repeats(_frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _removed(rows)


def test_line_dedup(spark, awkward):
    rng = random.Random(4)
    line = _text(rng, 40)
    rows = [*awkward, (20, f"{line}\nother {_text(rng, 30)}\n{line.upper()} ", "s"), (21, line.replace("a", "b", 1) + "\n\n \nok", "s"), (22, "ok\n" + _text(rng, 3000), "s")]
    got = {}
    for r in line_dedup.line_dedup(_frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_removed, r.removed))
    assert sum(map(len, got.values())) == len(rows)
    assert got[20] == [(3, 1, "2")] and got[21] == [(2, 1, "0")] and got[3] == [(0, 0, "")] and got[5] == [(0, 0, "")]
    assert got[22][0][1:] == (1, "0") and sorted(got[10]) == [(1, 1, "0")] * 2


def _characters(line):
    return {line[k : k + 5] for k in range(max(len(line) - 4, 1))}


def _same_component(spark, pairs):
    """Which of the pairs of lines, each a document, end in one component."""
    found = {}
    docs = _frame(spark, [(k, f"{a}\n{b}", "s") for k, (a, b) in enumerate(pairs)])
    for r in line_dedup.lines_of(docs).select("doc_id", "label").collect():
        found.setdefault(r.doc_id, set()).add(r.label)
    return [len(found[k]) == 1 for k in range(len(pairs))]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no driver tables here")
def test_line_dedup_recall_by_length(spark):
    """Lines of sf0.1 with one letter changed, at an exact similarity of 0.8 or more."""
    rng = random.Random(12)
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").orderBy("doc_id").limit(4000).select("text").collect()
    lines = sorted({x.strip().lower() for r in texts for x in r.text.split("\n")})
    rng.shuffle(lines)
    classes = {(3, 5): [], (6, 9): [], (10, 14): [], (15, 29): []}
    for x in lines:
        into = next((v for (lo, hi), v in classes.items() if lo <= len(x.split()) <= hi), None)
        if into is None or len(into) >= 250:
            continue
        for k in rng.sample(range(len(x)), len(x)):
            y = f"{x[:k]}{'q' if x[k] != 'q' else 'z'}{x[k + 1 :]}"
            a, b = _characters(x), _characters(y)
            if x[k] != " " and 100 * len(a & b) >= 80 * len(a | b):
                into.append((x, y))
                break
    met = _same_component(spark, [p for v in classes.values() for p in v])
    for words, v in classes.items():
        now, met = met[: len(v)], met[len(v) :]
        assert len(v) >= 20 and sum(now) >= 0.99 * len(v), (words, len(v), sum(now))


def test_line_dedup_of_long_tokens(spark):
    """Lines with exactly sixteen characters per word start, against the same with one more."""
    rng = random.Random(13)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    lines = [" ".join([token(15) for _ in range(k - 1)] + [token(16)]) for k in range(5, 21) for _ in range(6)]
    assert all(len(x) == 16 * len(x.split()) for x in lines)
    assert all(_same_component(spark, [(x, x + rng.choice("abc")) for x in lines]))


def test_quality_rules(spark, awkward):
    got = {r.doc_id: r for r in quality_rules.quality_rules(_frame(spark, awkward)).collect()}
    for i, t, _ in awkward:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 1000 else None
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        if again is not None:
            assert r.n_repeat_words == len(again)
            assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert r.kept is not None and (not r.base_failed or not r.kept)


def _base_spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in pii.BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, awkward):
    texts = ["mail a.b@c.d.e@f.g x@y a@b.com_x@y.org ..@a.b", "4111 1111 1111 1111 4111-1111-1111-1112 é 1.2.3.4.5 256.1.1.1 001.2.3.255 1.2.3.4.5.6.7.8", "+1 (017) 555-7713 +1234567 +12345678 ++1 2345678- (", "😀a@b.c " * 600 + "12 " * 2000]
    rng = random.Random(8)
    texts += ["".join(rng.choice("a1.@-+ 2(3") for _ in range(200)) for _ in range(60)]
    rows = [*awkward, *((100 + k, t, "s") for k, t in enumerate(texts))]
    want = sorted((str(i), hashlib.sha256(_base_spans(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in pii.personal_data(_frame(spark, rows)).collect()) == want


def test_contexts_find_what_the_expressions_miss(spark):
    rows = [(i, f"tel: +1 (0{i}7) 555-77{i}3 and more words here", "s") for i in range(10, 16)]
    rows += [(30, "please tel: 555-7713-99 today", "s"), (31, "the year 1999-2003-04 was fine", "s"), (32, "no tel: here", "s")]
    got = {r.doc_id: r for r in pii.personal_data(_frame(spark, rows)).collect()}
    assert got[30].spans == "phone:12:23" and got[30].n_phone == 0 and got[30].n_added == 1
    assert got[31].spans == "" and got[32].spans == "" and all(got[i].n_phone == 1 for i in range(10, 16))


def test_contexts_find_identifiers_with_blanks(spark):
    rows = [(i, f"call +1 (0{i}7) 555-77{i}3 and host 10.0.0.{i} and charge 4111 1111 1111 1111 now", "s") for i in range(10, 16)]
    luhn = ["4012888888881881", "5555555555554444", "5105105105105100"]
    rows += [(20 + i, f"charge {x} here", "s") for i, x in enumerate(luhn)]
    want = {30: ("call 415 555 1234 today", "phone:5:17"), 31: ("call (030) 1234 5678.", "phone:5:20"), 32: ("charge 3782 822463 10005 now", "card:7:24"), 33: ("host fe80::1 up", "ip:5:12"), 34: ("call 415 555 1234 5pm", "phone:5:17"), 35: ("the 415 555 1234 ones", ""), 36: ("at 10:30 host x", ""), 37: ("call 415 555 1234 10.9.8.7", "ip:18:26,phone:5:17")}
    want[38] = ("call 415 555 1234 123456789012", "phone:5:17")
    want |= {39: ("host fe::ab up", "ip:5:11"), 40: ("host ::1 up", "ip:5:8"), 41: ("host std::vector up", ""), 42: ("host a:b:c up", ""), 43: ("host " + "a:" * 20_000 + " up", "")}
    rows += [(k, t, "s") for k, (t, _) in want.items()]
    got = {r.doc_id: r.spans for r in pii.personal_data(_frame(spark, rows)).collect()}
    assert {k: got[k] for k in want} == {k: v for k, (_, v) in want.items()}


def _claims(found):
    """The bootstrapping told over dictionaries: claims (context, x) -> kind."""
    places = {(b.p[0], b.x, b.k, tuple(b.p)) for r in found for b in r.base if b.p} | {(f.p[0], f.x, f.seed, tuple(f.p)) for r in found for f in r.free if f.p}
    edges = {(c, x, k, p) for c, x, k, ps in places for p in ps}
    held, support = {}, {}
    for _, x, k, p in edges:
        held.setdefault(p, set()).add(x)
        if k is not None:
            support.setdefault((p, k), set()).add(x)
    support = {pk for pk, xs in support.items() if len(xs) >= pii.SUPPORT}
    makes = [re.compile(pii.MAKE[k]) for k in pii.KINDS]
    seeded = {(x, k): 1.0 for _, x, k, _ in edges if k is not None}
    scores, sp = dict(seeded), {}
    for _ in range(pii.ROUNDS):
        sp = {(p, k): sum(scores.get((x, k), 0.0) for x in held[p]) / len(held[p]) for p, k in support}
        best = {}
        for c, x, k, p in edges:
            for kind in range(len(makes)):
                if k is None and (p, kind) in sp and makes[kind].search(x):
                    best[c, x, kind] = max(best.get((c, x, kind), 0.0), sp[p, kind])
        wrong = {}
        for (_, x, kind), s in best.items():
            wrong[x, kind] = wrong.get((x, kind), 1.0) * max(1 - s, 1e-6)
        scores = {xk: max(seeded.get(xk, 0.0), 1 - wrong.get(xk, 1.0)) for xk in seeded.keys() | wrong.keys()}
    out = {}
    for c, x, k, p in edges:
        for kind in range(len(makes)):
            if k in (None, pii.KINDS.index("secret")) and sp.get((p, kind), 0) >= pii.PATTERN_SCORE and scores.get((x, kind), 0) >= pii.INSTANCE_SCORE and makes[kind].search(x):
                out[c, x] = min(kind, out.get((c, x), 9))
    return out


def test_bootstrapping_equals_brute_force(spark):
    rng = random.Random(21)
    digest = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(60):
        t = [f"call +1 (0{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)} soon", f"call {rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}", f'api key = "{digest()}" kept', f'API KEY = "{digest().upper()}"', f"mail to ann.{i}@host{i % 4}.example.org now", f"mail to ann{i}@localhost now", f"the year {1900 + i} and {digest(32)} stand", f"host 10.0.{i}.7 up", f"host 10.0.{i}.7.9 up", f"order {rng.randint(10**8, 10**9)}"]
        rows.append((i, " ".join(rng.sample(t, 4)), "s"))
    found = pii.scanned(_frame(spark, rows))
    want = _claims(found.collect())
    got = {(r.context, r.x): r.k for r in pii.bootstrap(found).collect()}
    assert got == want and {pii.KINDS[k] for k in got.values()} >= {"phone", "secret", "email"}


def test_keys_are_found_by_context(spark):
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'so token = "{digest(i)}" here', "s") for i in range(6)]
    rows += [(10, f'now TOKEN = "{digest(10).upper()}"### end', "s"), (11, f"commit {digest(11)} merged", "s"), (12, 'token = "AbCd-1234_efGH+5678" x', "s"), (13, 'token = "none" x', "s")]
    got = {r.doc_id: r for r in pii.personal_data(_frame(spark, rows)).collect()}
    assert got[0].spans == "secret:12:52" and got[10].spans == "secret:13:53" and got[12].spans == "secret:9:28"
    assert got[11].spans == got[13].spans == "" and got[12].n_secret == got[12].n_spans == 1 and got[12].n_email == 0


@pytest.mark.parametrize("n,vocab", [(0, 300), (1, 300), (5, 49408), (2048, 49408), (2049, 49408), (7000, 1 << 20)])
def test_coder_round_trip(n, vocab):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), vocab) - 1
    coded = token_coder.encode(ids, vocab)
    assert (token_coder.decode(coded) == ids).all()
    if n > 100:
        broken = bytearray(coded)
        broken[-9] ^= 0x55
        broken[-n // 4] ^= 0x55
        with pytest.raises(ValueError):
            token_coder.decode(bytes(broken))


@pytest.mark.parametrize("distinct", [200, 256, 300, 900, 20_000])
def test_coder_round_trip_without_frequent_ids(distinct):
    """Ids of about equal frequency fill every class of order 0, the last one too."""
    rng = np.random.default_rng(distinct)
    for ids in (np.tile(rng.integers(0, 49408, distinct), 60)[:20_000], rng.integers(0, distinct, 20_000)):
        assert (token_coder.decode(token_coder.encode(ids, 49408)) == ids).all()


def test_coder_learns():
    ids = np.tile(np.random.default_rng(0).integers(0, 49408, 300), 40)
    assert len(token_coder.encode(ids, 49408)) < len(ids)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables here")
def test_coder_beats_byte_compressors(spark):
    """Bits an id on the first documents of sf0.01, below zlib over 16-bit ids and a static order 0."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.array([i for e in tokenizer.encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 1]])
    coded = token_coder.encode(ids, 49408)
    assert (token_coder.decode(coded) == ids).all()
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    bits = 8 * len(coded) / len(ids)
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) and bits < -(share * np.log2(share)).sum()


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_output.parts_at_blanks(tokenizer)
    assert not token_output.parts_at_blanks(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["one two three", "", "unbelievably-long-token-1 unbelievably-long-token-2 one", "x"]

    def clashing(data, off, fold=False):
        w = W.split(data, off, fold)
        w.hash[:] = (w.end - w.start).astype(np.uint64)  # words of one length clash
        return w

    for change in (False, True):
        if change:
            monkeypatch.setattr(token_output, "split", clashing)
        ids, counts = token_output._ByWord(tokenizer, 1)(*W.raw(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]] and counts.sum() == len(ids)


def test_token_output(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_output.token_output(_frame(spark, awkward)).orderBy("start").collect()
    order = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t, _) in zip(got, order, strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_warc(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/x", big), (2, "http://b", "small"), (3, None, "small"), (4, "http://c/?q", big), (5, "http://d", None), (6, "http://e", "é\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (7, "http://f", big), (None, "http://g", "n"), (8, "http://h", ""), (9, "http://i\r\nX: y", "<p>long page</p>" * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, stored long")
    warc.write_captures(pages, str(tmp_path / "w"), file_bytes=700)
    records = warc.read_records(spark, str(tmp_path / "w"), with_payload=True)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert len(got) == len(rows) and all(r.request and r.metadata for r in got)
    by = {r.record_id.split(":")[2]: r.response for r in got}
    for i, _, html in rows:
        r, payload = by[str(i).replace("None", "null")], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.type == ("revisit" if i in (1, 4) else "response")
        assert r.payload == (None if i in (1, 4) else payload)
    assert by["1"].refers_to.startswith("urn:x-page:7:")
    # files are bounded by bytes, and each record is a gzip member that any reader of the format can read by itself
    listed = spark.read.parquet(str(tmp_path / "w" / "files.parquet")).collect()
    assert len(listed) > 3 and sum(r.captures for r in listed) == len(rows)
    members = 0
    for r in listed:
        left = (tmp_path / "w" / r.file).read_bytes()
        assert len(left) == r.bytes
        while left:
            one = zlib.decompressobj(31)
            assert one.decompress(left).startswith(b"WARC/1.1\r\n") and one.eof
            left, members = one.unused_data, members + 1
    assert members == 3 * len(rows)


def test_warc_repeated_rows_and_lost_files(spark, tmp_path):
    big = "y" * 1200
    pages = spark.createDataFrame([(5, "u", big), (5, "u", big), (4, "v", big), (4, "v", big), (3, "w", "s"), (3, "w", "s"), (None, "z", big)], "page_id long, url string, html string")
    warc.write_captures(pages, str(tmp_path / "w"))
    (tmp_path / "w" / "left-behind.warc.gz").write_bytes(b"of a lost executor")
    got = warc.read_records(spark, str(tmp_path / "w")).where("type in ('response', 'revisit')").collect()
    assert sorted((r.record_id.split(":")[2], r.type, (r.refers_to or "::-").split(":")[2]) for r in got) == [("3", "response", "-")] * 2 + [("4", "revisit", "5")] * 2 + [("5", "response", "-")] * 2 + [("null", "revisit", "5")]


def test_decontamination(spark, awkward):
    items = [(1, " ".join(WORD.findall(awkward[0][1])[40:75])), (2, "one two"), (3, "ONE two"), (4, None), (5, ""), (6, _text(random.Random(77), 40)), (1, " ".join(WORD.findall(awkward[0][1])[40:75]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(_frame(spark, awkward), bench).collect())
    want = []
    for i, t, _ in awkward:
        for k, b in items:
            x, y = _shingles(b), _shingles(t)
            if x and len(x & y) >= 0.8 * len(x):
                want.append((str(i), k))
    assert got == sorted(want) and ("9", 1) in got
    assert decontaminate.clean(_frame(spark, awkward), bench).columns == SCHEMA.replace(",", "").split()[::2]


def test_decontamination_in_blocks(spark, awkward, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    rng = random.Random(3)
    items = [(k, _text(rng, 30)) for k in range(20)]
    docs = [(k, _text(rng, 500) + " " + items[k][1] + " " + _text(rng, 10), "s") for k in range(20)]
    got = decontaminate.contaminated(_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(k, k) for k in range(20)]


def test_mixing(spark, awkward):
    rng = random.Random(6)
    rows = [*awkward, *((100 + k, _text(rng, rng.randint(5, 60)), rng.choice("abbbbbcccccccccccc")) for k in range(400))]
    got = mixing.mix(_frame(spark, rows), budget="cover").collect()
    assert len(got) == len(rows) and min(r.copies for r in got) >= 1 and max(r.copies for r in got) <= 2
    plain = mixing.mix(_frame(spark, rows), max_repetition=3.0).collect()
    n = {}
    for r in plain:
        t = n.setdefault(r.source, [0, 0, r.weight])
        t[0] += r.n_tokens
        t[1] += r.n_tokens * r.copies
    total = sum(t[0] for t in n.values())
    for tokens, emitted, weight in n.values():
        if tokens:
            assert emitted <= 3.01 * tokens + 9000 and abs(emitted - weight * total) <= max(r.n_tokens for r in plain)
    flat = mixing.mix(_frame(spark, rows), target_entropy=1.6, max_repetition=None).select("source", "weight").distinct().collect()
    assert -sum(r.weight * np.log(r.weight) for r in flat if r.weight > 0) >= 1.59
    made = mixing.realise(_frame(spark, rows), budget="cover")
    assert made.columns == SCHEMA.replace(",", "").split()[::2] and made.where('doc_id <> 10').count() == sum(r.copies for r in got if r.doc_id not in (10, None))


def test_mixing_covers_whatever_weights_round_to(spark, monkeypatch):
    """Weights rounded to one digit stand for a rounding error of many tokens, as nine digits leave at 30 GB and more."""
    rounded = mixing.F.round
    monkeypatch.setattr(mixing.F, "round", lambda c, scale=0: rounded(c, 1 if scale == 9 else scale))
    rows = [(k, "one two three", "a" if k < 140 else f"s{k % 3}") for k in range(230)]
    got = mixing.mix(_frame(spark, rows), budget="cover").collect()
    assert len(got) == 230 and min(r.copies for r in got) >= 1


def test_classifier(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        rows.append((k, "the " + " of the ".join(_text(rng, 4) for _ in range(20)) if good else " ".join(f"{_text(rng, 1)}$$$ |" for _ in range(60)), "s"))
        if k % 2:
            labels.append((k, int(good), 0))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "x" * 50_000, "s"), (None, "the of", "s")]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.score(_frame(spark, rows), known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    for k in range(600):
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    held = [k for k in range(600) if got[k].held_out]
    assert sum(got[k].predicted == int(k % 3 > 0) for k in held) / len(held) > 0.97
    kept = quality_classifier.accepted(_frame(spark, rows), known)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and kept.count() == sum(r.predicted for r in got.values())
    none = quality_classifier.score(_frame(spark, rows[:5]), known.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)


def test_compiled_rules_equal_the_fitted_ones(spark, awkward):
    """The score as Spark computes it against the rules over the statistics in NumPy, for repeated rows and awkward texts too."""
    rng = random.Random(30)
    rows = [*awkward, *((100 + k, _text(rng, rng.randint(1, 80)) + "$ " * rng.randint(0, 9) + "\nthe of " * rng.randint(0, 6), "s") for k in range(500))]
    docs = _frame(spark, rows)
    labels = spark.createDataFrame([(100 + k, int(t.count("$") < 4), 0) for k, (_, t, _) in enumerate(rows[len(awkward) :])], "doc_id long, quality int, toxic int")
    intercept, rules = quality_classifier.learn(docs, labels)
    assert rules
    stats = quality_classifier.statistics(docs).collect()
    x = np.array([[r[f] for f in quality_classifier.FEATURES] for r in stats])
    total = intercept + sum(w * quality_classifier._holds(x, rule) for w, rule in rules)
    want = sorted((str(r.doc_id), round(float(v), 9)) for r, v in zip(stats, 1 / (1 + np.exp(-total)), strict=True))
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in quality_classifier.score(docs, labels).collect()) == want
    assert len({s for i, s in want if i == "10"}) == 1


def test_statistics_by_brute_force(spark, awkward):
    stats = {r.doc_id: r for r in quality_classifier.statistics(_frame(spark, awkward)).collect()}
    for i, t, _ in awkward:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n = max(len(w), 1)
        want = {"n_words": len(w), "word_length": sum(map(len, w)) / n, "symbols": len(re.findall(r"[#*$%&<>]", t)) / n, "digits": len(re.findall("[0-9]", t)) / max(len(t), 1), "distinct_words": len(set(w)) / n, "distinct_pairs": len(set(zip(w, [*w[1:], None], strict=False))) / n, "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "line_words": len(w) / max(len(lines), 1)}
        for k, v in want.items():
            assert abs(stats[i][k] - v) < 1e-9, (i, k)


def test_empty_tables(spark):
    docs = _frame(spark, [])
    assert near_dedup.near_duplicates(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    assert pii.personal_data(docs).count() == 0
    assert token_output.token_output(docs).count() == 0
    assert mixing.mix(docs).count() == 0 and mixing.realise(docs, budget="cover").count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality_classifier.score(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.new_path(spark, "warc")
    warc.write_captures(pages, path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def _pipeline_tables(spark, folder, rows, items, labels):
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stages_by_brute_force(spark, tmp_path, awkward):
    import corpus_pipeline

    rng = random.Random(1)
    good = lambda: "the " + " of the ".join(_text(rng, 3) for _ in range(25))
    rows = [*awkward, (None, awkward[0][1], "s"), (10, awkward[9][1], "s"), (None, None, None), *((200 + k, good(), rng.choice("abc")) for k in range(60)), *((300 + k, "$$ |! " * rng.randint(20, 40), "d") for k in range(60))]
    rows += [(500, rows[25][1], "a"), (501, rows[26][1] + " tail", "b")]
    items = [(1, rows[20][1]), (2, " ".join(WORD.findall(awkward[8][1])[100:140])), (3, None), (4, "")]
    labels = [(200 + k, 1, 0) for k in range(60)] + [(300 + k, 0, 0) for k in range(60)]
    _pipeline_tables(spark, tmp_path, rows, items, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = lambda frame: sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=str)
    names = docs.columns
    for (name, stage), k in zip(corpus_pipeline.STAGES, (7, 8, 1, 10, 5), strict=True):
        before = told(docs)
        after = stage(spark, docs, str(tmp_path))
        if k != 5:
            assert after.columns == names
            after.write.parquet(f"{tmp_path}/{name}")
            after = spark.read.parquet(f"{tmp_path}/{name}")
        if k == 7:
            scores = quality_classifier.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
            assert len(told(after)) == sum(r.score >= quality_classifier.CUTOFF for r in scores)
            assert not [i for i, *_ in told(after) if i is not None and 300 <= i < 400]
            assert {i for i, *_ in told(after)} >= {200 + j for j in range(60)}
        elif k == 8:
            order = sorted(before, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
            sets = {j: _shingles(t) for j, (_, t, _) in enumerate(order)}
            links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            group = _components(sets, links)
            assert told(after) == sorted((r for j, r in enumerate(order) if group[j] == j), key=str) and len(told(after)) < len(before)
        elif k == 1:
            tests = [x for _, t in items if (x := _shingles(t))]
            assert told(after) == [r for r in before if not any(len(x & _shingles(r[1])) >= 0.8 * len(x) for x in tests)] and len(told(after)) < len(before)
        elif k == 10:
            copies = sum(r.copies for r in mixing.mix(docs, budget="cover", max_repetition=corpus_pipeline.MOST_COPIES).collect())
            assert set(told(after)) == set(before) and len(told(after)) >= copies >= len(before)
        else:
            import public_tokenizers
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in before)
            assert sorted((str(r.doc_id), r.n_tokens) for r in after.collect()) == want
        docs = after


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    _pipeline_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    """All lines of sf0.001, every pair by its exact similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = sorted({x.strip(" ").lower() for r in docs.collect() for x in (r.text or "").split("\n") if x.strip()})
    sets = [_characters(x) for x in lines]
    held = {}
    for k, x in enumerate(sets):
        for g in x:
            held.setdefault(g, []).append(k)
    links = []
    for a, x in enumerate(sets):
        shared = {}
        for g in x:
            for b in held[g]:
                if b > a:
                    shared[b] = shared.get(b, 0) + 1
        links += [(a, b) for b, n in shared.items() if 100 * n >= 80 * (len(x) + len(sets[b]) - n)]
    group = _components(range(len(lines)), links)
    got = {}
    for r in line_dedup.lines_of(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        line = r.text.split("\n")[r.pos].strip(" ").lower()
        if line.strip():
            got.setdefault(bytes(r.label), set()).add(line)
    want = {}
    for k, x in enumerate(lines):
        want.setdefault(group[k], set()).add(x)
    assert links and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_line_dedup_compares_a_pair_once(spark, monkeypatch):
    """Buckets of up to ``_PAIRED`` lines hand on pairs of lines, none of them twice, and no members with their texts."""
    rng = random.Random(21)
    lines = []
    for _ in range(40):  # a line, and others that stray from it by some steps of six words each
        words = _text(rng, 60).split()
        for _ in range(6):
            lines.append(" ".join(words))
            for k in rng.sample(range(60), 6):
                words[k] = _text(rng, 1)
    seen, grouped = [], []
    real = line_dedup.map_arrow

    def spied(df, function, schema):
        if function is line_dedup._compared:
            seen.extend((max(r.a, r.b), min(r.a, r.b)) for r in df.select("a", "b").collect())
        if getattr(function, "func", None) is line_dedup._crossed:
            grouped.append(df.count())
        return real(df, function, schema)

    monkeypatch.setattr(line_dedup, "map_arrow", spied)
    got = {}
    for r in line_dedup.lines_of(_frame(spark, [(k, x, "s") for k, x in enumerate(lines)])).collect():
        got.setdefault(bytes(r.label), set()).add(r.doc_id)
    sets = [_characters(x) for x in lines]
    group = _components(range(len(lines)), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    want = {}
    for k, g in group.items():
        want.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert grouped == [0] and len(seen) == len(set(seen)) > 0


def test_sizes_of_shingle_sets():
    """Short lines, repeated runs and more characters than fit a word of 64 bits."""
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 6000)))
    pairs = [("ab", "abcd"), ("a", "a"), ("abcde", "abcd"), ("😀", "😀é"), ("x" * 300, "x" * 7), (wide, wide[9:] + "é"), ("one line of text", "one line of test")]
    x, y = (pa.array(c) for c in zip(*pairs, strict=True))
    want = [(len(_characters(a) & _characters(b)), len(_characters(a)), len(_characters(b))) for a, b in pairs]
    assert list(zip(*line_dedup._sizes(x, y).tolist(), strict=True)) == want


def test_only_pairs_that_may_be_links_are_compared(spark, monkeypatch):
    """All pairs of unlike lines, copies with changes, short and very long lines: no link is lost, few others take their texts along."""
    rng = random.Random(8)
    lines = ["a", "b", "abcd", "abcde", "abcdef", "x" * 300, "x" * 7, "😀" * 6, "long " * 9000, "long " * 9000 + "end", "".join(rng.choices("abcdefghijklmnop", k=60_000))]
    for _ in range(12):
        words = _text(rng, 50).split()
        for k in range(4):
            lines.append(" ".join(words[k:] + [_text(rng, 1)] * k))
    lines.append(lines[10][: int(len(lines[10]) * 0.9)])
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = [_characters(x) for x in lines]
    pairs = list(itertools.combinations(range(len(lines)), 2))
    links = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    sketches = line_dedup.map_arrow(texts, line_dedup._sketched, "id long, n int, counts binary").cache()
    assert [r.n for r in sketches.orderBy("id").collect()] == [len(x) for x in sets]
    assert sketches.where("counts is null").count() > 0
    found = line_dedup._verified(spark.createDataFrame(pairs, "a long, b long"), texts, sketches, 80)
    seen = {(r.a, r.b): (r.both, r.n_a, r.n_b) for r in found.collect()}
    assert links and links <= set(seen) and len(seen) < len(links) + len(pairs) // 20
    assert all(seen[a, b] == (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in seen)
