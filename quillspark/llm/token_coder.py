"""Context-mixing range coder for token ids, run over many blocks at once.

A segment's header holds how frequent each of its ids is, by levels of half a bit. Blocks are
independent of each other: each starts from that prior and empty contexts, and carries a
checksum. All blocks of a segment advance together, one token a step, as lanes of NumPy
arrays.

For each token the order-2 and order-1 contexts predict one id each, with a confidence that
grows with hits, from hash slots that hold a check of their context. Order 0 gives an
adaptive distribution over all ids in two levels: 256 classes of about equal mass in the
prior, whose counts adapt within the block, and the prior inside a class. How far each order
is trusted is learned by counts for each joint state of confidence. The token's interval
comes from that mixture and narrows a carryless range coder of 64 bits; an id that order 0
tells narrows it once more, to its share of the class.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 2048, 2048
MAGIC = b"QTB2"
_TOTAL = 22  # bits of the mixture's total
_MOST = (1 << _TOTAL) - (1 << (_TOTAL - 3))  # what predictions may take of it at most
_CLASSES, _UNITS = 256, 12  # classes of order 0, bits of their total
_INSIDE = 16  # bits of the total inside a class
_SHARE = (1 << 17) - 1  # mask of a share or its begin
_NEAR = 8  # bits of a stretch of shares that a search starts from
_SLOTS = 11  # bits of a context table
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_REFRESH = 128  # steps between updates of the order-0 table
_START, _STEP = 12, 8  # what a class counts at first, and more for each token
_U = np.uint64


class _Prior:
    """Classes of ids and their shares, from the levels in a header."""

    def __init__(self, levels: np.ndarray):
        held = np.flatnonzero(levels)
        held = held[np.argsort(-levels[held].astype(np.int64), kind="stable")]
        mass = np.exp2((levels[held] - 1.0) / 2)
        before = np.cumsum(mass) - mass
        kind = np.minimum(before * _CLASSES / max(mass.sum(), 1e-9), _CLASSES - 1).astype(np.int64)
        first = np.concatenate(([True], kind[1:] != kind[:-1])) if len(held) else np.zeros(0, bool)
        kind = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        weight = np.add.reduceat(mass, begin) if len(begin) else np.zeros(0)
        size = np.diff(np.append(begin, len(held)))
        # shares inside a class: one unit each, the rest by mass
        spare = (1 << _INSIDE) - size
        share = 1 + np.floor(mass / weight[kind] * spare[kind]).astype(np.int64) if len(held) else np.zeros(0, np.int64)
        ends = np.cumsum(share)
        inside = ends - share - (ends - share)[begin][kind] if len(held) else share
        self.classes = max(len(begin), 1)
        self.packed = np.zeros(len(levels), np.int64)  # an id's class, where its share begins, and the share
        self.packed[held] = (kind << 34) | (inside << 17) | share
        self.sorted, self.at = held, (kind << _INSIDE) + inside  # ids in coding order and where their shares begin
        # the last id that begins at or before each stretch of shares, from where a search goes on
        self.near = np.searchsorted(self.at, np.arange((_CLASSES << (_INSIDE - _NEAR)) + 1) << _NEAR, "right") - 1

    def find(self, point: np.ndarray) -> np.ndarray:
        """The index in coding order of the id whose share holds each point."""
        stretch = point >> _NEAR
        low, high = self.near.take(stretch), self.near.take(stretch + 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.at.take(middle) <= point
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _levels(ids: np.ndarray, vocab: int) -> np.ndarray:
    n = np.bincount(ids, minlength=vocab)
    return np.where(n > 0, np.round(2 * np.log2(np.maximum(n, 1))) + 1, 0).astype(np.uint8)


#: Fields of 20 bits hold a state's trust; what a token adds to order 0, 1 or 2, by ``2 * hit2 + hit1``.
_FIELD, _FIELDS = (1 << 20) - 1, (0, 20, 40)
_TRUSTED = np.array([32 << 40, 32 << 20, 32, 32], np.int64)
_FULL = 4000  # of the fields' sum, beyond which they are halved
_UNIT = _MOST // np.maximum(np.arange(_FULL + 33), 1)
#: The confidence that follows, by ``8 * hit + confidence``.
_NEXT = np.array([c >> 1 for c in range(8)] + [min(c + 1, 7) for c in range(8)], np.int64)


class _Model:
    """Predictions of a number of lanes."""

    def __init__(self, lanes: int, prior: _Prior):
        self.lane = np.arange(lanes)
        self.table_base = self.lane << _SLOTS
        self.state_base = self.lane << 6
        self.class_base = self.lane * _CLASSES
        self.seen1 = np.zeros(lanes << _SLOTS, np.uint32)  # check of 8 bits, a set bit, id of 20 and confidence of 3
        self.seen2 = np.zeros(lanes << _SLOTS, np.uint32)
        self.trust = np.full(lanes << 6, 2 | 1 << 20 | 6 << 40, np.int64)
        self.counts = np.zeros((lanes, _CLASSES), np.int32)
        self.counts[:, : prior.classes] = _START
        self.prev1 = np.zeros(lanes, np.int64)
        self.prev2 = np.zeros(lanes, np.int64)
        self.step = 0

    def predict(self, decoding: bool) -> None:
        if self.step % _REFRESH == 0:
            scale = ((1 << _UNITS) - _CLASSES) / self.counts.sum(1, keepdims=True)
            freq = (self.counts * scale).astype(np.int32) + 1
            ends = np.cumsum(freq, axis=1, dtype=np.int32)
            self.freq, self.cum = freq.ravel(), (ends - freq).ravel()
            if decoding:  # class of each unit; what rounding leaves over is never coded
                held = freq.copy()  # the widths that are coded stay as they are
                held[:, -1] += (1 << _UNITS) - ends[:, -1]
                self.unit = np.repeat(np.tile(np.arange(_CLASSES, dtype=np.uint8), len(self.lane)), held.ravel())
                self.unit_base = self.lane << _UNITS
        self.step += 1
        hash1 = (self.prev1 + 1) * 0x9E3779B1
        hash2 = ((hash1 ^ (self.prev2 + 7)) * 0x85EBCA6B) & 0xFFFFFFFFFFFF
        self.at1 = self.table_base + ((hash1 >> 12) & ((1 << _SLOTS) - 1))
        self.at2 = self.table_base + ((hash2 >> 20) & ((1 << _SLOTS) - 1))
        self.check1, self.check2 = (hash1 >> 23) & 0x1FE | 1, (hash2 >> 31) & 0x1FE | 1
        e1, e2 = self.seen1.take(self.at1).astype(np.int64), self.seen2.take(self.at2).astype(np.int64)
        known1, known2 = (e1 >> 23) == self.check1, (e2 >> 23) == self.check2
        self.id1, self.id2 = np.where(known1, (e1 >> 3) & 0xFFFFF, -1), np.where(known2, (e2 >> 3) & 0xFFFFF, -1)
        self.conf1, self.conf2 = (e1 & 7) * known1, (e2 & 7) * known2
        self.state = self.state_base + (self.conf2 << 3) + self.conf1
        self.trusted = self.trust.take(self.state)
        trust2, trust1 = self.trusted & _FIELD, (self.trusted >> 20) & _FIELD
        self.total = trust2 + trust1 + (self.trusted >> 40)
        unit = _UNIT.take(self.total)
        self.w2 = trust2 * unit * known2
        self.w1 = trust1 * unit * (known1 & (self.id1 != self.id2))
        self.escape = self.w2 + self.w1
        self.unit_size = ((1 << _TOTAL) - self.escape) >> _UNITS

    def update(self, ids: np.ndarray, kind: np.ndarray) -> None:
        hit2, hit1 = ids == self.id2, ids == self.id1
        told2, told1 = hit2.view(np.uint8), hit1.view(np.uint8)
        trusted = self.trusted + _TRUSTED.take(2 * told2 + told1)
        over = np.flatnonzero(self.total > _FULL - 32)
        if len(over):
            held = trusted[over]
            trusted[over] = sum((((held >> f) & _FIELD) >> 1 | 1) << f for f in _FIELDS)
        self.trust[self.state] = trusted
        for seen, at, check, told, conf, old in ((self.seen2, self.at2, self.check2, told2, self.conf2, self.id2), (self.seen1, self.at1, self.check1, told1, self.conf1, self.id1)):
            # a hit's id is the old one
            seen[at] = (check << 23) | (np.where(conf > 0, old, ids) << 3) | _NEXT.take(8 * told + conf)
        self.counts.reshape(-1)[self.class_base + kind] += _STEP
        self.prev2, self.prev1 = self.prev1, ids

    def narrow(self, lanes: int) -> None:
        """Only the first lanes go on."""
        for name in ("lane", "table_base", "state_base", "class_base", "prev1", "prev2"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.counts = self.counts[:lanes].copy()
        self.step += -self.step % _REFRESH


def _blocks(n: int) -> np.ndarray:
    """Tokens in each block: all full but the last."""
    return np.minimum(BLOCK, n - np.arange(0, n, BLOCK))


def encode(ids: np.ndarray, vocab: int) -> bytes:
    """One segment: a header with the prior, the blocks' coded sizes and checksums, and the coded blocks."""
    ids = np.ascontiguousarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= vocab) or vocab > 1 << 20:
        raise ValueError("an id lies outside the vocabulary")
    size = _blocks(len(ids))
    levels = _levels(ids, vocab)
    prior = _Prior(levels)
    lanes = len(size)
    padded = np.full(lanes * BLOCK, ids[0] if len(ids) else 0, np.int64)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    model = _Model(lanes, prior)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    where, what = [], []
    ended: list = []
    for t in range(BLOCK if lanes > 1 else int(size.sum())):
        if lanes == len(model.lane) and t == size[-1] and lanes > 1:
            ended = [low[-1:].copy()]
            model.narrow(lanes - 1)
            low, span = low[:-1], span[:-1]
        now = columns[t, : len(low)]
        model.predict(False)
        own = prior.packed.take(now)
        kind = own >> 34
        at = model.class_base + kind
        is2 = now == model.id2
        is1 = ~is2 & (now == model.id1)
        told = is2 | is1
        begin = np.where(is2, 0, np.where(is1, model.w2, model.escape + model.unit_size * model.cum.take(at)))
        width = np.where(is2, model.w2, np.where(is1, model.w1, model.unit_size * model.freq.take(at)))
        r = span >> _U(_TOTAL)
        low = low + r * begin.view(_U)
        span = r * width.view(_U)
        r = span >> _U(_INSIDE)
        low = np.where(told, low, low + r * ((own >> 17) & _SHARE).view(_U))
        span = np.where(told, span, r * (own & _SHARE).view(_U))
        while True:
            same = (low ^ (low + span)) < _TOP
            due = same | (span < _BOTTOM)
            i = np.flatnonzero(due)
            if not len(i):
                break
            lo = low[i]
            span[i] = np.where(same[i], span[i], (~lo + _U(1)) & (_BOTTOM - _U(1))) << _U(16)
            where.append(i)
            what.append((lo >> _U(48)).astype(np.uint16))
            low[i] = lo << _U(16)
        model.update(now, kind)
    low = np.concatenate([low, *ended])
    for k in (48, 32, 16, 0):
        where.append(np.arange(lanes))
        what.append(((low >> _U(k)) & _U(0xFFFF)).astype(np.uint16))
    lane = np.concatenate(where) if where else np.zeros(0, int)
    order = np.argsort(lane, kind="stable")
    units = (np.concatenate(what) if what else np.zeros(0, np.uint16))[order].astype("<u2")
    sizes = np.bincount(lane, minlength=lanes).astype("<u4")
    flat = ids.astype("<u4")
    sums = np.array([zlib.crc32(flat[k : k + BLOCK].tobytes()) for k in range(0, len(flat), BLOCK)], "<u4")
    header = zlib.compress(levels.tobytes(), 6)
    return MAGIC + struct.pack("<IIII", len(ids), lanes, vocab, len(header)) + header + sizes.tobytes() + sums.tobytes() + units.tobytes()


def decode(payload: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError if a block doesn't match its checksum."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of coded tokens")
    n, lanes, vocab, head = struct.unpack_from("<IIII", payload, 4)
    if not lanes:
        return np.zeros(0, np.int64)
    try:
        levels = np.frombuffer(zlib.decompress(payload[20 : 20 + head]), np.uint8)
    except zlib.error as e:
        raise ValueError("the header is damaged") from e
    at = 20 + head
    sizes = np.frombuffer(payload, "<u4", lanes, at).astype(np.int64)
    sums = np.frombuffer(payload, "<u4", lanes, at + 4 * lanes)
    units = np.concatenate((np.frombuffer(payload, np.uint8, -1, at + 8 * lanes).view("<u2").astype(_U), np.zeros(8, _U)))
    prior = _Prior(levels)
    size = _blocks(n)
    model = _Model(lanes, prior)
    point = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _U(16)) | units[np.minimum(point, len(units) - 1)]
        point = point + 1
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    out = np.zeros((BLOCK, lanes), np.int64)
    for t in range(BLOCK if lanes > 1 else n):
        if lanes == len(low) and t == size[-1] and lanes > 1:
            model.narrow(lanes - 1)
            low, span, code, point = low[:-1], span[:-1], code[:-1], point[:-1]
        model.predict(True)
        r = np.maximum(span >> _U(_TOTAL), _U(1))
        v = np.minimum((code - low) // r, _U((1 << _TOTAL) - 1)).astype(np.int64)
        is2, is1 = v < model.w2, (v >= model.w2) & (v < model.escape)
        told = is2 | is1
        unit = np.minimum(np.maximum(v - model.escape, 0) // model.unit_size, (1 << _UNITS) - 1)
        kind = model.unit.take(model.unit_base + unit).astype(np.int64)
        at = model.class_base + kind
        begin = np.where(is2, 0, np.where(is1, model.w2, model.escape + model.unit_size * model.cum.take(at)))
        width = np.where(is2, model.w2, np.where(is1, model.w1, model.unit_size * model.freq.take(at)))
        low = low + r * begin.view(_U)
        span = r * width.view(_U)
        r = np.maximum(span >> _U(_INSIDE), _U(1))
        inside = np.minimum((code - low) // r, _U((1 << _INSIDE) - 1)).astype(np.int64)
        now = prior.sorted.take(prior.find((kind << _INSIDE) + inside))
        now = np.where(is2, model.id2, np.where(is1, model.id1, now))
        own = prior.packed.take(now)
        low = np.where(told, low, low + r * ((own >> 17) & _SHARE).view(_U))
        span = np.where(told, span, r * (own & _SHARE).view(_U))
        while True:
            same = (low ^ (low + span)) < _TOP
            due = same | (span < _BOTTOM)
            i = np.flatnonzero(due)
            if not len(i):
                break
            lo = low[i]
            span[i] = np.where(same[i], span[i], (~lo + _U(1)) & (_BOTTOM - _U(1))) << _U(16)
            low[i] = lo << _U(16)
            code[i] = (code[i] << _U(16)) | units[np.minimum(point[i], len(units) - 1)]
            point[i] += 1
        out[t, : len(now)] = now
        model.update(now, own >> 34)
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n]
    flat = ids.astype("<u4")
    for k, crc in enumerate(sums):
        if zlib.crc32(flat[k * BLOCK : (k + 1) * BLOCK].tobytes()) != crc:
            raise ValueError(f"block {k} doesn't match its checksum")
    return ids
