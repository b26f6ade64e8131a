"""A context-mixing range coder for token ids; many independent blocks advance in lockstep.

Each id is one of four events: as the order-2 table predicts, as the order-1 table predicts, the
id that the order-0 table holds in its slot, or new. Three adaptive models (by the tables'
confidence, by agreement and the last event, by the last three events) give the event's
probabilities; weights that learn from each event mix them, and a carryless range coder takes the
mixture. Which slot, or which new id, follows in the same coder under adaptive order-0 frequencies
that learn from each id and are put to use every RENEW ids: a slot whole, a new id byte by byte.
All arithmetic is
on whole numbers, so any machine decodes what another encoded. A block starts from fresh tables, and
so can be decoded alone.

This is the definition, for any reader without Spark; queries code with RangeCoder.java, to the same bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GQR3"
HEAD = struct.Struct("<4sBII")  # magic, bytes of a new id, ids, coded words
BITS2, BITS1, BITS0 = 11, 10, 10
#: Shares are made anew before ids 0, 1, 2, 4, 8, .. and each multiple of RENEW.
RENEW = 128
#: Ids of a block at most; counts have 16 bits.
LONGEST = 65535
#: Words kept free in a lane's output: 64 ids take 8 words each at most.
ROOM = 1100
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_16 = np.uint64(16)
_48 = np.uint64(48)


class _Table:
    """Adaptive order-0 frequencies of a symbol below size, a row for each lane.

    What is coded with are cumulative shares of 1 << SHARE, made anew from the counts by renew(); a
    share mixes the counts with equal ones, which weigh as much as PRIOR symbols.
    """

    SHARE, PRIOR = 14, 64

    def __init__(self, lanes: int, size: int):
        self.size, self.row = size, size + 1
        self.n = np.zeros((lanes, size), np.uint16)
        self.ends = np.zeros((lanes, self.row), np.uint16)
        self.steps = np.arange(1, size, dtype=np.uint32)

    def renew(self, m: int) -> None:
        ends = self.n[:m].cumsum(axis=1, dtype=np.uint16)  # LONGEST at most
        total = ends[:, -1].astype(np.uint32)
        least = np.maximum((self.PRIOR << self.SHARE) // self.size // (total + self.PRIOR), 1).astype(np.uint32)
        scale = (((1 << self.SHARE) - self.size * least) << 16) // np.maximum(total, 1)
        ends = ends[:, :-1] * scale[:, None].astype(np.uint32)
        ends >>= 16
        ends += least[:, None] * self.steps
        self.ends[:m, 1:-1] = ends
        self.ends[:m, -1] = 1 << self.SHARE

    def narrow(self, low: np.ndarray, rng: np.ndarray, at: np.ndarray, given: np.ndarray | None, code: np.ndarray | None) -> np.ndarray:
        """Take a symbol of each of the lanes `at` (decoded where none is given) into low and rng, which are theirs alone."""
        flat, base = self.ends.ravel(), at * self.row
        r = rng >> np.uint64(self.SHARE)
        if given is None:
            v = np.minimum((code - low) // r, np.uint64((1 << self.SHARE) - 1)).astype(np.uint16)
            given, half = np.zeros(len(at), np.int64), self.size >> 1
            while half:
                given += half * (flat.take(base + (given + half)) <= v)
                half >>= 1
        own = base + given
        begin = flat.take(own).astype(np.uint64)
        low += r * begin
        np.multiply(r, flat.take(own + 1) - begin, out=rng)
        return given

    def learn(self, at: np.ndarray, symbols: np.ndarray) -> None:
        self.n.ravel()[at * self.size + symbols] += np.uint16(1)


class _Coder:
    """Range coders of n lanes; with words as input it decodes."""

    def __init__(self, n: int, words: np.ndarray, decode: bool, wide: np.ndarray):
        self.low, self.rng, self.pos = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64), np.zeros(n, np.int64)
        self.words, self.code, self.lanes, self.wide = words, None, np.arange(n), wide
        self.slots = _Table(n, 1 << BITS0)
        self.bytes = [_Table(n, 256) for _ in range(4 if wide.any() else 2)]  # of new ids, the lowest first
        if decode:
            self.code = np.zeros(n, np.uint64)
            for _ in range(4):
                self.code = (self.code << _16) | words[np.arange(n), self.pos].astype(np.uint64)
                self.pos += 1

    def renew(self, k: int, m: int) -> None:
        """Bring the shares up to date before the id at k."""
        if k % RENEW == 0 or k & (k - 1) == 0:
            for table in (self.slots, *self.bytes):
                table.renew(m)

    def event(self, m: int, bounds: list[np.ndarray], ev: np.ndarray | None) -> np.ndarray:
        low, rng = self.low[:m], self.rng[:m]
        if ev is None:
            v, r = self.code[:m] - low, rng >> _16
            ev = sum((v >= r * b.astype(np.uint64)).astype(np.int64) for b in bounds)
        _narrow(low, rng, bounds, ev)
        return ev

    def slot(self, at: np.ndarray, slots: np.ndarray | None) -> np.ndarray:
        low, rng = self.low[at], self.rng[at]
        slots = self.slots.narrow(low, rng, at, slots, None if self.code is None else self.code[at])
        self.low[at], self.rng[at] = low, rng
        return slots

    def settle(self, m: int) -> None:
        _shift(self.low[:m], self.rng[:m], self.lanes[:m], self.words, self.pos, self.code)

    def fresh(self, at: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """New ids of the lanes `at`, byte by byte from the top."""
        out = np.zeros(len(at), np.int64)
        for k in range(len(self.bytes) - 1, -1, -1):
            which = np.nonzero(self.wide[at])[0] if k > 1 else np.arange(len(at))
            if len(which):
                lanes = at[which]
                low, rng = self.low[lanes], self.rng[lanes]
                got = self.bytes[k].narrow(low, rng, lanes, None if ids is None else ids[which] >> 8 * k & 255, None if self.code is None else self.code[lanes])
                _shift(low, rng, lanes, self.words, self.pos, self.code)
                self.low[lanes], self.rng[lanes] = low, rng
                self.bytes[k].learn(lanes, got)
                out[which] |= got << 8 * k
        return out


class _Model:
    """Predictions for up to n lanes; lanes beyond the active count m rest."""

    def __init__(self, n: int):
        self.t2, self.c2 = np.zeros(n << BITS2, np.uint32), np.zeros(n << BITS2, np.int8)
        self.t1, self.c1 = np.zeros(n << BITS1, np.uint32), np.zeros(n << BITS1, np.int8)
        self.t0 = np.zeros(n << BITS0, np.uint32)
        # A model's row: probabilities of events 0 to 2 of 65536; the last event has the rest.
        self.p = [np.full((n * k, 4), 16384, np.int32) for k in (16, 8, 64)]
        self.w = [np.full(n, 1365, np.int32) for _ in range(2)]  # of 4096; the third model has the rest
        self.prev1, self.prev2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.past = np.zeros(n, np.int32)
        self.lane = np.arange(n, dtype=np.int32)
        self.base2, self.base1, self.base0 = (self.lane.astype(np.int64) << k for k in (BITS2, BITS1, BITS0))

    def predict(self, m: int) -> list[np.ndarray]:
        """Lower bounds of events 1 to 3 in 65536."""
        p1 = self.prev1[:m]
        self.i2 = self.base2[:m] + ((p1 * _M1 + self.prev2[:m] * _M2) >> np.uint32(32 - BITS2))
        self.i1 = self.base1[:m] + ((p1 * _M2) >> np.uint32(32 - BITS1))
        self.e2, self.e1 = self.t2.take(self.i2), self.t1.take(self.i1)
        self.k2, self.k1 = self.c2.take(self.i2), self.c1.take(self.i1)
        lane, past = self.lane[:m], self.past[:m]
        self.at = (lane << 4) + ((self.k2 << 2) | self.k1), (lane << 3) + ((past & 3) << 1) + (self.e2 == self.e1), (lane << 6) + past
        self.q = [p.take(i, axis=0) for p, i in zip(self.p, self.at, strict=True)]
        w0, w1 = self.w[0][:m], self.w[1][:m]
        w2 = 4096 - w0 - w1
        f = self.q[0] * w0[:, None]
        f += self.q[1] * w1[:, None]
        f += self.q[2] * w2[:, None]
        f >>= 12
        f -= f >> 8
        f += 64
        one = f[:, 0]
        two = one + f[:, 1]
        return [one, two, two + f[:, 2]]

    def slot(self, ids: np.ndarray) -> np.ndarray:
        return (ids * _M1) >> np.uint32(32 - BITS0)

    def event(self, ids: np.ndarray) -> np.ndarray:
        held = self.t0.take(self.base0[: len(ids)] + self.slot(ids)) == ids
        return np.where(ids == self.e2, 0, np.where(ids == self.e1, 1, 3 - held))

    def learn(self, m: int, ids: np.ndarray, ev: np.ndarray) -> None:
        self.t0[self.base0[:m] + self.slot(ids)] = ids
        for t, c, i, e, k in ((self.t2, self.c2, self.i2, self.e2, self.k2), (self.t1, self.c1, self.i1, self.e1, self.k1)):
            hit = e == ids
            t[i] = np.where(hit | (k > 0), e, ids)
            c[i] = np.where(hit, np.minimum(k + np.int8(1), np.int8(3)), np.maximum(k - np.int8(1), np.int8(0)))
        flat = (self.lane[:m] << 2) + ev
        likely = [q.ravel().take(flat) for q in self.q]
        for k in (0, 1):
            w = self.w[k][:m]
            w += (likely[k] - likely[2]) >> 10
            np.minimum(w, 1900, out=w)
            np.maximum(w, 128, out=w)
        for p, q, i in zip(self.p, self.q, self.at, strict=True):
            q -= q >> 4
            q.ravel()[flat] += 4095
            p[i] = q
        self.past[:m] = ((self.past[:m] << 2) | ev) & 63
        self.prev2[:m] = self.prev1[:m]
        self.prev1[:m] = ids


def _active(lengths: np.ndarray) -> np.ndarray:
    """For each step, how many lanes (longest first) still have ids."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), side="right")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (uint32) as bytes that end in their CRC-32."""
    if not blocks:
        return []
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    sizes = np.array([len(blocks[i]) for i in order])
    n, longest = len(blocks), int(sizes[0])
    if longest > LONGEST:
        raise ValueError(f"a block has more than {LONGEST} ids")
    ids = np.zeros((longest, n), np.uint32)
    for lane, i in enumerate(order):
        ids[: sizes[lane], lane] = blocks[i]
    wide = (ids > 65535).any(axis=0)
    model, coder = _Model(n), _Coder(n, np.zeros((n, longest + ROOM), np.uint16), False, wide)
    for k, m in enumerate(_active(sizes)):
        m = int(m)
        if k % 64 == 0 and int(coder.pos.max()) + ROOM // 2 > coder.words.shape[1]:
            coder.words = np.concatenate([coder.words, np.zeros((n, longest + ROOM), np.uint16)], axis=1)
        coder.renew(k, m)
        bounds, now = model.predict(m), ids[k, :m]
        ev = coder.event(m, bounds, model.event(now))
        held, new = np.nonzero(ev == 2)[0], np.nonzero(ev == 3)[0]
        slots = model.slot(now).astype(np.int64)
        coder.slot(held, slots[held])
        coder.settle(m)
        if len(new):
            coder.fresh(new, now[new].astype(np.int64))
        known = np.nonzero(ev >= 2)[0]
        coder.slots.learn(known, slots[known])
        model.learn(m, now, ev)
    out = coder.words
    for _ in range(4):
        out[np.arange(n), coder.pos] = (coder.low >> _48).astype(np.uint16)
        coder.low <<= _16
        coder.pos += 1
    done: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        size = int(coder.pos[lane])
        body = HEAD.pack(MAGIC, 4 if wide[lane] else 2, int(sizes[lane]), size) + out[lane, :size].astype("<u2").tobytes()
        done[i] = body + struct.pack("<I", zlib.crc32(body))
    return done


def _narrow(low: np.ndarray, rng: np.ndarray, bounds: list[np.ndarray], ev: np.ndarray) -> None:
    """Take each lane's event into its coder."""
    edges = np.empty((5, len(ev)), np.uint64)
    edges[0], edges[1], edges[2], edges[3], edges[4] = 0, *bounds, 65536
    at = ev * len(ev) + np.arange(len(ev))
    flat = edges.ravel()
    c = flat.take(at)
    r = rng >> _16
    low += r * c
    np.multiply(r, flat.take(at + len(ev)) - c, out=rng)


def _shift(lo: np.ndarray, rg: np.ndarray, lanes: np.ndarray, words: np.ndarray, pos: np.ndarray, code: np.ndarray | None) -> None:
    """Move settled words of these lanes' coders out (or, with code, further words into the decoders)."""
    same = (lo ^ (lo + rg)) < _TOP
    at = np.nonzero(same | (rg < _BOT))[0]
    while len(at):
        a, g, lane = lo[at], rg[at], lanes[at]
        g = np.where(same[at], g, (~a + np.uint64(1)) & (_BOT - np.uint64(1)))
        if code is None:
            words[lane, pos[lane]] = (a >> _48).astype(np.uint16)
        else:
            code[lane] = (code[lane] << _16) | words[lane, pos[lane]].astype(np.uint64)
        pos[lane] += 1
        a, g = a << _16, g << _16
        lo[at], rg[at] = a, g
        again = (a ^ (a + g)) < _TOP
        same[at] = again
        at = at[again | (g < _BOT)]


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a checksum or the form is wrong."""
    if not payloads:
        return []
    heads = []
    for p in payloads:
        if len(p) < HEAD.size + 4 or p[:4] != MAGIC or zlib.crc32(p[:-4]) != struct.unpack("<I", p[-4:])[0]:
            raise ValueError("damaged block")
        heads.append(HEAD.unpack_from(p))
    order = np.argsort([-h[2] for h in heads], kind="stable")
    sizes = np.array([heads[i][2] for i in order])
    n, longest = len(payloads), int(sizes[0])
    words = np.zeros((n, max(h[3] for h in heads) + 8), np.uint16)
    wide = np.array([heads[i][1] == 4 for i in order])
    for lane, i in enumerate(order):
        words[lane, : heads[i][3]] = np.frombuffer(payloads[i], "<u2", heads[i][3], HEAD.size)
    model, coder = _Model(n), _Coder(n, words, True, wide)
    ids = np.zeros((longest, n), np.uint32)
    for k, m in enumerate(_active(sizes)):
        m = int(m)
        coder.renew(k, m)
        ev = coder.event(m, model.predict(m), None)
        now = np.where(ev == 0, model.e2, model.e1)
        held, new = np.nonzero(ev == 2)[0], np.nonzero(ev == 3)[0]
        now[held] = model.t0[(held << BITS0) + coder.slot(held, None)]
        coder.settle(m)
        if len(new):
            now[new] = coder.fresh(new, None)
        ids[k, :m] = now
        known = np.nonzero(ev >= 2)[0]
        coder.slots.learn(known, model.slot(now[known]).astype(np.int64))
        model.learn(m, now, ev)
    done: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    for lane, i in enumerate(order):
        done[i] = ids[: sizes[lane], lane].copy()
    return done
