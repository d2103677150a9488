"""Lossless WebP (the VP8L bitstream) in numpy: a decoder for the whole format, and an encoder.

The decoder works on many images at once. Each image's headers are read by a
coroutine; whenever one needs pixels (of the image itself, or of a palette,
predictor, colour or entropy sub-image), the pixels of all waiting images are
decoded in lockstep, one symbol per image and step, with vector operations over
the images.
"""

from __future__ import annotations

import heapq
from collections.abc import Generator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

PREDICT, CROSS, GREEN, PALETTE = range(4)
LENGTHS, DISTANCES = 24, 40

# Fixed values of the format: the order of code length codes, and the places of the 120 short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# --- prefix codes ---------------------------------------------------------

@lru_cache(maxsize=32)
def _reversal(bits: int) -> np.ndarray:
    """Position of each bits-wide number when its bits are read backwards."""
    x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for k in range(bits):
        out |= (x >> k & 1) << (bits - 1 - k)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol << 4 | length by the next bits, number of those bits) of a canonical code; one symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if not len(used):
        raise ValueError("prefix code without symbols")
    if len(used) == 1:
        return np.array([used[0] << 4], np.uint16), 0
    n = lengths[used]
    order = np.argsort(n, kind="stable")
    used, n = used[order], n[order]
    most = int(n[-1])
    span = 1 << (most - n)
    if int(span.sum()) != 1 << most:
        raise ValueError("prefix code is not complete")
    return np.repeat((used << 4 | n).astype(np.uint16), span)[_reversal(most)], most


def encode_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, to be written lowest bit first; 0 for one symbol alone."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    n = lengths[used]
    order = np.argsort(n, kind="stable")
    used, n = used[order], n[order]
    most = int(n[-1])
    span = (1 << (most - n)).astype(np.int64)
    first = np.cumsum(span) - span
    out[used] = _reversal(most)[first]
    return out


def code_lengths(counts: np.ndarray, most: int = 11) -> np.ndarray:
    """Lengths of a Huffman code, none above most; at least one symbol counts."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used[0] if len(used) else 0] = 1
        return out
    weight = counts[used].tolist()
    floor = max(1, sum(weight) >> most)
    while True:
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        up = [0] * (2 * len(weight))
        nxt = len(weight)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            up[a[1]] = up[b[1]] = nxt
            heapq.heapreplace(heap, (a[0] + b[0], nxt))
            nxt += 1
        depth = [0] * nxt
        for i in range(nxt - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        got = depth[: len(weight)]
        if max(got) <= most:
            out[used] = got
            return out
        weight = [max(w, floor) for w in weight]
        floor *= 2


def prefix_value(value: int) -> tuple[int, int, int]:
    """(symbol, number of extra bits, their value) for a length or distance from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + (v >> extra), extra, v & ((1 << extra) - 1)


# --- bit streams ----------------------------------------------------------

class Reader:
    """Bits of one stream, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self._move(at)

    def _move(self, at: int) -> None:
        byte = at >> 3
        self.base = byte << 3
        self.word = int.from_bytes(self.data[byte : byte + 64], "little") >> (at & 7)
        self.at = at
        self.room = self.base + 512 - at

    def peek(self, n: int) -> int:
        if self.room < n:
            self._move(self.at)
        return self.word & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.word >>= n
        self.at += n
        self.room -= n

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.skip(n)
        return v


class Writer:
    def __init__(self):
        self.word, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.word |= int(value) << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.word.to_bytes((self.n + 7) // 8, "little")


@lru_cache(maxsize=512)
def _length_table(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    table, bits = decode_table(np.array(lengths))
    return table.tolist(), bits


def read_code(r: Reader, size: int) -> np.ndarray:
    """Code lengths of one prefix code of the given alphabet size."""
    out = np.zeros(size, np.int64)
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        out[r.bits(8 if wide else 1)] = 1
        if two:
            out[r.bits(8)] = 1
        return out
    kinds = [0] * 19
    for k in LENGTH_ORDER[: 4 + r.bits(4)]:
        kinds[k] = r.bits(3)
    table, bits = _length_table(tuple(kinds))
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    got: list[int] = []
    before = 8
    while len(got) < size and left > 0:
        left -= 1
        e = table[r.peek(bits)]
        r.skip(e & 15)
        s = e >> 4
        if s < 16:
            got.append(s)
            before = s or before
        elif s == 16:
            got += [before] * (3 + r.bits(2))
        else:
            got += [0] * (3 + r.bits(3) if s == 17 else 11 + r.bits(7))
    if len(got) > size:
        raise ValueError("code lengths beyond the alphabet")
    out[: len(got)] = got
    return out


# Fixed choice of the encoder: one complete code for all code lengths.
_KIND_LENGTHS = np.array([4, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 4, 4])
_KIND_CODES = encode_codes(_KIND_LENGTHS).tolist()
_KIND_HEAD = Writer()
_KIND_HEAD.bits(0, 1)
_KIND_HEAD.bits(15, 4)
for _k in LENGTH_ORDER:
    _KIND_HEAD.bits(int(_KIND_LENGTHS[_k]), 3)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        w.bits(1, 1)
        w.bits(len(used) == 2, 1)
        w.bits(1, 1)
        w.bits(first, 8)
        if len(used) == 2:
            w.bits(int(used[1]), 8)
        return
    w.bits(_KIND_HEAD.word, _KIND_HEAD.n)
    word, n = 0, 0
    tokens = 0
    seq = lengths[: used[-1] + 1].tolist()
    if len(used) == 1:
        seq[-1] = 1
    i = 0
    while i < len(seq):
        s = seq[i]
        if s:
            word |= _KIND_CODES[s] << n
            n += int(_KIND_LENGTHS[s])
            i += 1
        else:
            j = i
            while j < len(seq) and not seq[j] and j - i < 138:
                j += 1
            run = j - i
            if run >= 11:
                word |= (_KIND_CODES[18] | (run - 11) << 4) << n
                n += 11
            elif run >= 3:
                word |= (_KIND_CODES[17] | (run - 3) << 4) << n
                n += 7
            else:
                word |= _KIND_CODES[0] << n
                n += 4
                j = i + 1
            i = j
        tokens += 1
    if len(seq) == len(lengths):
        w.bits(0, 1)
    else:
        k = max(0, -(-((tokens - 2).bit_length() - 2) // 2))
        w.bits(1, 1)
        w.bits(k, 3)
        w.bits(tokens - 2, 2 + 2 * k)
    w.bits(word, n)


# --- pixels in lockstep ---------------------------------------------------

@dataclass
class Job:
    """Pixels to be decoded: where the bits start and by which codes."""

    data: bytes
    at: int
    width: int
    height: int
    cache_bits: int
    groups: list[list[tuple[np.ndarray, int]]]
    meta: np.ndarray | None = None  # group of each block
    meta_bits: int = 0
    pixels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))


def _hash(argb: np.ndarray, bits) -> np.ndarray:
    return (argb.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> (32 - bits)


def decode_pixels(jobs: list[Job]) -> None:
    """Sets pixels (argb numbers in scan order) and at (the bit after) of every job."""
    jobs = sorted(jobs, key=lambda j: -j.width * j.height)
    n = len(jobs)
    size = np.array([j.width * j.height for j in jobs])
    bases, total = [], 0
    for j in jobs:
        bases.append(total - (j.at >> 3))
        total += len(j.data) - (j.at >> 3)
    raw = np.frombuffer(b"".join([j.data[j.at >> 3 :] for j in jobs]) + bytes(8), np.uint8).astype(np.uint32)
    win = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    del raw
    pos = np.array([8 * b + j.at for b, j in zip(bases, jobs, strict=True)], np.int64)
    flat, offs, masks, group0 = [], [], [], []
    fill = 0
    for j in jobs:
        group0.append(len(offs))
        for g in j.groups:
            row = []
            for t, _ in g:
                row.append(fill)
                flat.append(t)
                fill += len(t)
            offs.append(row)
            masks.append([(1 << b) - 1 for _, b in g])
    table = np.concatenate(flat)
    off, mask, group0 = np.array(offs, np.int64), np.array(masks, np.int64), np.array(group0)
    plain = all(len(j.groups) == 1 for j in jobs) and bool((mask[:, 1:4] == 0).all())
    fixed = (table[off[:, 3]] >> 4).astype(np.uint32) << 24 | (table[off[:, 1]] >> 4).astype(np.uint32) << 16 | (table[off[:, 2]] >> 4).astype(np.uint32)
    cached = [k for k, j in enumerate(jobs) if j.cache_bits]
    cbits = np.array([j.cache_bits for j in jobs])
    cache = np.zeros((n, 1 << int(cbits.max(initial=0))), np.uint32) if cached else None
    out = np.zeros((int(size.max(initial=0)), n), np.uint32)
    resume = np.zeros(n, np.int64)  # the step at which a stream reads its next symbol
    held: list[tuple[int, int]] = []  # (resume, stream) of those that copy

    def take(k: np.ndarray, nbits: np.ndarray) -> np.ndarray:
        v = (win[pos[k] >> 3] >> (pos[k] & 7).astype(np.uint32)) & ((np.uint32(1) << nbits.astype(np.uint32)) - np.uint32(1))
        pos[k] += nbits
        return v.astype(np.int64)

    def symbol(k: np.ndarray, g: np.ndarray, code: int) -> np.ndarray:
        e = table[off[g, code] + ((win[pos[k] >> 3] >> (pos[k] & 7).astype(np.uint32)).astype(np.int64) & mask[g, code])]
        pos[k] += e & 15
        return (e >> 4).astype(np.int64)

    def value(k: np.ndarray, s: np.ndarray) -> np.ndarray:
        extra = np.maximum(0, (s - 2) >> 1)
        low = take(k, extra)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + low + 1)

    act, dirty, alive = np.arange(n), False, n
    goff, gmask = off[group0, 0], mask[group0, 0]
    for t in range(len(out)):
        while alive and size[alive - 1] <= t:
            alive -= 1
            dirty = True
        while held and held[0][0] <= t:
            heapq.heappop(held)
            dirty = True
        if dirty:
            act = np.flatnonzero(resume[:alive] <= t)
            aoff, amask, afix, dirty = goff[act], gmask[act], fixed[act], False
        elif t == 0:
            aoff, amask, afix = goff[act], gmask[act], fixed[act]
        if len(act):
            p = pos[act]
            bits = (win[p >> 3] >> (p & 7).astype(np.uint32)).astype(np.int64)
            if plain:
                e = table[aoff + (bits & amask)]
            else:
                g = group0[act]
                for i, k in enumerate(act.tolist()):
                    j = jobs[k]
                    if j.meta is not None:
                        y, x = divmod(t, j.width)
                        g[i] += j.meta[y >> j.meta_bits, x >> j.meta_bits]
                e = table[off[g, 0] + (bits & mask[g, 0])]
            pos[act] = p + (e & 15)
            s = e >> 4
            if plain:
                out[t, act] = s.astype(np.uint32) << 8 | afix
            else:
                lit = np.flatnonzero(s < 256)
                if len(lit):
                    k, gl = act[lit], g[lit]
                    red, blue, alpha = symbol(k, gl, 1), symbol(k, gl, 2), symbol(k, gl, 3)
                    out[t, k] = (alpha << 24 | red << 16 | s[lit].astype(np.int64) << 8 | blue).astype(np.uint32)
            if s.max() >= 256:
                far = np.flatnonzero((s >= 256) & (s < 256 + LENGTHS))
                if len(far):
                    k = act[far]
                    gf = group0[k] if plain else g[far]
                    length = value(k, s[far].astype(np.int64) - 256)
                    code = value(k, symbol(k, gf, 4))
                    for i, m, c in zip(k.tolist(), length.tolist(), code.tolist(), strict=True):
                        dist = c - 120
                        if c <= 120:
                            x, y = NEAR[c - 1]
                            dist = max(1, x + y * jobs[i].width)
                        if dist > t or t + m > size[i]:
                            raise ValueError("back-reference out of the image")
                        if dist >= m:
                            out[t : t + m, i] = out[t - dist : t - dist + m, i]
                        else:
                            out[t : t + m, i] = np.resize(out[t - dist : t, i], m)
                        resume[i] = t + m
                        if m > 1:
                            heapq.heappush(held, (t + m, i))
                            dirty = True
                hit = np.flatnonzero(s >= 256 + LENGTHS)
                if len(hit):
                    out[t, act[hit]] = cache[act[hit], s[hit].astype(np.int64) - 256 - LENGTHS]
        for k in cached:
            if t < size[k]:
                cache[k, int(_hash(out[t, k], int(cbits[k])))] = out[t, k]
    for k, (j, b) in enumerate(zip(jobs, bases, strict=True)):
        j.pixels, j.at = np.ascontiguousarray(out[: size[k], k]), int(pos[k]) - 8 * b


# --- whole images ---------------------------------------------------------

def _entropy_image(r: Reader, width: int, height: int, top: bool) -> Generator[Job, None, np.ndarray]:
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, meta_bits, count = None, 0, 1
    if top and r.bits(1):
        meta_bits = r.bits(3) + 2
        w, h = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
        got = yield from _entropy_image(r, w, h, False)
        meta = (got >> 8 & 0xFFFF).astype(np.int64).reshape(h, w)
        count = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[decode_table(read_code(r, s)) for s in sizes] for _ in range(count)]
    job = Job(r.data, r.at, width, height, cache_bits, groups, meta, meta_bits)
    yield job
    r._move(job.at)
    return job.pixels


def _image(data: bytes) -> Generator[Job, None, np.ndarray]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    r = Reader(data, 21 * 8)
    width, height, alpha, version = r.bits(14) + 1, r.bits(14) + 1, r.bits(1), r.bits(3)
    if version:
        raise ValueError("unknown version")
    todo, wide = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICT, CROSS):
            bits = r.bits(3) + 2
            w, h = (wide + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            got = yield from _entropy_image(r, w, h, False)
            todo.append((kind, wide, bits, got.reshape(h, w)))
        elif kind == GREEN:
            todo.append((kind, wide, 0, None))
        else:
            n = r.bits(8) + 1
            got = yield from _entropy_image(r, n, 1, False)
            colours = np.cumsum(got.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, wide, pack, colours))
            wide = (wide + (1 << pack) - 1) >> pack
    argb = yield from _entropy_image(r, wide, height, True)
    argb = argb.reshape(height, wide)
    for kind, w, bits, info in reversed(todo):
        argb = (unpredict, uncross, ungreen, unindex)[kind](argb, w, bits, info)
    return argb if alpha else argb | np.uint32(0xFF000000)


def decode(files: list[bytes], most: int = 6_000_000) -> list[np.ndarray]:
    """Pixels (height, width) of each file as argb numbers; so many pixels at most are decoded at once."""
    out: list[np.ndarray | None] = [None] * len(files)
    waiting: list[tuple[int, Generator, Job]] = []

    def advance(i: int, gen: Generator) -> None:
        try:
            waiting.append((i, gen, next(gen)))
        except StopIteration as e:
            out[i] = e.value

    for i, data in enumerate(files):
        advance(i, _image(data))
    while waiting:
        now, waiting = sorted(waiting, key=lambda x: -x[2].width * x[2].height), []
        while now:
            wide = max(1, now[0][2].width * now[0][2].height)
            part, now = now[: max(1, min(4000, most // wide))], now[max(1, min(4000, most // wide)) :]
            decode_pixels([j for _, _, j in part])
            for i, gen, _ in part:
                advance(i, gen)
    return out


# --- inverse transforms ---------------------------------------------------

def _bytes(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)


def ungreen(argb: np.ndarray, w: int, bits: int, info) -> np.ndarray:
    p = _bytes(argb).copy()
    p[..., 0] += p[..., 1]
    p[..., 2] += p[..., 1]
    return p.reshape(argb.shape[0], -1).view(np.uint32)


def unindex(argb: np.ndarray, w: int, pack: int, colours: np.ndarray) -> np.ndarray:
    idx = (argb >> 8 & 0xFF).astype(np.int64)
    if pack:
        per, wide = 1 << pack, 8 >> pack
        idx = (idx[:, :, None] >> (np.arange(per) * wide) & ((1 << wide) - 1)).reshape(argb.shape[0], -1)[:, :w]
    return np.concatenate([colours, np.zeros(256, np.uint32)])[idx]


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def uncross(argb: np.ndarray, w: int, bits: int, blocks: np.ndarray) -> np.ndarray:
    p = _bytes(argb).astype(np.int32)
    m = _bytes(blocks)[np.arange(argb.shape[0])[:, None] >> bits, np.arange(w)[None] >> bits]
    green = p[..., 1].astype(np.uint8)
    red = (p[..., 2] + _delta(m[..., 0], green)).astype(np.uint8)
    blue = p[..., 0] + _delta(m[..., 1], green) + _delta(m[..., 2], red)
    p[..., 2], p[..., 0] = red, blue
    return p.astype(np.uint8).reshape(argb.shape[0], -1).view(np.uint32)


def _predicted(mode: int, left, top, topright, topleft) -> np.ndarray:
    """Prediction from int32 channel arrays."""
    avg = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return topright
    if mode == 4:
        return topleft
    if mode == 5:
        return avg(avg(left, topright), top)
    if mode == 6:
        return avg(left, topleft)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(topleft, top)
    if mode == 9:
        return avg(top, topright)
    if mode == 10:
        return avg(avg(left, topleft), avg(top, topright))
    if mode == 11:
        guess = left + top - topleft
        return left if int(abs(guess - left).sum()) < int(abs(guess - top).sum()) else top
    if mode == 12:
        return np.clip(left + top - topleft, 0, 255)
    if mode == 13:
        a = avg(left, top)
        d = a - topleft
        return np.clip(a + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
    return np.array([0, 0, 0, 255], np.int32)


def _neighbours(p: np.ndarray, y: int, x: int):
    after = p[y - 1, x + 1] if x + 1 < p.shape[1] else p[y, 0]
    return p[y, x - 1], p[y - 1, x], after, p[y - 1, x - 1]


def unpredict(argb: np.ndarray, w: int, bits: int, blocks: np.ndarray) -> np.ndarray:
    res = _bytes(argb).astype(np.int32)
    p, h = np.zeros_like(res), argb.shape[0]
    modes = (blocks >> 8 & 15).astype(np.int64)[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    p[0] = np.cumsum(res[0] + np.where(np.arange(w)[:, None] == 0, np.array([0, 0, 0, 255]), 0), axis=0) & 255
    for y in range(1, h):
        p[y, 0] = (res[y, 0] + p[y - 1, 0]) & 255
        row = modes[y]
        if (row == row[0]).all() and row[0] in (0, 1, 2, 4, 8):  # no prediction needs more of this row than a sum
            m = int(row[0])
            if m == 1:
                p[y, 1:] = (np.cumsum(res[y, 1:], axis=0) + p[y, 0]) & 255
            else:
                p[y, 1:] = (res[y, 1:] + _predicted(m, None, p[y - 1, 1:], None, p[y - 1, :-1])) & 255
            continue
        for x in range(1, w):
            p[y, x] = (res[y, x] + _predicted(int(row[x]), *_neighbours(p, y, x))) & 255
    return p.astype(np.uint8).reshape(h, -1).view(np.uint32)


# --- encoder --------------------------------------------------------------

def riff(payload: bytes) -> bytes:
    chunk = b"VP8L" + len(payload).to_bytes(4, "little") + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def _head(w: Writer, width: int, height: int, alpha: int) -> None:
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(alpha, 1)
    w.bits(0, 3)


def _write_pixels(w: Writer, argb: np.ndarray, top: bool, cache_bits: int = 0, reach: int = 0, meta: tuple[int, np.ndarray] | None = None) -> None:
    """One entropy-coded image: with a colour cache if asked, copies of up to reach pixels back, and groups of codes by block."""
    flat = argb.reshape(-1).tolist()
    width = argb.shape[1]
    w.bits(cache_bits > 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if top:
        w.bits(meta is not None, 1)
        if meta is not None:
            w.bits(meta[0] - 2, 3)
            _write_pixels(w, meta[1].astype(np.uint32) << 8, False)
    group = lambda t: 0 if meta is None else int(meta[1][t // width >> meta[0], t % width >> meta[0]])
    cache, tokens, t = [0] * (1 << cache_bits), [], 0
    slot = lambda v: (v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
    near = {}
    for c, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), c + 1)
    last: dict[tuple, int] = {}
    while t < len(flat):
        length, key = 0, tuple(flat[t : t + 3])
        if reach and len(key) == 3:
            src = last.get(key, -1)
            if src >= 0 and t - src <= reach:
                while t + length < len(flat) and length < 4096 and flat[src + length] == flat[t + length]:
                    length += 1
        if length >= 3:
            dist = t - src
            tokens.append((group(t), length, near.get(dist, dist + 120)))
        elif cache_bits and cache[slot(flat[t])] == flat[t] and any(flat[:t]):
            tokens.append((group(t), 0, slot(flat[t])))
            length = 1
        else:
            tokens.append((group(t), -1, flat[t]))
            length = 1
        for k in range(t, t + length):
            if reach and k + 3 <= len(flat):
                last[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[slot(flat[k])] = flat[k]
        t += length
    count = 1 if meta is None else int(meta[1].max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    hist = [[np.zeros(s, np.int64) for s in sizes] for _ in range(count)]
    for g, kind, v in tokens:
        if kind < 0:
            for c, sh in enumerate((8, 16, 0, 24)):
                hist[g][c][v >> sh & 255] += 1
        elif kind == 0:
            hist[g][0][256 + LENGTHS + v] += 1
        else:
            hist[g][0][256 + prefix_value(kind)[0]] += 1
            hist[g][4][prefix_value(v)[0]] += 1
    lens = [[code_lengths(h, 15) for h in hs] for hs in hist]
    codes = [[encode_codes(x).tolist() for x in ls] for ls in lens]
    for ls in lens:
        for x in ls:
            write_code(w, x)
    bits = [[[0] * len(x) if np.count_nonzero(x) < 2 else x.tolist() for x in ls] for ls in lens]
    put = lambda g, c, s: w.bits(codes[g][c][s], bits[g][c][s])
    for g, kind, v in tokens:
        if kind < 0:
            for c, sh in enumerate((8, 16, 0, 24)):
                put(g, c, v >> sh & 255)
        elif kind == 0:
            put(g, 0, 256 + LENGTHS + v)
        else:
            s, n, x = prefix_value(kind)
            put(g, 0, 256 + s)
            w.bits(x, n)
            s, n, x = prefix_value(v)
            put(g, 4, s)
            w.bits(x, n)


def encode(argb: np.ndarray, steps: tuple = (), cache_bits: int = 0, reach: int = 0, meta: tuple[int, np.ndarray] | None = None) -> bytes:
    """A WebP file of an (height, width) array of argb numbers.

    steps, in order: ("predict", bits, modes by block), ("cross", bits,
    multipliers by block as argb numbers), ("green",), ("palette",).
    """
    argb = np.ascontiguousarray(argb, np.uint32)
    w = Writer()
    _head(w, argb.shape[1], argb.shape[0], int((argb >> 24 != 255).any()))
    for step in steps:
        h, wide = argb.shape
        p = _bytes(argb).astype(np.int32)
        w.bits(1, 1)
        if step[0] == "predict":
            w.bits(PREDICT, 2)
            w.bits(step[1] - 2, 3)
            _write_pixels(w, step[2].astype(np.uint32) << 8, False)
            res = np.zeros_like(p)
            for y in range(h):
                for x in range(wide):
                    m = int(step[2][y >> step[1], x >> step[1]])
                    guess = np.array([0, 0, 0, 255]) if not x and not y else p[y, x - 1] if not y else p[y - 1, x] if not x else _predicted(m, *_neighbours(p, y, x))
                    res[y, x] = p[y, x] - guess
            p = res
        elif step[0] == "cross":
            w.bits(CROSS, 2)
            w.bits(step[1] - 2, 3)
            _write_pixels(w, step[2].astype(np.uint32), False)
            m = _bytes(step[2].astype(np.uint32))[np.arange(h)[:, None] >> step[1], np.arange(wide)[None] >> step[1]]
            green, red = p[..., 1].astype(np.uint8), p[..., 2].astype(np.uint8)
            p[..., 0] -= _delta(m[..., 1], green) + _delta(m[..., 2], red)
            p[..., 2] -= _delta(m[..., 0], green)
        elif step[0] == "green":
            w.bits(GREEN, 2)
            p[..., 0] -= p[..., 1]
            p[..., 2] -= p[..., 1]
        else:
            w.bits(PALETTE, 2)
            colours, idx = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            idx = idx.reshape(argb.shape).astype(np.uint32)
            _palette(w, colours)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            argb = packed(idx, pack) << 8
            continue
        argb = (p & 255).astype(np.uint8).reshape(h, -1).view(np.uint32)
    w.bits(0, 1)
    _write_pixels(w, argb, True, cache_bits, reach, meta)
    return riff(w.bytes())


def packed(idx: np.ndarray, pack: int) -> np.ndarray:
    """2**pack palette indexes to a pixel."""
    if not pack:
        return idx
    per, wide = 1 << pack, 8 >> pack
    full = np.zeros((idx.shape[0], -(-idx.shape[1] // per) * per), np.uint32)
    full[:, : idx.shape[1]] = idx
    return (full.reshape(idx.shape[0], -1, per) << (np.arange(per, dtype=np.uint32) * wide)).sum(2, dtype=np.uint32)


def _palette(w: Writer, colours: np.ndarray) -> None:
    w.bits(len(colours) - 1, 8)
    c = _bytes(colours.astype(np.uint32))
    d = c.copy()
    d[1:] -= c[:-1]
    _write_pixels(w, d.reshape(-1).view(np.uint32).reshape(1, -1), False)


def encode_grey(samples: list[np.ndarray], width: int, pads: list[int]) -> list[bytes]:
    """WebP files of many 8-bit images of one width, samples in the green channel, by palette.

    pads: so many samples at an image's end are equal; from four on they are one
    literal and a copy of distance 1. The codes of all images are laid out with
    vector operations over their symbols.
    """
    writers, runs, syms, owner, tables, lens = [], [], [], [], [], []
    for k, (x, pad) in enumerate(zip(samples, pads, strict=True)):
        w = Writer()
        _head(w, width, len(x) // width, 0)
        w.bits(1, 1)
        w.bits(PALETTE, 2)
        seen = np.bincount(x, minlength=256)
        colours = np.flatnonzero(seen)
        to = np.zeros(256, np.uint32)
        to[colours] = np.arange(len(colours))
        w.bits(len(colours) - 1, 8)
        d = np.diff(colours, prepend=0)
        _write_row(w, d)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        idx = packed(to[x].reshape(-1, width), pack).reshape(-1)
        run = pad - 1 if pad >= 4 and not pack else 0
        s = idx[: len(idx) - run]
        hist = np.bincount(s, minlength=256 + LENGTHS)
        extra = (0, 0, 0)
        if run:
            extra = prefix_value(run)
            hist[256 + extra[0]] += 1
        n = code_lengths(hist)
        c = encode_codes(n)
        w.bits(0, 1)  # no more transforms
        w.bits(0, 1)  # no colour cache
        w.bits(0, 1)  # one group of codes
        write_code(w, n)
        for _ in range(3):
            w.bits(0b0001, 4)  # one symbol, of 1 bit: 0
        near = 1  # place (1, 0): one pixel to the left is the second near distance
        w.bits(1, 1)
        w.bits(0, 1)
        w.bits(0, 1)
        w.bits(near, 1)
        if np.count_nonzero(n) < 2:
            n = np.zeros_like(n)
        tail = Writer()
        if run:
            tail.bits(int(c[256 + extra[0]]), int(n[256 + extra[0]]))
            tail.bits(extra[2], extra[1])
        writers.append(w)
        runs.append(tail)
        syms.append(s)
        tables.append(c[:256])
        lens.append(n[:256])
        owner.append(len(s))
    count = np.array(owner)
    rows = np.repeat(np.arange(len(count)) * 256, count)
    sym = np.concatenate(syms).astype(np.int64) + rows
    code, nbits = np.concatenate(tables)[sym], np.concatenate(lens).astype(np.int64)[sym]
    total = np.concatenate([[0], np.cumsum(nbits)])
    first = np.cumsum(count) - count
    body = total[first + count] - total[first]
    head = np.array([w.n for w in writers])
    words = (head + body + np.array([r.n for r in runs]) + 63) // 64 + 1
    base = (np.cumsum(words) - words) * 64
    at = total[:-1] + np.repeat(base + head - total[first], count)
    buf = np.zeros(int(words.sum()) + 1, np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    if len(at):
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        buf[word[begin]] = np.add.reduceat(code << shift, begin)
        over = np.flatnonzero((at & 63) + nbits > 64)
        buf[word[over] + 1] |= code[over] >> (np.uint64(64) - shift[over])
    raw = buf.view(np.uint8)
    out = []
    for k, (w, r) in enumerate(zip(writers, runs, strict=True)):
        size = (int(head[k] + body[k]) + r.n + 7) // 8
        a = int(base[k]) // 8
        mine = raw[a : a + size + 8].copy()
        for put, where in ((w, 0), (r, int(head[k] + body[k]))):
            if put.n:
                b = np.frombuffer((put.word << (where & 7)).to_bytes((put.n + (where & 7) + 7) // 8, "little"), np.uint8)
                mine[where >> 3 : (where >> 3) + len(b)] |= b
        out.append(riff(mine[:size].tobytes()))
    return out


def _write_row(w: Writer, values: np.ndarray) -> None:
    """A sub-image of one row with values in the green channel and nothing else."""
    n = code_lengths(np.bincount(values, minlength=256 + LENGTHS))
    c = encode_codes(n).tolist()
    w.bits(0, 1)
    write_code(w, n)
    for _ in range(4):
        w.bits(0b0001, 4)
    bits = n.tolist() if np.count_nonzero(n) > 1 else [0] * len(n)
    word, k = 0, 0
    for v in values.tolist():
        word |= c[v] << k
        k += bits[v]
    w.bits(word, k)
