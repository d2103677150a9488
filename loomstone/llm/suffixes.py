"""Suffix-array dedup: bytes covered by a 50-byte string that a document of smaller id holds too.

Strings meet by content. Of the 31 20-grams of each 50-byte window the one of
smallest hash is the window's anchor, so equal windows have equal anchors, and a
run of windows with one anchor is a segment. Anchors that two documents hold
are found by hash (only they can matter); the segments of those anchors are
dealt out by anchor. There a suffix array of the segments is built by two-stage
sorting: only suffixes smaller than their successors are sorted directly, the
rest are induced by scanning the buckets of first bytes. The common prefixes of
adjacent suffixes are computed; suffixes with 50 bytes in common form classes,
and every window of a class is repeated in all documents of the class but the
smallest.

Texts that are equal as a whole are settled first, by digest; segments that are
equal within one slice of rows or one bucket are settled by their smallest id,
so no frequent passage gathers all its places in one task. Segments meet by a
hash and are then compared; should two differ under one hash, the task fails
rather than take one for the other.

Entries of a slice are packed by bucket, as arrays with offsets: the work
follows the entries, however many buckets there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import store
from loomstone.llm.kernels import BYTE_HASH, U64, buffers, byte_windows, eights, hash_ranges, mix64, powers, prefix_hash, released, slices
from loomstone.llm.sieve import sifted

SPAN, GRAM = 50, 20
WINDOW = SPAN - GRAM + 1
#: Anchors of a bucket, and segment bytes of a bucket, about.
BUCKET_ANCHORS, BUCKET_BYTES = 800_000, 1_500_000
DEPTH, SYMBOLS = 8, 7
#: Text bytes handled at once; equal anchors and segments inside are settled there.
SLICE = 2 << 20
#: Tasks that the copies of one text are dealt to.
COPY_WAYS = 16


# --- suffix array ---------------------------------------------------------

def suffix_array(t: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """Positions of t (numbers below 512) in the order of the suffixes' first DEPTH * SYMBOLS - 1 symbols at least.

    A suffix that is larger than its successor is induced: its place follows
    from its first symbol and the successor's place. asked: a mask of the
    positions to order, if not all; those that they are induced from come too.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    # Type: does the suffix exceed its successor? Runs of one symbol share the type of their end.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[:-1].astype(np.int32) - t[1:].astype(np.int32))
    step[-1] = 1  # the end of the text is smaller than anything
    where = np.where(step != 0, np.arange(n), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    larger = step[where] > 0
    need = np.ones(n, bool)
    if asked is not None:
        # From each asked suffix on up to the next that is sorted directly.
        stop = np.where(larger, n - 1, np.arange(n))
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        edge = np.zeros(n + 1, np.int32)
        last = np.flatnonzero(asked & ~np.append(asked[1:], False))
        np.add.at(edge, last, 1)
        np.add.at(edge, stop[last] + 1, -1)
        need = asked | (np.cumsum(edge[:-1]) > 0)
    small = np.flatnonzero(~larger & need)
    order = _direct(t, small)
    # Buckets by first symbol: induced suffixes before directly sorted ones.
    first = t[order]
    cut = np.searchsorted(first, np.arange(514))
    waiting: list[list[np.ndarray]] = [[] for _ in range(513)]
    if need[-1]:
        waiting[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in np.unique(t).tolist():
        part = np.concatenate([*waiting[c], np.zeros(0, np.int64)]).astype(np.int64)
        induced, last = [part], part
        while len(last):  # a run of c: each is induced by the next
            p = last[last > 0] - 1
            last = p[(t[p] == c) & need[p]]
            induced.append(last)
        done = np.concatenate([*induced, order[cut[c] : cut[c + 1]]])
        out.append(done)
        waiting[c] = []
        p = done[done > 0] - 1
        s = t[p]
        up = (s > c) & need[p]
        p, s = p[up], s[up]
        if len(p):
            by = np.argsort(s, kind="stable")
            p, s = p[by], s[by]
            ends = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]])) + 1
            a = 0
            for e in ends.tolist():
                waiting[int(s[a])].append(p[a:e])
                a = e
    return np.concatenate(out)


def _direct(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """at, ordered by the DEPTH * SYMBOLS symbols from each position on."""
    wide = np.concatenate([t.astype(U64), np.zeros(DEPTH * SYMBOLS + 1, U64)])
    n = len(t) + (DEPTH - 1) * SYMBOLS + 1
    key = np.zeros(n, U64)
    for j in range(SYMBOLS):
        key = key << U64(9) | wide[j : j + n]
    k = key[at]
    by = np.argsort(k)
    at, k = at[by], k[by]
    tied = np.concatenate([[False], k[1:] == k[:-1]])
    for depth in range(1, DEPTH):
        # Members of groups of equal prefixes, each with its group's first place.
        grouped = tied | np.concatenate([tied[1:], [False]])
        idx = np.flatnonzero(grouped)
        if not len(idx):
            break
        group = np.cumsum(~tied)[idx]
        more = key[at[idx] + depth * SYMBOLS]
        by = np.lexsort((more, group))
        at[idx] = at[idx][by]
        more, group = more[by], group[by]
        tied[idx] = np.concatenate([[False], (more[1:] == more[:-1]) & (group[1:] == group[:-1])])
    return at


def repeats(text: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position of text, whether it starts a SPAN-byte string inside its segment that a segment of smaller owner holds."""
    n = len(start)
    t = np.zeros(len(text) + n, np.uint16)  # a 0 closes each segment
    new = start + np.arange(n)
    place = np.repeat(new - start, size) + np.arange(len(text))
    t[place] = text.astype(np.uint16) + 1
    whole = np.zeros(len(t), bool)
    left = np.repeat(start + size, size) - np.arange(len(text))
    whole[place[left >= SPAN]] = True
    sa = suffix_array(t, whole)
    sa = sa[whole[sa]]
    back = np.zeros(len(t), np.int64)
    back[place] = np.arange(len(text))
    at = back[sa]  # positions in text, in suffix order
    out = np.zeros(len(text), bool)
    if not len(at):
        return out
    begin = np.flatnonzero(np.concatenate([[True], common_prefixes(text, at) < SPAN]))
    own = np.repeat(owner, size)[at]
    least = np.minimum.reduceat(own, begin)
    out[at] = own > np.repeat(least, np.diff(np.append(begin, len(at))))
    return out


def common_prefixes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes in common of the texts at neighbouring places, SPAN at most; SPAN bytes follow each place."""
    out, on = np.zeros(len(at) - 1, np.int64), np.ones(len(at) - 1, bool)
    lane = eights(text)
    for j in range(0, SPAN, 8):
        e = lane[at + j]
        apart = e[1:] ^ e[:-1]
        if SPAN - j < 8:
            apart &= U64((1 << 8 * (SPAN - j)) - 1)
        low = apart & (~apart + U64(1))  # the lowest bit that differs tells the byte
        n = np.where(apart == 0, min(8, SPAN - j), np.bitwise_count(low - U64(1)).astype(np.int64) // 8)
        out += np.where(on, n, 0)
        on &= apart == 0
    return out


# --- anchors --------------------------------------------------------------

class Runs:
    """Runs of windows with one anchor: p1, p2 (first and last window), row, hash of the anchor."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = d = data[offs[0] : offs[-1]]
        self.offs = o = offs - offs[0]
        self.c = prefix_hash(d, BYTE_HASH)
        n = len(d) - SPAN + 1
        none = np.zeros(0, np.int64)
        self.p1 = self.p2 = self.row = none
        self.hash = np.zeros(0, U64)
        if n <= 0:
            return
        inverse = powers(len(self.c))[1]
        h = mix64((self.c[GRAM:] - self.c[:-GRAM]) * inverse[: len(d) - GRAM + 1])
        v = h & ~U64(0xFFFFFFFF) | np.arange(len(h), dtype=U64)
        wide = 1
        while 2 * wide <= WINDOW:
            v = np.minimum(v[:-wide], v[wide:])
            wide *= 2
        rest = WINDOW - wide
        v = np.minimum(v[: len(v) - rest], v[rest:]) if rest else v
        v = v[:n]
        ok = np.zeros(n + 1, np.int32)  # windows inside one row
        size = np.diff(o)
        long = np.flatnonzero(size >= SPAN)
        np.add.at(ok, o[long], 1)
        np.add.at(ok, o[long + 1] - SPAN + 1, -1)
        ok = np.cumsum(ok[:-1]) > 0
        cut = np.ones(n, bool)
        cut[1:] = (v[1:] != v[:-1]) | ~ok[:-1]
        cut[o[long]] = True
        self.p1 = np.flatnonzero(cut & ok)
        stop = np.ones(n, bool)
        stop[:-1] = cut[1:] | ~ok[1:]
        self.p2 = np.flatnonzero(stop & ok)
        self.row = np.searchsorted(o, self.p1, "right") - 1
        self.hash = h[(v[self.p1] & U64(0xFFFFFFFF)).astype(np.int64)]

    def keep(self, mask: np.ndarray) -> None:
        self.p1, self.p2, self.row, self.hash = self.p1[mask], self.p2[mask], self.row[mask], self.hash[mask]


def _cells(buckets: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket and then by the others, the buckets that occur, their first places and the end)."""
    order = np.lexsort((*then[::-1], buckets))
    which, first = np.unique(buckets[order], return_index=True)
    return order, which, np.append(first, len(order))


def _packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """values[cut[i]:cut[i + 1]] as the bytes of row i."""
    raw = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * values.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _stretches(offs: np.ndarray):
    """(first row, end row, bounds of their bytes, bytes of the row before them): rows by slices, a long row in overlapping parts."""
    for lo, hi in slices(offs, SLICE):
        if hi - lo == 1 and offs[hi] - offs[lo] > SLICE:
            for a, b in byte_windows(int(offs[lo]), int(offs[hi]), SLICE, SPAN - 1):
                yield lo, hi, np.array([a, b]), a - int(offs[lo])
        else:
            yield lo, hi, offs[lo : hi + 1], 0


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Are data[a:a + n] and data[b:b + n] the same for all?"""
    lane = eights(data)
    for j in range(0, int(n.max(initial=0)), 8):
        on = n > j
        apart = lane[a[on] + j] ^ lane[b[on] + j]
        left = np.minimum(n[on] - j, 8).astype(U64)
        if (apart << ((U64(8) - left) * U64(8))).any():
            return False
    return True


# --- Spark ----------------------------------------------------------------

KEYS = ["doc_id", "key"]


def shared_anchors(base: DataFrame, buckets: int) -> DataFrame:
    """doc_id, key, hashes: the anchors of each text that another text holds too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy() for c in KEYS)
            for lo, hi, bounds, _ in _stretches(offs):
                r = Runs(data, bounds)
                own = np.lexsort((ids[lo:hi], keys[lo:hi]))  # of equal texts the smallest id speaks
                k = keys[lo:hi][own]
                first = np.zeros(hi - lo, bool)
                first[own[np.concatenate([[True], k[1:] != k[:-1]])]] = True
                r.keep(first[r.row])
                order = np.lexsort((ids[lo:hi][r.row], r.hash))
                h, row = r.hash[order], r.row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                if not len(h):
                    continue
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                begin = np.flatnonzero(head)
                size = np.diff(np.append(begin, len(h)))
                many = np.repeat(size > 1, size)
                # An anchor of several rows here is shared for certain; its first row alone goes on to meet other slices,
                # with word of the others: a slice that holds but a copy of that row must learn of them.
                if many.any():
                    got = (h[many], ids[lo:hi][row[many]], keys[lo:hi][row[many]])
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(_packed(x, np.array([0, len(x)])) for x in got), pa.array([b""], pa.binary())], names)
                h, row, more = h[head], row[head], (size > 1).astype(np.uint8)
                by, which, cut = _cells((h % U64(buckets)).astype(np.int32), row)
                got = (h[by], ids[lo:hi][row[by]], keys[lo:hi][row[by]], more[by])
                yield pa.RecordBatch.from_arrays([pa.array(which), *(_packed(x, cut) for x in got)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (h, d, k, more) in _gathered(batches, (U64, np.int64, np.int64, np.uint8)):
            if b >= 0:
                order = np.argsort(h, kind="stable")
                h, d, k, more = h[order], d[order], k[order], more[order]
                begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
                size = np.diff(np.append(begin, len(h)))
                lowest, highest = np.minimum.reduceat(k, begin), np.maximum.reduceat(k, begin)
                s = np.repeat((size > 1) & ((lowest != highest) | (np.maximum.reduceat(more, begin) > 0)), size)
                h, d, k = h[s], d[s], k[s]
            yield from _parted(buckets, d, k, h)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (d, k, h) in _gathered(batches, (np.int64, np.int64, U64)):
            order, begin, ends = _by_text(d, k)
            raw = h[order].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(d[order][begin]), pa.array(k[order][begin]), pa.array([raw[8 * x : 8 * y] for x, y in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary())], [*KEYS, "hashes"])

    names = ["bucket", "h", "d", "k", "more"]
    rows = base.mapInArrow(released(emit), "bucket int, h binary, d binary, k binary, more binary")
    return _per_text(rows, meet, "h", gather, "doc_id long, key long, hashes binary")


def _parted(parts: int, d: np.ndarray, k: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Values of texts (d, k) packed into a row for each part of the texts, so that rows don't multiply with buckets."""
    if not len(d):
        return
    order, which, cut = _cells((mix64(d.view(U64) ^ mix64(k.view(U64))) % U64(parts)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(which), *(_packed(x[order], cut) for x in (d, k, *more))], ["part", "d", "k", *"xy"[: len(more)]])


def _by_text(d: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by text, first and last-plus-one place of each text in that order)."""
    order = np.lexsort((k, d))
    d, k = d[order], k[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    return order, begin, np.append(begin[1:], len(d))[: len(begin)]


def _per_text(rows: DataFrame, meet, more: str, gather, schema: str) -> DataFrame:
    """Rows by bucket, met in their buckets, then gathered to a row per text."""
    n = store.partitions(rows.sparkSession)
    packed = "part int, d binary, k binary" + "".join(f", {c} binary" for c in "xy"[: len(more)])
    met = rows.where("bucket >= 0").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(meet), packed)
    local = rows.where("bucket < 0").mapInArrow(released(meet), packed)
    return met.unionByName(local).repartition(n, "part").sortWithinPartitions("part").mapInArrow(released(gather), schema)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, joined arrays) of rows that are sorted by bucket; local rows (-1) one by one."""
    held: list[list[bytes]] = [[] for _ in kinds]
    now = None

    def joined():
        return now, [np.frombuffer(b"".join(x), k) for x, k in zip(held, kinds, strict=True)]

    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cols = [buffers(c) for c in batch.columns[1:]]
        # The rows of a bucket stand together, and so do their bytes.
        cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), (bucket[1:] != bucket[:-1]) | (bucket[1:] < 0)]))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
            b = int(bucket[a])
            if now is not None and (b != now or b < 0):
                yield joined()
                held = [[] for _ in kinds]
            now = b
            for x, (data, offs) in zip(held, cols, strict=True):
                x.append(data[offs[a] : offs[z]].tobytes())
    if now is not None:
        yield joined()


def repeated_runs(candidates: DataFrame, buckets: int) -> DataFrame:
    """doc_id, key, spans (int64 pairs start, end): stretches of the texts that smaller ids hold too.

    candidates: doc_id, key, text, hashes (the text's shared anchors).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy() for c in KEYS)
            hashes = batch.column("hashes")
            for lo, hi, bounds, before in _stretches(offs):
                r = Runs(data, bounds)
                mask = np.zeros(len(r.p1), bool)
                cut = np.searchsorted(r.row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if cut[i] < cut[i + 1]:
                        mine = np.frombuffer(hashes[lo + i].as_py(), U64)
                        mask[cut[i] : cut[i + 1]] = np.isin(r.hash[cut[i] : cut[i + 1]], mine)
                r.keep(mask)
                if not len(r.p1):
                    continue
                end = r.p2 + SPAN
                seg = hash_ranges(r.data, r.p1, end)
                doc, key, rel = ids[lo:hi][r.row], keys[lo:hi][r.row], r.offs[r.row] - before
                order = np.lexsort((doc, seg))
                s, d = seg[order], doc[order]
                begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                size = np.diff(np.append(begin, len(s)))
                one = np.repeat(order[begin], size)
                n = end - r.p1
                if (n[order] != n[one]).any() or not _same_bytes(r.data, r.p1[order], r.p1[one], n[order]):
                    raise ValueError("two segments of one hash")
                # A segment that a smaller id of this slice holds is repeated as a whole; the others meet elsewhere.
                gone = np.zeros(len(seg), bool)
                gone[order] = d > np.repeat(d[begin], size)
                if gone.any():
                    i = np.flatnonzero(gone)
                    got = {"doc": doc[i], "k": key[i], "lo": r.p1[i] - rel[i], "hi": end[i] - rel[i]}
                    cols = [_packed(got[c], np.array([0, len(i)])) if c in got else pa.array([b""], pa.binary()) for c in names[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *cols], names)
                i = np.flatnonzero(~gone)
                by, which, cut = _cells((r.hash[i] % U64(buckets)).astype(np.int32), seg[i])
                j = i[by]
                head = np.ones(len(j), bool)  # the first place of each segment, whose text goes along
                head[1:] = seg[j[1:]] != seg[j[:-1]]
                head[cut[:-1]] = True
                first = j[head]
                m = n[first]
                text = r.data[np.repeat(r.p1[first] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
                ends = np.concatenate([[0], np.cumsum(head)])[cut]  # segments before each bucket
                chars = np.concatenate([[0], np.cumsum(m)])[ends]
                cols = [_packed(seg[first], ends), _packed(m, ends), _packed(text, chars), *(_packed(x, cut) for x in (doc[j], key[j], r.p1[j] - rel[j], end[j] - rel[j], seg[j]))]
                yield pa.RecordBatch.from_arrays([pa.array(which), *cols], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (u, n, text, doc, key, lo, hi, seg) in _gathered(batches, (U64, np.int64, np.uint8, np.int64, np.int64, np.int64, np.int64, U64)):
            if b < 0:
                yield from _parted(buckets, doc, key, lo, hi)
                continue
            start = np.cumsum(n) - n
            u, one, back = np.unique(u, return_index=True, return_inverse=True)
            if (n != n[one][back]).any() or not _same_bytes(text, start, start[one][back], n):
                raise ValueError("two segments of one hash")
            n, start = n[one], start[one]
            text = text[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            start = np.cumsum(n) - n
            which = np.searchsorted(u, seg)
            owner = np.full(len(u), np.iinfo(np.int64).max)
            np.minimum.at(owner, which, doc)
            hit = repeats(text, start, n, owner)
            whole = doc > owner[which]
            spans = [(doc[whole], key[whole], lo[whole], hi[whole])]
            # Runs of repeated windows of a segment, for the places of its owner.
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            a, z = edge[::2], edge[1::2]
            if len(a):
                of = np.searchsorted(start, a, "right") - 1
                mine = np.flatnonzero(~whole)
                order = mine[np.argsort(which[mine], kind="stable")]
                first = np.searchsorted(which[order], of)
                count = np.searchsorted(which[order], of, "right") - first
                rep = np.repeat(np.arange(len(a)), count)
                place = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
                at = lo[place] - start[of[rep]]
                spans.append((doc[place], key[place], at + a[rep], at + z[rep] + SPAN - 1))
            yield from _parted(buckets, *(np.concatenate(x) for x in zip(*spans, strict=True)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (d, k, lo, hi) in _gathered(batches, (np.int64,) * 4):
            order, begin, ends = _by_text(d, k)
            pairs = np.stack([lo[order], hi[order]], 1)
            blobs = [merged(pairs[x:y]).tobytes() for x, y in zip(begin.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d[order][begin]), pa.array(k[order][begin]), pa.array(blobs, pa.binary())], [*KEYS, "spans"])

    names = ["bucket", "u", "n", "text", "doc", "k", "lo", "hi", "seg"]
    rows = candidates.mapInArrow(released(emit), "bucket int, u binary, n binary, text binary, doc binary, k binary, lo binary, hi binary, seg binary")
    return _per_text(rows, meet, "xy", gather, "doc_id long, key long, spans binary")


def merged(pairs: np.ndarray) -> np.ndarray:
    """Maximal stretches of a list of (start, end)."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    begin = np.flatnonzero(head)
    return np.stack([pairs[begin, 0], reach[np.append(begin[1:], len(pairs)) - 1]], 1)


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is an empty one. Rows that share an id count as one document:
    none takes from the other, and only rows of smaller ids take from them. A
    row with a null id keeps all its bytes and takes from none. Texts shorter
    than SPAN bytes are never touched, and texts of any length are read in parts.
    Ties cannot arise. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    long = base.where(F.col("doc_id").isNotNull() & (size >= SPAN))
    digest = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("sha"), F.octet_length(text).cast("long").alias("n")).where(F.col("n") >= SPAN)
    digest = store.written(digest, "text-digests")
    total = digest.agg(F.sum("n")).first()[0] or 0
    lead = digest.groupBy("sha").agg(F.min("doc_id").alias("lead"), F.count("*").alias("c")).where("c > 1").select("sha", "lead")
    way = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_WAYS))
    lead = lead.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_WAYS - 1).cast("long"))))
    copies = store.written(digest.withColumn("way", way).join(lead, ["sha", "way"]).where("doc_id > lead").select("doc_id", "key").distinct(), "text-copies")
    parts = store.partitions(docs.sparkSession)
    anchors = shared_anchors(long, max(parts, int(total * 2 / (WINDOW + 1) / BUCKET_ANCHORS)))
    wanted = store.written(anchors, "text-anchors")
    found = repeated_runs(long.join(copies, KEYS, "left_anti").join(wanted, KEYS).select("doc_id", "key", "text", "hashes"), max(parts, int(total / BUCKET_BYTES)))
    spans = store.written(found, "text-spans").unionByName(copies.select(*KEYS, F.lit(None).cast("binary").alias("spans")))
    whole = base.select("doc_id", "key", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    clean = whole.join(spans, KEYS, "left_anti").drop("key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            out = []
            for i, (d, blob) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                x = data[offs[i] : offs[i + 1]]
                pairs = np.array([[0, len(x)]]) if blob is None else np.frombuffer(blob, np.int64).reshape(-1, 2)
                keep = hashlib.sha256()
                at = 0
                for a, b in pairs.tolist():
                    keep.update(x[at:a])
                    at = b
                keep.update(x[at:])
                out.append((d, len(x), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), keep.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], [x.split()[0] for x in DONE.split(", ")])

    hit = sifted(base, spans).join(spans, KEYS).select("doc_id", "text", "spans")
    return clean.unionByName(hit.mapInArrow(released(cut), DONE))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(store.table(spark, sf_dir, "documents"))
