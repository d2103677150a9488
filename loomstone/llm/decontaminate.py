"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as UTF-8 bytes in lower case with every run of other ASCII
characters as one space. A benchmark item is cut into pieces of PIECE bytes,
each starting half a piece after the last; shorter items are one piece. A piece
of length m occurs in a document with e edits only if m + 1 - q (e + 1) of its
q-grams recur there on diagonals no more than e apart. So shared q-grams are
counted in bands of 2 (e + 1) diagonals, each overlapping the next by half;
bands that reach the bound are verified by an alignment of the piece within the
band's diagonals. An exact copy of PIECE bytes from anywhere in an item may hold
no whole piece, so these are found by a rolling hash and compared. Items too
short for a bound above 0 are evidence only as a whole: they are found, without
edits, where they stand between word ends. The work of a document happens where
it is read: no shuffle, one scan for the whole benchmark.

The benchmark is written once, in blocks; tasks read and index a block at a
time, and a worker keeps the index of the last few.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import store
from loomstone.llm.kernels import U64, buffers, released, rolling, slices

Q = 8
PIECE = 100
EDITS = 0.1
#: Items shorter than this after normalising have no bound above 0 at Q and EDITS: they are searched as they are, or not at all, as `least` says.
LEAST = 48
#: Bytes of benchmark texts in a block, about, and blocks whose index (some 100 bytes a byte) a worker keeps.
BLOCK_BYTES, BLOCKS_KEPT = 1 << 20, 2
#: Text bytes handled at once, and text bytes that are held while the blocks take their turns.
SLICE, HELD = 1 << 19, 32 << 20
#: Pairs of equal q-grams that are counted at once; a stretch of text that has more is halved.
PAIRS = 1 << 22
FILTER_BITS = 22

_NORM = np.arange(256, dtype=np.uint8)
_NORM[65:91] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _NORM[_b] = 32


def normalised(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normal bytes, their positions in d), made in steps of SLICE bytes."""
    out, where = [np.zeros(0, np.uint8)], [np.zeros(0, np.int32 if len(d) < 1 << 31 else np.int64)]
    for at in range(0, len(d), SLICE):
        back = 1 if at else 0  # the byte before decides on capitals and on runs of spaces
        part = d[at - back : at + SLICE]
        n = _NORM[part]
        if len(part) > 1:  # capitals of Latin-1 letters
            n[1:][(part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)] += 32
        keep = np.ones(len(part), bool)
        keep[1:] = (n[1:] != 32) | (n[:-1] != 32)
        keep[:back] = False
        i = np.flatnonzero(keep)
        out.append(n[i])
        where.append((i + (at - back)).astype(where[0].dtype))
    return np.concatenate(out), np.concatenate(where)


def grams(n: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number; fewer by Q - 1 than the bytes."""
    if len(n) < Q:
        return np.zeros(0, U64)
    one = n.astype(U64)
    two = one[:-1] | one[1:] << U64(8)
    four = two[:-2] | two[2:] << U64(16)
    return four[:-4] | four[4:] << U64(32)


def windows(n: np.ndarray, size: int = PIECE) -> np.ndarray:
    """Hash of so many bytes from each position on."""
    return rolling(n, size)


class Index:
    """The pieces of a benchmark block and their q-grams."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.ids = [i for i, _ in items]
        self.item: list[int] = []  # the place in ids, of each piece
        self.piece: list[np.ndarray] = []
        self.text: list[np.ndarray] = []
        short: dict[int, list[int]] = {}
        run, of, place = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            n, _ = normalised(np.frombuffer((text or "").encode(), np.uint8))
            n = np.frombuffer(n.tobytes().strip(), np.uint8)
            self.text.append(n)
            if len(n) < max(1, least):
                continue
            if len(n) < LEAST:
                short.setdefault(len(n), []).append(k)
                continue
            run.append(windows(n))
            of.append(np.full(len(run[-1]), k))
            place.append(np.arange(len(run[-1])))
            for a in range(0, max(1, len(n) - PIECE // 2), PIECE // 2):
                a = max(0, min(a, len(n) - PIECE))
                self.item.append(k)
                self.piece.append(n[a : a + PIECE])
        m = np.array([len(p) for p in self.piece], np.int64)
        self.size = m
        self.edits = (EDITS * m).astype(np.int64)
        self.bound = m + 1 - Q * (self.edits + 1)
        key = np.concatenate([grams(p) for p in self.piece] + [np.zeros(0, U64)])
        owner = np.repeat(np.arange(len(m)), np.maximum(0, m - Q + 1))
        at = np.arange(len(key)) - np.repeat(np.cumsum(np.maximum(0, m - Q + 1)) - np.maximum(0, m - Q + 1), np.maximum(0, m - Q + 1))
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._cell(self.key)] = True
        r = np.concatenate(run)
        order = np.argsort(r, kind="stable")
        self.run, self.run_first, self.run_count = np.unique(r[order], return_index=True, return_counts=True)
        self.run_of, self.run_place = np.concatenate(of)[order], np.concatenate(place)[order]
        self.run_filter = np.zeros(1 << FILTER_BITS, bool)
        self.run_filter[self._cell(self.run)] = True
        self.short = {}
        for size, who in short.items():
            h = np.array([windows(self.text[k], size)[0] for k in who], U64)
            order = np.argsort(h, kind="stable")
            self.short[size] = h[order], np.array(who)[order]

    @staticmethod
    def _cell(k: np.ndarray) -> np.ndarray:
        return (k * U64(0x9E3779B97F4A7C15) >> U64(64 - FILTER_BITS)).astype(np.int64)

    def hits(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in n, place in key) of every q-gram of n that a piece holds."""
        g = grams(n)
        hit = np.flatnonzero(self.filter[self._cell(g)])
        at = np.searchsorted(self.key, g[hit])
        at[at == len(self.key)] = 0
        real = self.key[at] == g[hit] if len(self.key) else np.zeros(0, bool)
        return hit[real], at[real]

    def bands(self, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, lowest diagonal) of the bands that meet the bound."""
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = self.count[at]
        idx = np.repeat(self.first[at] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
        piece, diagonal = self.owner[idx], np.repeat(hit, c) - self.place[idx] + PIECE
        step = self.edits[piece] + 1
        band = diagonal // step
        key = piece << 40 | band
        ones, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        p = ones >> 40
        good = counts >= self.bound[p]
        p, b = p[good], (ones[good] & ((1 << 40) - 1))
        return p, b * (self.edits[p] + 1) - PIECE

    def runs(self, n: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, start, end in n): what exact copies of PIECE bytes of an item span in a row."""
        h = windows(n)
        hit = np.flatnonzero(self.run_filter[self._cell(h)])
        at = np.searchsorted(self.run, h[hit])
        at[at == len(self.run)] = 0
        row = np.searchsorted(first, hit, "right") - 1
        ok = (self.run[at] == h[hit]) & (hit + PIECE <= first[np.minimum(row + 1, len(first) - 1)]) if len(self.run) else np.zeros(len(hit), bool)
        hit, at, row = hit[ok], at[ok], row[ok]
        if not len(hit):
            return []
        c = self.run_count[at]
        idx = np.repeat(self.run_first[at] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
        of, place = self.run_of[idx], self.run_place[idx]
        hit, row = np.repeat(hit, c), np.repeat(row, c)
        same = np.array([n[p : p + PIECE].tobytes() == self.text[k][q : q + PIECE].tobytes() for p, k, q in zip(hit.tolist(), of.tolist(), place.tolist(), strict=True)], bool)
        hit, row, of = hit[same], row[same], of[same]
        order = np.lexsort((hit, of, row))
        hit, row, of = hit[order], row[order], of[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (of[1:] != of[:-1])]))
        last = np.append(begin[1:], len(hit))[: len(begin)] - 1
        return list(zip(row[begin].tolist(), of[begin].tolist(), hit[begin].tolist(), (hit[last] + PIECE).tolist(), strict=True))

    def wholes(self, n: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, start, end in n) of the short items between word ends."""
        out = []
        for size, (key, who) in self.short.items():
            h = windows(n, size)
            a = np.searchsorted(key, h)
            hit = np.flatnonzero(key[np.minimum(a, len(key) - 1)] == h)
            for p in hit.tolist():
                row = int(np.searchsorted(first, p, "right")) - 1
                if p + size > first[row + 1] or (p > first[row] and n[p - 1] != 32) or (p + size < first[row + 1] and n[p + size] != 32):
                    continue
                b = int(a[p])
                while b < len(key) and key[b] == h[p]:
                    if self.text[who[b]].tobytes() == n[p : p + size].tobytes():
                        out.append((row, int(who[b]), p, p + size))
                    b += 1
        return out

    def align(self, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least edits, end in n) of each piece within 2 (e + 1) diagonals from the given one on and e on either side.

        lo, hi: the document's bounds in n; bytes outside match nothing.
        """
        best, end = np.full(len(piece), 1 << 20), np.zeros(len(piece), np.int64)
        for m in np.unique(self.size[piece]).tolist():
            mine = np.flatnonzero(self.size[piece] == m)
            for part in np.array_split(mine, max(1, len(mine) // 2000)):
                e = int(EDITS * m)
                width = 2 * (e + 1) + 2 * e
                pat = np.stack([self.piece[p] for p in piece[part]])
                start = diagonal[part] - e
                pos = start[:, None] + np.arange(width + m)
                text = np.where((pos >= lo[part][:, None]) & (pos < hi[part][:, None]), n[np.clip(pos, 0, len(n) - 1)], 0)
                ramp = np.arange(width, dtype=np.int32)
                d = np.zeros((len(part), width), np.int32)
                for i in range(m):  # row i of the table, by diagonals
                    new = d + (text[:, i : i + width] != pat[:, i : i + 1])
                    new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
                    d = np.minimum.accumulate(new - ramp, axis=1) + ramp
                best[part] = d.min(1)
                end[part] = start + m + d.argmin(1)
        return best, end

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, pieces, edits of the best piece, start, end): regions of a row's bytes that hold pieces of an item.

        A row of any length is normalised in steps and searched in stretches,
        each wider than the last one's end by what a piece and its band span.
        """
        base = offs[0]
        n, at = normalised(data[base : offs[-1]])
        first = np.searchsorted(at, offs - base)
        found: dict[tuple[int, int], list[int]] = {}
        pieces: dict[tuple[int, int], set[int]] = {}

        def add(row: int, item: int, edits: int, lo: int, hi: int, piece: int) -> None:
            was = found.setdefault((row, item), [edits, lo, hi])
            found[row, item] = [min(was[0], edits), min(was[1], lo), max(was[2], hi)]
            pieces.setdefault((row, item), set()).add(piece)

        todo = [(a, min(a + SLICE, len(n))) for a in range(0, len(n), SLICE)][::-1]
        while todo:
            a, b = todo.pop()
            lo, hi = max(0, a - 2 * PIECE), min(len(n), b + 2 * PIECE)
            part, inside = n[lo:hi], np.clip(first - lo, 0, hi - lo)
            hit, key = self.hits(part)
            if b - a > 8 * PIECE and int(self.count[key].sum()) > PAIRS:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                continue
            for row, p, edits, x, y in self.aligned(part, inside, hit, key):
                add(row, self.item[p], edits, lo + x, lo + y, p)
            for row, k, x, y in self.runs(part, inside):
                add(row, k, 0, lo + x, lo + y, -1)
            # A short item at the edge of a stretch is seen whole, with its neighbours, in this one or the next.
            for row, k, x, y in self.wholes(part, inside):
                x, y = lo + x, lo + y
                if (x == first[row] or n[x - 1] == 32) and (y == first[row + 1] or n[y] == 32):
                    add(row, k, 0, x, y, -1)
        out = []
        for (r, k), (edits, x, y) in sorted(found.items()):
            start = offs[r] - base
            out.append((r, self.ids[k], max(1, len(pieces[r, k] - {-1})), edits, int(at[x] - start), int(at[max(y - 1, x)] - start) + 1))
        return out

    def aligned(self, n: np.ndarray, first: np.ndarray, hit: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, piece, edits, start, end in n) of the pieces that a band holds."""
        piece, diagonal = self.bands(hit, key)
        # A band lies in the documents that its middle window meets; two where it crosses a boundary.
        size = self.size[piece]
        e = self.edits[piece]
        a = np.searchsorted(first, np.clip(diagonal - e, 0, len(n) - 1), "right") - 1
        b = np.searchsorted(first, np.clip(diagonal + 3 * e + 2 + size, 0, len(n) - 1), "right") - 1
        b = np.minimum(b, len(first) - 2)
        k = np.maximum(b - a + 1, 0)
        which = np.repeat(np.arange(len(piece)), k)
        row = np.repeat(a - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
        room = first[row + 1] - first[row] >= size[which] - e[which]
        which, row = which[room], row[room]
        edits, end = self.align(n, first[row], first[row + 1], piece[which], diagonal[which])
        for i in np.flatnonzero(edits <= e[which]).tolist():
            r = int(row[i])
            hi = int(min(end[i], first[r + 1]))
            yield r, int(piece[which[i]]), int(edits[i]), int(max(end[i] - size[which[i]], first[r])), hi


# --- Spark ----------------------------------------------------------------

def blocks(benchmark: DataFrame) -> tuple[str, list[str]]:
    """The folder and names of files that hold the items, each of about BLOCK_BYTES; only names come to the driver."""
    spark = benchmark.sparkSession
    folder = store.fresh(spark, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store.open_fs(folder)
        files.create_dir(base, recursive=True)

        def put(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_string())})
            with files.open_output_stream(f"{base}/{name}") as f, pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
            return pa.RecordBatch.from_pydict({"path": pa.array([name])})

        held: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((item, text))
                size += len(text) * 4
                if size >= BLOCK_BYTES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").coalesce(store.partitions(spark))
    made = store.written(rows.mapInArrow(write, "path string"), "benchmark-blocks")
    return folder, sorted(r["path"] for r in made.collect())  # a name for each BLOCK_BYTES and partition


_kept: OrderedDict[str, Index] = OrderedDict()


def indexed(folder: str, name: str, least: int) -> Index:
    """The index of a block, from the worker's last few or built anew."""
    got = _kept.pop(f"{name} {least}", None)
    if got is None:
        while len(_kept) >= BLOCKS_KEPT:
            _kept.popitem(last=False)
        files, base = store.open_fs(folder)
        with files.open_input_file(f"{base}/{name}") as f:
            table = pa.ipc.open_file(f).read_all()
        got = Index(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), least)
    _kept[f"{name} {least}"] = got
    return got


def searched(texts: Iterator[tuple[object, pa.Array]], folder: str, names: list[str], least: int) -> Iterator[tuple[object, list[tuple[int, int, int, int, int, int]]]]:
    """(given, finds in the given texts) in the order given; each block is loaded once for about HELD bytes of texts."""
    group: list[tuple[object, pa.Array]] = []
    held = 0

    def turn():
        got: list[list] = [[] for _ in group]
        for name in sorted(names, key=lambda name: f"{name} {least}" not in _kept):  # begin with what is at hand
            index = indexed(folder, name, least)
            for out, (_, col) in zip(got, group, strict=True):
                data, offs = buffers(col)
                for lo, hi in slices(offs, SLICE):
                    out += [(lo + g[0], *g[1:]) for g in index.search(data, offs[lo : hi + 1])]
        yield from zip((g[0] for g in group), got, strict=True)

    for given, col in texts:
        group.append((given, col))
        held += col.nbytes
        if held >= HELD or len(names) <= BLOCKS_KEPT:
            yield from turn()
            group, held = [], 0
    yield from turn()


FOUND = "doc_id long, item_id long, pieces int, edits int, start long, end long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each document and item of which the document holds a piece: pieces, least edits, and the byte range of the text that they span.

    Items shorter than `least` normalised bytes are taken as no evidence; the
    queries pass 1, so that every item is searched. An exact copy of PIECE bytes
    that holds no whole piece counts as one. Null and empty texts hold nothing; items without text, or without a letter or
    digit in it, are not searched, and without an id not reported; rows that
    repeat give repeated rows, and so do items that share an id or a text. There
    are no ties: every region is reported, as the span of all pieces. A text of
    any length is searched in stretches. An empty benchmark or table gives no
    rows; other columns are not read.
    """
    folder, paths = blocks(benchmark.where("item_id is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, got in searched(((b.column("doc_id"), b.column("text")) for b in batches), folder, paths, least):
            cols = list(zip(*((ids[g[0]].as_py(), *g[1:]) for g in sorted(got)), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "pieces", "edits", "start", "end"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, all columns, without the rows that hold a piece of an item (see contaminated); an item without an id counts too.

    Null and empty texts stay. Only the texts go through Python, and only a
    flag comes back.
    """
    folder, paths = blocks(benchmark)

    @F.arrow_udf("boolean")
    def holds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(cols):
            for n, got in searched(((len(c), c) for c in cols), folder, paths, least):
                out = np.zeros(n, bool)
                out[[g[0] for g in got]] = True
                yield pa.array(out)

        return released(run)(texts)

    return docs.where(~holds(F.col("text")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"), least=1)
