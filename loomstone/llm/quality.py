"""Quality classifier: naive Bayes support vectors over hashed n-grams.

Features are indicators: words and word pairs in lower case; shapes of one to
three words (runs of upper case, lower case, digits, each other character); and
patterns of four flags that say whether a word equals the one before. Each
indicator is scaled by its log-count ratio between the classes, then a linear
model is fitted on the scaled indicators with the hinge loss by dual coordinate
descent. A logistic curve through margins of held-back folds turns margins into
scores.

The fit reads at most FIT_ROWS labelled documents, those with the smallest hash
of their id, one row of each, and of these no more than FIT_FEATURES indicators,
and so stays of bounded size on the driver; scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import store
from loomstone.llm.kernels import SLICE_BYTES, U64, Words, buffers, hash_ranges, mix64, released, slices, word_windows

FIT_ROWS, FIT_FEATURES = 4000, 1 << 24
DIM = 1 << 18
MIN_DOCS = 3
ALPHA, COST, EPOCHS, BLEND = 1.0, 1.0, 12, 0.9

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48
_SALT = [U64((k * 0xA24BAED4963EE407) % 2**64) for k in range(1, 8)]


def shapes(w: Words) -> np.ndarray:
    """Hash of each word's character classes, runs counting once."""
    if not len(w.start):
        return np.zeros(0, U64)
    kind = _CLASS[w.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.start] = True
    at = np.flatnonzero(keep)
    return hash_ranges(kind[at], np.searchsorted(at, w.start), np.searchsorted(at, w.end))


def features(data: np.ndarray, offs: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """Distinct row * DIM + feature, sorted; a single row of more than `most` bytes is read in stretches."""
    if len(offs) == 2 and offs[1] - offs[0] > most:
        out = np.zeros(0, np.int64)
        for k, (a, b) in enumerate(word_windows(data, int(offs[0]), int(offs[1]), most, 4)):
            out = np.union1d(out, _features(data, np.array([a, b]), k > 0))
        return out
    return _features(data, offs, False)


def _features(data: np.ndarray, offs: np.ndarray, goes_on: bool) -> np.ndarray:
    """goes_on: the first word stands behind others, so whether it repeats one is told in the stretch before."""
    w = Words(data, offs)
    h, s, row = w.hashes(), shapes(w), w.rows()
    if not len(h):
        return np.zeros(0, np.int64)
    same = np.ones(len(h), bool)  # the next word is of the same row
    same[:-1] = row[1:] == row[:-1]
    same[-1] = False
    pair = same[:-1]
    triple = pair[:-1] & pair[1:]
    again = np.zeros(len(h), U64)
    again[1:] = (h[1:] == h[:-1]) & pair
    four = triple[:-1] & pair[2:] if len(h) > 3 else np.zeros(0, bool)
    if goes_on and len(four):
        four[0] = False
    parts = [
        (h ^ _SALT[0], row),
        ((h[:-1] * U64(3) + h[1:] ^ _SALT[1])[pair], row[:-1][pair]),
        (s ^ _SALT[2], row),
        ((s[:-1] * U64(3) + s[1:] ^ _SALT[3])[pair], row[:-1][pair]),
        ((s[:-2] * U64(9) + s[1:-1] * U64(3) + s[2:] ^ _SALT[4])[triple], row[:-2][triple]),
    ]
    if len(four):
        parts.append(((again[:-3] * U64(8) + again[1:-2] * U64(4) + again[2:-1] * U64(2) + again[3:] ^ _SALT[5])[four], row[:-3][four]))
    return np.unique(np.concatenate([r * DIM + (mix64(f) % U64(DIM)).astype(np.int64) for f, r in parts]))


class Model:
    """Weights of the features, a bias, and the logistic curve's slope and offset."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, offset: float):
        self.weight, self.bias, self.slope, self.offset = weight, bias, slope, offset

    def margins(self, keys: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(keys // DIM, self.weight[keys % DIM], minlength=rows) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def nb_svm(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias; y is 1 or -1, and both occur."""
    flat = np.concatenate([*rows, np.zeros(0, np.int64)])
    label = np.repeat(y, [len(r) for r in rows])
    p, q = (np.bincount(flat[label == k], minlength=DIM) for k in (1, -1))
    ratio = np.log((p + ALPHA) / (p.sum() + ALPHA * DIM)) - np.log((q + ALPHA) / (q.sum() + ALPHA * DIM))
    ratio[p + q < MIN_DOCS] = 0
    scale = float(np.sqrt(np.mean([max(1e-9, np.square(ratio[r]).sum()) for r in rows])))
    ratio /= max(scale, 1e-9)
    # Hinge loss by dual coordinate descent; the bias is a feature that is always on.
    used = [r[ratio[r] != 0] for r in rows]
    x = [ratio[r] for r in used]
    norm = np.array([v @ v for v in x]) + 1
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # both classes weigh the same
    w, b, a = np.zeros(DIM), 0.0, np.zeros(len(y))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            grad = y[i] * (w[used[i]] @ x[i] + b) - 1
            new = min(max(a[i] - grad / norm[i], 0.0), cost[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[used[i]] += step * x[i]
                b += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    flatten = np.abs(w).mean() * np.sign(w)
    return ((1 - BLEND) * flatten + BLEND * w) * ratio, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to label shares, with the usual softened targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        d, v = t - p, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin - 1e-3 * a, d.sum()])
        h = np.array([[(v * margin) @ margin + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 4 / max(1e-9, np.abs(step).max()))
        a, c = a + size * step[0], c + size * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, c) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model from distinct features of each row and labels 0 or 1.

    Without rows every score is 0.5; with labels of one class only, near that label.
    """
    y = np.where(np.asarray(labels) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM), 0.0, 1.0, 0.0 if not len(y) else 3.0 * y[0])
    fold = np.zeros(len(y), int)
    for k in (1, -1):
        fold[y == k] = np.arange((y == k).sum()) % 3
    out, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[train].tolist())) == 2:
            w, b = nb_svm([rows[i] for i in train], y[train])
            out[test], known[test] = [w[rows[i]].sum() + b for i in test], True
    w, b = nb_svm(rows, y)
    return Model(w, b, *logistic(out[known], y[known])) if known.any() else Model(w, b, 1.0, 0.0)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, most_features: int = FIT_FEATURES) -> Model:
    """Fit on at most `most` labelled documents and `most_features` indicators of theirs, none of them held out.

    An id that repeats is fitted with its row of the smallest hash of the text;
    labels without id or quality, and labels of no document, are left out. Without
    any the model scores 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")  # at most `most` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for lo, hi in slices(offs):
                keys = features(data, offs[lo : hi + 1])
                cut = np.searchsorted(keys, np.arange(hi - lo + 1) * DIM)
                feats = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((keys % DIM).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "quality", "h")), feats], ["doc_id", "quality", "h", "f"])

    rows = texts.withColumn("quality", F.col("quality").cast("int")).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(released(extract), "doc_id long, quality int, h long, f array<int>")
    rows = store.written(rows.groupBy("doc_id").agg(F.min_by("quality", "h").alias("quality"), F.min_by("f", "h").alias("f")), "quality-fit")
    taken, held = [], 0
    for r in rows.select("doc_id", F.size("f").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most `most` rows
        held += r["n"]
        if held > most_features:
            break
        taken.append((r["doc_id"],))
    few = store.local(docs.sparkSession, taken, "doc_id long")
    got = rows.join(F.broadcast(few), "doc_id").toArrow()  # at most `most` rows, `most_features` features
    ids = got["doc_id"].to_numpy()
    feats = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in got["f"].combine_chunks()]
    order = np.argsort(ids)
    return fit([feats[i] for i in order.tolist()], got["quality"].to_numpy()[order] if len(ids) else np.zeros(0))


def scored(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id and score of every row; with keep, all columns and last the score, under a name that is free.

    Null and empty texts get the score of a text without features; a text of any
    length is read in stretches. Repeated rows get equal scores. Columns of any
    other name pass through, and only texts and scores pass Python. An empty
    table gives no rows.
    """
    live = np.flatnonzero(model.weight)
    sent = docs.sparkSession.sparkContext.broadcast((live, model.weight[live], model.bias, model.slope, model.offset))  # at most DIM weights
    out = "score"
    while keep and out in docs.columns:
        out += "_"

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(cols):
            at, w, *rest = sent.value
            weight = np.zeros(DIM)
            weight[at] = w
            m = Model(weight, *rest)
            for col in cols:
                data, offs = buffers(col)
                got = np.zeros(len(col))
                for lo, hi in slices(offs, SLICE_BYTES // 2):
                    got[lo:hi] = m.score(m.margins(features(data, offs[lo : hi + 1]), hi - lo))
                yield pa.array(got)

        return released(run)(texts)

    return docs.select(*(F.col(f"`{c}`") for c in (docs.columns if keep else ["doc_id"])), score(F.col("text")).alias(out))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rows that the model predicts as label 0."""
    rows = scored(docs, model, keep=True)
    return rows.where(F.col(f"`{rows.columns[-1]}`") >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, store.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
