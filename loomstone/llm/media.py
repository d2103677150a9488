"""Texts as lossless WebP media: payload to 8-bit images, stored, decoded again, features from the pixels."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import store, webp
from loomstone.llm.kernels import buffers, released, slices

WIDTH = 576
#: Rows of an image at most; a longer payload is several files, one after another.
ROWS = 16
SLICE = 1 << 20
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text's UTF-8 bytes, padded with 255 to a positive multiple of WIDTH, as WebP files.

    A null text is an empty one: a row of padding. Equal texts have equal media,
    and rows that repeat repeat; a text of any length becomes as many files as it
    takes. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for lo, hi in slices(offs, SLICE):
                tiles, pads, of = [], [], []
                for r in range(lo, hi):
                    x = data[offs[r] : offs[r + 1]]
                    pad = -len(x) % WIDTH if len(x) else WIDTH
                    x = np.concatenate([x, np.full(pad, 255, np.uint8)])
                    parts = [x[a : a + ROWS * WIDTH] for a in range(0, len(x), ROWS * WIDTH)]
                    tiles += parts
                    pads += [0] * (len(parts) - 1) + [pad]
                    of.append(len(parts))
                files, media, at = webp.encode_grey(tiles, WIDTH, pads), [], 0
                for k in of:
                    media.append(b"".join(files[at : at + k]))
                    at += k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs[lo : hi + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(released(run), STORED)


def split(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = int.from_bytes(media[at + 4 : at + 8], "little") + 8
        out.append(media[at : at + n])
        at += n
    return out


def feature(x: np.ndarray) -> str:
    """Mean and spread of the samples, distinct values, share of steep steps, and a 64-bit average hash."""
    seen = np.bincount(x, minlength=256)
    n, v = len(x), np.arange(256)
    s1, s2 = int(seen @ v), int(seen @ (v * v))
    steps = int((np.abs(np.diff(x.astype(np.int16))) > 32).sum())
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * n // 64) / np.diff(np.append(np.arange(64) * n // 64, n))
    bits = int(np.packbits(cells > s1 / n).view(">u8")[0])
    return f"mean={s1 / n:.4f};var={s2 / n - (s1 / n) ** 2:.3f};values={int((seen > 0).sum())};steps={steps};ahash={bits:016x}"


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of every payload, from the pixels of the stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = buffers(batch.column("media"))
            for lo, hi in slices(offs, SLICE):
                part = batch.slice(lo, hi - lo)
                media = part.column("media").to_pylist()
                files = [split(m) for m in media]
                pixels = webp.decode([f for fs in files for f in fs])
                out, at = [], 0
                for doc, n, m, fs in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), media, files, strict=True):
                    x = np.concatenate([(p >> 8 & 255).astype(np.uint8).reshape(-1) for p in pixels[at : at + len(fs)]])
                    at += len(fs)
                    raw = x.tobytes()
                    out.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(x)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in READ.split(", ")]
    return media.mapInArrow(released(run), READ)


def pixels(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each image of a column `media` of WebP bytes: key, image (0 on), width, height, pixels (argb, row by row).

    Bytes of several files, one after another, give as many images; null or
    empty bytes give none, damaged ones raise, and rows that repeat give repeated
    rows. An image is an array of its own, never more than one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = buffers(batch.column(1))
            for lo, hi in slices(offs, SLICE):
                files = [split(m or b"") for m in batch.column(1).slice(lo, hi - lo).to_pylist()]
                images = webp.decode([f for fs in files for f in fs])
                count = [len(fs) for fs in files]
                size = np.array([0, *(x.size for x in images)])
                flat = np.concatenate([np.zeros(0, np.uint32), *(x.reshape(-1) for x in images)]).astype(np.uint32).view(np.int32)
                cols = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), count))), pa.array([k for n in count for k in range(n)], pa.int32()),
                    pa.array([x.shape[1] for x in images], pa.int32()), pa.array([x.shape[0] for x in images], pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(flat)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["key", "image", "width", "height", "pixels"])

    rows = media.select(F.col(key).cast("long").alias("key"), "media")
    return rows.mapInArrow(released(run), "key long, image int, width int, height int, pixels array<int>").withColumnRenamed("key", key)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store.written(stored(store.table(spark, sf_dir, "documents")), "media"))
