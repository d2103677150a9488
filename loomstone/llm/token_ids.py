"""Token-id shards with a minimal perfect hash index for keyed access.

A shard is two files. `<name>.ids` holds the ids of its documents one after
another, little-endian, 16 bits wide if the vocabulary allows and 32 otherwise.
`<name>.idx` maps a document key to its ids:

    8 bytes   magic LMSIDX01
    int64 x 6 width of an id, documents, distinct keys, levels, ids, flags
    per level int64 bits, uint64 words of the level's bit vector
    uint32    ones before each 512-bit block, over all levels joined
    per slot  uint32 fingerprint, uint32 rows, int64 first row
    per row   int64 first id, and one more: the total
    per row   int64 key
    flag 1    per row in key order, int64 row: where rows don't stand in key order
    flag 2    a bit for each row whose key is null (its key above is the least long)

The hash is built level by level: of the keys not yet placed, those alone on
their bit of the level's vector are placed there; the others go on. A key's slot
is the number of ones before its bit. A lookup reads one bit per level (1.3 on
average), one block count and one slot; the fingerprint refuses absent keys but
for one in 2**32.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import store
from loomstone.llm.kernels import U64, buffers, mix64, released, slices

MAGIC = b"LMSIDX01"
GAMMA = 2.0
BLOCK = 512
#: Ids in a shard, about; a shard ends with the document that reaches it.
SHARD_IDS = 16 << 20
SEPARATOR = "<|startoftext|>"
MEMO_WORDS = 200_000
#: Ids that are put in place at once.
BLOCK_IDS = 1 << 16


# --- minimal perfect hash -------------------------------------------------

def key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(U64) + U64((seed * 0x9E3779B97F4A7C15) % 2**64))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (key_hash(keys, 0xF1) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """Bit vectors of the levels; slot() of a key that was built in is unique and below the key count."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self.start = np.concatenate([[0], np.cumsum([len(x) * 64 for x in levels])]).astype(np.int64)
        self.words = np.concatenate(levels) if levels else np.zeros(0, U64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        pad = -len(ones) % (BLOCK // 64)
        per = np.concatenate([ones, np.zeros(pad, np.int64)]).reshape(-1, BLOCK // 64).sum(1)
        self.ranks = np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct integers."""
        levels, sizes, rest = [], [], keys.astype(np.int64)
        while len(rest):
            bits = -(-max(64, int(GAMMA * len(rest))) // 64) * 64
            at = (key_hash(rest, len(levels) + 1) % U64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(U64))
            sizes.append(bits)
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
        return cls(levels, sizes)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that are on no level."""
        keys = np.asarray(keys, np.int64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = (key_hash(keys[left], k + 1) % U64(bits)).astype(np.int64) + self.start[k]
            hit = (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
            out[left[hit]] = self._rank(at[hit])
            left = left[~hit]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        block = at // BLOCK
        total = self.ranks[block].astype(np.int64)
        word = at >> 6
        for j in range(BLOCK // 64):  # whole words of the block before the bit's word
            w = block * (BLOCK // 64) + j
            before = w < word
            total += np.where(before, np.bitwise_count(self.words[np.minimum(w, len(self.words) - 1)]), 0)
        low = self.words[word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return total + np.bitwise_count(low)


# --- shard files ----------------------------------------------------------

def index_bytes(keys: np.ndarray, lengths: np.ndarray, width: int, null: np.ndarray | None = None) -> bytes:
    """The index file of rows in any order; null: a mask of the rows without key."""
    keys = keys.astype(np.int64)
    place = np.argsort(keys, kind="stable")
    distinct, first, rows = np.unique(keys[place], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slot(distinct)
    entry = np.zeros(len(distinct), np.dtype([("print", "<u4"), ("rows", "<u4"), ("first", "<i8")]))
    entry["print"][slot], entry["rows"][slot], entry["first"][slot] = fingerprint(distinct), rows, first
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i8")
    moved, gone = bool((place[1:] < place[:-1]).any()), null is not None and bool(null.any())
    out = io.BytesIO()
    out.write(MAGIC)
    out.write(np.array([width, len(keys), len(distinct), len(mph.sizes), starts[-1], moved + 2 * gone], "<i8").tobytes())
    for bits, words in zip(mph.sizes, mph.levels, strict=True):
        out.write(np.array([bits], "<i8").tobytes() + words.astype("<u8").tobytes())
    for part in (mph.ranks.astype("<u4"), entry, starts, keys.astype("<i8")):
        out.write(part.tobytes())
    if moved:
        out.write(place.astype("<i8").tobytes())
    if gone:
        out.write(np.packbits(null).tobytes())
    return out.getvalue()


class Shard:
    """Keyed access to one shard's ids."""

    def __init__(self, index: bytes, ids: bytes | memoryview):
        if bytes(index[:8]) != MAGIC:
            raise ValueError("not an id index")
        at = 8

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(index, kind, n, at)
            at += got.nbytes
            return got

        self.width, self.rows, distinct, levels, total, flags = (int(x) for x in take("<i8", 6))
        vectors, sizes = [], []
        for _ in range(levels):
            sizes.append(int(take("<i8", 1)[0]))
            vectors.append(take("<u8", sizes[-1] // 64))
        self.mph = PerfectHash(vectors, sizes)
        if not np.array_equal(take("<u4", len(self.mph.ranks)), self.mph.ranks):
            raise ValueError("damaged id index")
        self.entry = take(np.dtype([("print", "<u4"), ("rows", "<u4"), ("first", "<i8")]), distinct)
        self.starts, self.keys = take("<i8", self.rows + 1), take("<i8", self.rows)
        self.place = take("<i8", self.rows) if flags & 1 else np.arange(self.rows)
        self.null = np.unpackbits(take(np.uint8, -(-self.rows // 8)), count=self.rows).astype(bool) if flags & 2 else np.zeros(self.rows, bool)
        self.ids = np.frombuffer(ids, "<u2" if self.width == 2 else "<u4", total)

    def locate(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """(first place in key order, number of rows) of each key; 0 rows for a key the shard doesn't hold."""
        keys = np.asarray(keys, np.int64)
        slot = self.mph.slot(keys)
        if not len(self.entry):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        e = self.entry[np.maximum(slot, 0)]
        known = (slot >= 0) & (e["print"] == fingerprint(keys))
        return np.where(known, e["first"], 0), np.where(known, e["rows"], 0).astype(np.int64)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of this key."""
        first, rows = (int(x[0]) for x in self.locate([key]))
        return [self.ids[self.starts[r] : self.starts[r + 1]] for r in self.place[first : first + rows].tolist()]


# --- tokenizer ------------------------------------------------------------

_loaded: dict[str, object] = {}


class WordMemo:
    """Encodes texts word by word, each distinct word once.

    The tokenizer never joins characters across white space, nor a letter with
    the punctuation after it, and it lowers capitals itself; so the ids of a
    text are those of its words, cut before closing punctuation and in lower
    case, in order. A memo of bounded size keeps the ids, as bytes, of words met
    lately. Texts that hold the beginning of a special token are encoded whole,
    and all texts are where a tokenizer doesn't encode PROBES like that.
    """

    PROBES = ("The Quick  fox, jumps. Over\n\tthe LAZY dog!", "Isn't it (fine)., OK!! 12.5% a-b c_d e@f.g", "ÀÉ é à la İx ß ﬁ", "x　y z ½ ", "日本語 и Русский", "a.b c... d)e [f] {g} h;i 1,000.00 \"q\"", "zero\u200bwidth tab\there")

    CLOSING = r"([A-Za-z])([.,;:!?|$%&*#()\[\]=+-]+)(\s|$)"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.sep = self.tok.token_to_id(SEPARATOR)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_word = self.sep is not None
        if self.by_word:
            got, n = self.encode(pa.array(self.PROBES), None)
            self.by_word = [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [self.tok.encode(x, add_special_tokens=False).ids for x in self.PROBES]

    def _encode(self, words: list[str]) -> list[bytes]:
        out, size = [], self.kind.itemsize
        for lo in range(0, len(words), 4000):
            text = f" {SEPARATOR} ".join(words[lo : lo + 4000])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(ids == self.sep) * size).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + size for e in ends)], [*ends, len(raw)], strict=True)]
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        got = [new.get(x) or old.get(x) for x in words]
        missing = [i for i, x in enumerate(got) if x is None]
        for i, v in zip(missing, self._encode([words[i] for i in missing]), strict=True):
            got[i] = v
        new.update(zip(words, got, strict=True))
        if len(new) > MEMO_WORDS:
            self.new, self.old = {}, new
        return got

    def encode(self, col: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per row); each row ends with `end` if given."""
        if col.null_count:
            col = pc.fill_null(col, "")
        odd = np.flatnonzero(pc.match_substring(col, "<|").to_numpy(zero_copy_only=False)) if self.by_word else np.arange(len(col))
        whole = {int(i): np.array(self.tok.encode(col[int(i)].as_py(), add_special_tokens=False).ids, self.kind).tobytes() for i in odd}
        if whole:
            mask = np.zeros(len(col), bool)
            mask[odd] = True
            col = pc.if_else(pa.array(mask), "", col)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(col, self.CLOSING, r"\1 \2\3")))
        coded = lists.flatten().dictionary_encode()
        offs = np.asarray(lists.offsets, np.int64)
        offs = offs - offs[0]
        del lists
        pa.default_memory_pool().release_unused()  # else what the words took stays beside what their ids take
        vals = self._known(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        last = np.full(len(col), len(vals), np.int64)  # one more word closes each row, whole texts among them
        vals.append(b"" if end is None else np.array([end], self.kind).tobytes())
        for i, v in whole.items():
            last[i] = len(vals)
            vals.append(v + vals[len(coded.dictionary)])
        which = np.insert(which, offs[1:], last)
        offs = offs + np.arange(len(offs))
        table = np.frombuffer(b"".join(vals), self.kind)
        size = np.fromiter(map(len, vals), np.int64, len(vals)) // self.kind.itemsize
        first = np.cumsum(size) - size
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size[which], out=total[1:])
        ids = np.empty(total[-1], self.kind)
        for lo in range(0, len(ids), BLOCK_IDS):  # their places take eight bytes each, the ids two or four
            hi = min(len(ids), lo + BLOCK_IDS)
            i, j = np.searchsorted(total, lo, "right") - 1, np.searchsorted(total, hi)
            n = np.diff(np.clip(total[i : j + 1], lo, hi))
            ids[lo:hi] = table[np.repeat(first[which[i:j]] - total[i:j], n) + np.arange(lo, hi)]
        return ids, np.diff(total[offs])


def memo(path: str) -> WordMemo:
    if path not in _loaded:
        _loaded[path] = WordMemo(path)
    return _loaded[path]


# --- Spark ----------------------------------------------------------------

MANIFEST = "part int, seq int, path string, first_key long, last_key long, docs long, ids long"


def write_shards(docs: DataFrame, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS, order: tuple[str, ...] = ()) -> DataFrame:
    """Encode all texts and write them as shards in ascending key order; the manifest, one row per shard.

    A null text counts as empty; a null key comes first and stays null; rows of
    one key keep together, in the order of their texts' hash. With order, the
    names of columns that together tell rows apart, rows stand in that order
    instead. Files are written under a name of the attempt's own; only those of
    attempts that succeed come into the manifest, which is itself written, so a
    lost executor repeats its shards and no other. An empty table gives an empty
    manifest.
    """
    spark = docs.sparkSession
    folder = store.fresh(spark, "ids")
    own = [F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"), F.col(key).isNull().alias("gone"), F.col(text).alias("t")]
    if order:
        rows = docs.select(*own, *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
        by = [f"o{i}" for i in range(len(order))]
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    else:
        rows = docs.select(*own).withColumn("h", F.xxhash64("t"))
        rows = rows.repartitionByRange(F.col("k"), F.col("gone").desc(), F.col("h")).sortWithinPartitions("k", F.col("gone").desc(), "h", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = store.open_fs(folder)
        files.create_dir(base, recursive=True)
        coder, part, seq = memo(tokenizer), TaskContext.get().partitionId(), 0
        width = coder.kind.itemsize
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        out, name, held = None, "", 0

        def close():
            nonlocal seq, out
            out.close()
            k, n = np.concatenate(keys), np.concatenate(lengths)
            with files.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(index_bytes(k, n, width, np.concatenate(nulls)))
            row = {"part": part, "seq": seq, "path": name, "first_key": int(k.min()), "last_key": int(k.max()), "docs": len(k), "ids": int(n.sum())}
            keys.clear()
            nulls.clear()
            lengths.clear()
            seq, out = seq + 1, None
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
        for batch in batches:
            _, offs = buffers(batch.column("t"))
            for lo, hi in slices(offs, min(4 << 20, 4 * shard_ids)):
                col = batch.column("t").slice(lo, hi - lo)
                ids, n = coder.encode(col, end)
                if out is None:
                    name, held = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}", 0
                    out = files.open_output_stream(f"{base}/{name}.ids")
                out.write(ids.tobytes())
                keys.append(batch.column("k").slice(lo, hi - lo).to_numpy())
                nulls.append(batch.column("gone").slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                lengths.append(n)
                held += len(ids)
                if held >= shard_ids:
                    yield close()
        if out is not None:
            yield close()

    made = rows.select("k", "gone", "t").mapInArrow(released(write), MANIFEST).withColumn("folder", F.lit(folder))
    return store.written(made, "ids-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, shard.

    start counts the ids of all documents before; every document is looked up
    by its key through the index.
    """
    whole = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(whole), F.lit(0)))  # a row per shard, not per document
    n = max(1, store.partitions(manifest.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, base = store.open_fs(row["folder"])
                with files.open_input_file(f"{base}/{row['path']}.idx") as f:
                    index = f.read()
                with files.open_input_file(f"{base}/{row['path']}.ids") as f:
                    shard = Shard(index, f.read())
                keys = np.unique(shard.keys)
                first, rows = shard.locate(keys)
                if int(rows.sum()) != shard.rows:
                    raise ValueError(f"index of {row['path']} doesn't hold all of its keys")
                at = shard.place[np.repeat(first - np.concatenate([[0], np.cumsum(rows)[:-1]]), rows) + np.arange(shard.rows)]
                lo, hi = shard.starts[at], shard.starts[at + 1]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(keys, rows), mask=shard.null[at]), pa.array(lo + row["base"]), pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array([row["path"][:11]] * len(crc))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    return placed.repartition(n, "path").mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(store.table(spark, sf_dir, "documents"), vocabulary()))
