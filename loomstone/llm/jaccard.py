"""N-gram Jaccard join: exact similarity components of word 5-gram sets.

Every distinct set is a vertex; rows with equal sets share it. Grams are ordered
rare first: a count sketch of fixed size over the whole corpus gives each gram a
frequency class, the class and the gram's hash form its token, and tokens are
compared as numbers. Two sets that reach the similarity share a token among
their first n - ceil(t n) + 1 tokens, so only those prefixes are joined; pairs
pass length, positional and suffix filters, are made distinct, and are verified
once on the full sets.

All pairs of a large cluster are never formed. First every row of a token meets
only one set, which the token picks by hash; verified links give provisional
components. While many pairs across components remain, each open token picks
another set for its rows to meet, so a cluster grows together in a few linear
rounds. The
pairs still left, across components only and past the suffix filter, are then
joined and verified. A link inside a component needs no pair, a link across has
one, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import graph, store
from loomstone.llm.kernels import SLICE_BYTES, U64, Words, buffers, mix64, released, shingles, slices, word_windows
from loomstone.llm.sieve import sifted

SKETCH = 1 << 20
PART = 1 << 14
#: Bands of the suffix filter; the parity of each band's size is a bit of so many 64-bit words.
BANDS = 512
WORDS = BANDS // 64
#: Pairs across components, per row of the open tokens, up to which they are joined at once; rounds before that at most.
FEW, ROUNDS = 2, 2
#: Frequency class from which a token's rows are dealt to several tasks.
HOT_CLASS, HOT_WAYS = 8 * 14, 64
#: The similarity, 8/10, as a ratio of whole numbers.
UP, DOWN = 4, 5
#: Rows of a token, and partners of a set, for each task that they are dealt to.
TOKEN_ROWS, PARTNERS = 1000, 200
#: What sets the second signature apart from the first.
PROOF = 1 << 32


def _gram_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, sorted and distinct in each row; first[r]); a single long row is read in stretches."""
    if len(offs) == 2 and offs[1] - offs[0] > SLICE_BYTES:
        parts = [np.unique(shingles(Words(data, np.array(w)))[0]) for w in word_windows(data, int(offs[0]), int(offs[1]))]
        h = np.unique(np.concatenate(parts))
        return h, np.array([0, len(h)])
    h, row = shingles(Words(data, offs))
    return _distinct(h, np.searchsorted(row, np.arange(len(offs))))


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][first[:-1] < len(h)]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _signatures(h: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A sum over each row's grams that no order of them changes."""
    c = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + U64(2 * salt + 1)))])
    return mix64(c[first[1:]] - c[first[:-1]]).view(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & U64(SKETCH - 1)).astype(np.int64)


SETS = "kind int, doc_id long, key long, n long, sig long, proof long, bands array<long>, part int, counts binary"


def survey(docs: DataFrame, salt: int) -> DataFrame:
    """Written rows of two kinds: 0 a document's set (n, sig, proof, bands), 1 a part of a task's sketch of gram counts.

    sig and proof are signatures that know nothing of each other; key is a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for lo, hi in slices(offs):
                h, first = _gram_sets(data, offs[lo : hi + 1])
                n, rows = np.diff(first), hi - lo
                np.add(total, np.bincount(_bucket(h), minlength=SKETCH).astype(np.uint32), out=total)
                band = np.repeat(np.arange(rows), n) * BANDS + (h >> U64(20) & U64(BANDS - 1)).astype(np.int64)
                odd = (np.bincount(band, minlength=rows * BANDS) & 1).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * WORDS), pa.array(np.packbits(odd).view(np.int64)))
                own = [batch.column(c).slice(lo, rows) for c in ("doc_id", "key")]
                cols = [pa.array(np.zeros(rows, np.int32)), *own, pa.array(n), pa.array(_signatures(h, first, salt)), pa.array(_signatures(h, first, salt + PROOF)), lists, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        if total.any():
            k = SKETCH // PART
            cols = [pa.array(np.ones(k, np.int32)), *[pa.nulls(k, pa.int64())] * 5, pa.nulls(k, pa.list_(pa.int64())), pa.array(np.arange(k, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(k, PART)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [x.split()[0] for x in SETS.split(", ")]
    return store.written(docs.mapInArrow(released(run), SETS), "gram-survey")


def classes(surveyed: DataFrame) -> np.ndarray:
    """Frequency class of each sketch cell, 0 to 255: SKETCH bytes, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(PART, np.float64)
                sums[part] += np.frombuffer(blob, "<u4")
        out = [np.minimum(255, np.round(8 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["part", "counts"])

    parts = surveyed.where("kind = 1").select("part", "counts")
    got = parts.repartition(min(SKETCH // PART, store.partitions(surveyed.sparkSession)), "part").mapInArrow(released(add), "part int, counts binary").collect()  # SKETCH bytes
    out = np.zeros((SKETCH // PART, PART), np.uint8)
    for r in got:
        out[r["part"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def prefixes(docs: DataFrame, table: np.ndarray, salt: int) -> DataFrame:
    """token, sig, n, pos: the prefix tokens of each set, once per task for sets that repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(table)  # SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = sent.value
        seen: set[int] = set()
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for lo, hi in slices(offs):
                h, first = _gram_sets(data, offs[lo : hi + 1])
                sig, n = _signatures(h, first, salt), np.diff(first)
                new = np.zeros(len(n), bool)
                for i, s in enumerate(sig.tolist()):
                    if n[i] and s not in seen:
                        seen.add(s)
                        new[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                rows = np.flatnonzero(new)
                k = n[rows] - -(-UP * n[rows] // DOWN) + 1
                kind, tok = cls[_bucket(h)], []
                for a, b, m in zip(first[:-1][rows].tolist(), first[1:][rows].tolist(), k.tolist(), strict=True):
                    by = a + np.argsort(kind[a:b], kind="stable")[:m]  # by class, then by hash, in all sets alike
                    tok.append(h[by] >> U64(8) | kind[by].astype(U64) << U64(56))
                pos = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.zeros(0, U64), *tok]).view(np.int64)), pa.array(np.repeat(sig[rows], k)), pa.array(np.repeat(n[rows], k)), pa.array(pos.astype(np.int32))],
                    ["token", "sig", "n", "pos"],
                )

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(released(run), "token long, sig long, n long, pos int")


def _may_link(n: str, pos: str, other: str, other_pos: str):
    """Length and positional filters; n is at most other."""
    n_, m_ = F.col(n), F.col(other)
    left = F.least(n_ - F.col(pos), m_ - F.col(other_pos))
    return (n_ * DOWN >= m_ * UP) & (left * (UP + DOWN) >= (n_ + m_) * UP)


def _alike(a: str, b: str):
    """Suffix filter of two sets (na, nb): cut into bands at fixed pivots, they differ in a token at least wherever the bands' sizes differ in parity."""
    apart = sum((F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))) for k in range(WORDS)), F.lit(0))
    both = F.col("na") + F.col("nb")
    return (both - apart) * (UP + DOWN) >= both * (2 * UP)


def _linked_so_far(vertices: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """vertices with root, the smallest vid of their component."""
    roots = graph.components(links, tag).withColumnRenamed("id", "vid")
    return vertices.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))


PAIR = ["sa", "na", "sb", "nb"]


def verified(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, tag: str, salt: int) -> DataFrame:
    """The pairs (sa, na, sb, nb, and whether b is the hub) that link, as a and b (each vertex's smallest doc_id).

    The suffix filter comes first. Of each pair the other set's text is sent to
    the hub's, a set with many partners standing in several places; there both
    are cut into grams again, and the whole sets are compared.
    """
    va, vb = (vertices.select(F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.struct("vid", "key").alias(x), F.col("bands").alias(f"f{x}")) for x in "ab")
    alike = pairs.join(va, ["sa", "na"]).join(vb, ["sb", "nb"]).where(_alike("fa", "fb"))
    this, that = (F.struct(F.col(f"s{x}").alias("sig"), F.col(f"{x}.vid").alias("doc_id"), F.col(f"{x}.key").alias("key")) for x in "ab")
    alike = alike.select(F.when(F.col("hub"), that).otherwise(this).alias("hub"), F.when(F.col("hub"), this).otherwise(that).alias("leaf"))
    alike = store.written(alike.select(F.col("hub.sig").alias("at"), "hub", "leaf"), f"{tag}-pairs")
    ways = alike.groupBy("at").agg(F.ceil(F.count("*") / PARTNERS).alias("ways"))
    dealt = alike.join(ways, "at").withColumn("way", F.pmod(F.xxhash64("leaf.sig"), F.col("ways")).cast("int"))
    sends = dealt.select("at", "way", "leaf.*", F.lit(1).alias("role")).unionByName(dealt.select("at", "way", "hub.*", F.lit(0).alias("role")).distinct())
    sends = store.written(sends, f"{tag}-sends")
    texts = sifted(docs, sends).groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    rows = texts.join(sends, ["doc_id", "key"]).repartition("at", "way").sortWithinPartitions("at", "way", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub, mine = None, 0, np.zeros(0, U64)
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            at, way, role, sig, doc = (batch.column(c).to_pylist() for c in ("at", "way", "role", "sig", "doc_id"))
            got = []
            for lo, hi in slices(offs):
                h, first = _gram_sets(data, offs[lo : hi + 1])
                known = _signatures(h, first, salt).tolist()
                for i in range(lo, hi):
                    if known[i - lo] != sig[i]:
                        raise ValueError("two texts of one id and one hash")
                    g = h[first[i - lo] : first[i - lo + 1]]
                    if not role[i]:
                        held, hub, mine = (at[i], way[i]), doc[i], g.copy()
                        continue
                    if held != (at[i], way[i]):
                        raise ValueError("a pair came without its hub")
                    place = np.searchsorted(mine, g)
                    same = int((mine[np.minimum(place, len(mine) - 1)] == g).sum())
                    if same * (UP + DOWN) >= UP * (len(mine) + len(g)):
                        got.append((hub, doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

    links = store.written(rows.mapInArrow(released(compare), "a long, b long"), f"{tag}-links")
    store.dropped(alike, sends)
    return links


def _starred(rows: DataFrame, turn: int, way, *more: str) -> DataFrame:
    """rows with the fields of the set that each token picks in this turn, suffixed 0, and whether others stand beside.

    The hashes that they are ordered by are made after the shuffle, which so doesn't carry them.
    """
    dealt = rows.withColumn("way", way).repartition("token", "way").withColumn("order", F.xxhash64("sig", "token", F.lit(turn)))
    by = Window.partitionBy("token", "way").orderBy("order", "n", "sig")
    first = by.rowsBetween(Window.unboundedPreceding, 0)
    return dealt.select("*", *(F.first(c).over(first).alias(f"{c}0") for c in ("sig", "n", "pos", *more)), F.lag("sig").over(by).alias("before"), F.lead("sig").over(by).alias("after"), F.count("*").over(Window.partitionBy("token", "way")).alias("k"))


def _pairs(stars: DataFrame) -> DataFrame:
    """Distinct (sa, na, sb, nb, hub), na at most nb, of rows and their picked sets that pass the filters; hub: the picked set is b."""
    this, that = (F.struct(F.col(f"n{x}").alias("n"), F.col(f"sig{x}").alias("sig"), F.col(f"pos{x}").alias("pos")) for x in ("", "0"))
    both = stars.select(F.least(this, that).alias("a"), F.greatest(this, that).alias("b"), (that > this).alias("hub"))
    both = both.select(*(F.col(f"{x}.{c}").alias(f"{c}{x}") for x in "ab" for c in ("n", "sig", "pos")), "hub").where(_may_link("na", "posa", "nb", "posb"))
    return both.select(F.col("siga").alias("sa"), "na", F.col("sigb").alias("sb"), "nb", "hub").groupBy(*PAIR).agg(F.max("hub").alias("hub"))


def linked(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A row without words, or with a null text, has no grams and is its own
    component; so is a row with a null id, whose component is null. Rows of one
    text share a component; rows of one id count as one document. Ties cannot
    arise: a component is named by its smallest id. A text of any length is read
    in stretches. An empty table gives no rows; other columns are not read.

    Sets are told apart by 128 bits, grams by 64: where sets of one signature
    differ in the other, all is done again with another salt.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    surveyed = survey(docs, salt)
    members = surveyed.where("kind = 0").select("doc_id", "key", "n", "sig", "proof", "bands")
    first = F.min(F.struct("doc_id", "key"))
    vertices = members.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(first.alias("first"), F.first("bands").alias("bands"), F.min("proof").alias("low"), F.max("proof").alias("high"))
    vertices = store.written(vertices.select("sig", "n", F.col("first.doc_id").alias("vid"), F.col("first.key").alias("key"), "bands", "low", "high"), "gram-vertices")
    if vertices.where("low <> high").limit(1).count():
        return linked(docs, salt + 1)
    # Rows of a very frequent token are dealt to HOT_WAYS tasks; what doesn't meet there meets in later rounds.
    hot = F.shiftrightunsigned("token", 56) >= HOT_CLASS
    stars = _starred(prefixes(docs, classes(surveyed), salt), 0, F.when(hot, F.pmod("sig", F.lit(HOT_WAYS))).otherwise(0))
    met = stars.where((F.col("before").isNull() | (F.col("before") != F.col("sig"))) & (F.col("before").isNotNull() | F.col("after").isNotNull() | hot))
    met = store.written(met.select("token", "sig", "n", "pos", "sig0", "n0", "pos0", ((F.col("k") > 2) | hot).alias("more")), "gram-tokens")
    tested = store.written(_pairs(met.where(F.col("sig") != F.col("sig0"))), "gram-star")
    links = verified(tested, vertices, docs, "star", salt)
    open_, before = met.where("more"), None  # the two sets of a token that no other has are tested
    for turn in range(ROUNDS + 1):
        # A set's label: a hash of its component's root, or its own signature while it has no link.
        known = graph.components(links, "star-components")
        known = known.unionByName(known.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "vid")
        known = vertices.select("sig", "n", "vid").join(known, "vid").select("sig", "n", F.xxhash64("root").alias("label"))
        rows = open_.select("token", "sig", "n", "pos").join(known, ["sig", "n"], "left")
        rows = rows.withColumn("root", F.coalesce("label", "sig")).drop("label")
        share = rows.groupBy("token", "root").agg(F.count("*").cast("double").alias("k"))
        across = (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2
        share = share.groupBy("token").agg(across.alias("across"), F.sum("k").alias("k"))
        # Two sets under a token have met already, unless the token was dealt out.
        dealt = (F.shiftrightunsigned("token", 56) >= HOT_CLASS) | (F.col("k") > TOKEN_ROWS)
        share = share.where((F.col("across") > 0) & ((F.col("k") > 2) | dealt)).select("token", "across", F.ceil(F.col("k") / TOKEN_ROWS).cast("int").alias("ways"))
        last, open_ = (open_ if turn else met), store.written(rows.join(share, "token"), "gram-open")
        store.dropped(last)
        size = open_.groupBy("token").agg(F.first("across").alias("x"), F.count("*").alias("n")).agg(F.sum("x").alias("x"), F.sum("n").alias("n")).first()
        ways = size["x"] or 0.0
        if turn == ROUNDS or ways <= FEW * (size["n"] or 0) or (before is not None and ways > 0.9 * before):
            break
        before = ways
        way = F.pmod(F.xxhash64("sig", F.lit(turn)), F.col("ways"))
        star = _pairs(_starred(open_, turn + 1, way, "root").where("root <> root0")).join(tested.select(*PAIR), PAIR, "left_anti")
        star = store.written(star, "gram-star")
        links, tested = links.unionByName(verified(star, vertices, docs, "star", salt)), tested.unionByName(star)
    # What is still open is joined, a frequent token's rows in parts: one side's rows fall into one part, the other's into all.
    one, two = (open_.join(vertices.select("sig", "n", "bands"), ["sig", "n"]).select("token", "ways", *(F.col(c).alias(f"{c}{x}") for c in ("sig", "n", "pos", "root", "bands"))) for x in "ab")
    one = one.withColumn("way", F.pmod(F.xxhash64("siga"), F.col("ways")).cast("int")).drop("ways")
    two = two.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    meets = (F.col("roota") != F.col("rootb")) & (F.struct("na", "siga") < F.struct("nb", "sigb")) & _may_link("na", "posa", "nb", "posb")
    rest = one.join(two, (one["token"] == two["token"]) & (one["way"] == two["way"]) & meets & _alike("bandsa", "bandsb"))
    rest = rest.select(F.col("siga").alias("sa"), "na", F.col("sigb").alias("sb"), "nb").distinct().join(tested.select(*PAIR), PAIR, "left_anti")
    rest = store.written(rest.withColumn("hub", F.lit(True)), "gram-rest")
    store.dropped(open_)
    links = links.unionByName(verified(rest, vertices, docs, "across", salt))
    named = _linked_so_far(vertices, links, "gram-components").select("sig", "n", "root")
    out = members.select("doc_id", "n", "sig").join(named, ["sig", "n"], "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(store.table(spark, sf_dir, "documents"))
