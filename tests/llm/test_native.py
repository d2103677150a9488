"""Sharding and mixing against plain Python."""

import zlib

import pytest
from pyspark.sql import functions as F

from loomstone.llm import graph, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def greedy_need(sizes, cap):
    k, held = 1, 0
    for v in sizes:
        if held + v > cap:
            k, held = k + 1, 0
        held += v
    return k


CASES = {
    "plain": [(i, "w" * (i * 7 % 50), "a") for i in range(90)],
    "hot": [(i, "same text" if i % 3 == 0 else f"t{i}", "a") for i in range(120)],
    "odd": [(1, None, "a"), (1, None, "a"), (None, "x", None), (3, "", "a"), (3, "é" * 9, "a"), (3, "é" * 9, "a")],
    "one": [(5, "abc", "a")],
}


@pytest.mark.parametrize("name", CASES)
def test_minimax_shards(spark, name):
    rows = CASES[name]
    got = [r.asDict() for r in sharding.sharded(frame(spark, rows), 4).collect()]
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        g = groups.setdefault(t, [[], 0])
        g[0].append(i)
        g[1] += len((t or "").encode()) + 1
    order = sorted(groups, key=lambda t: (min((x for x in groups[t][0] if x is not None), default=-1), t is None, t or ""))
    sizes = [groups[t][1] for t in order]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy_need(sizes, c) <= 4)
    shards = {}
    for g in got:
        shards.setdefault(g["shard"], []).append(g)
    if len({min(x for x in groups[t][0] if x is not None) if any(x is not None for x in groups[t][0]) else None for t in groups}) == len(groups):
        assert max(sum(g["size"] for g in s) for s in shards.values()) == best
    for s in shards.values():
        assert sorted(g["slot"] for g in s) == list(range(len(s)))
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["size"], g["text_crc32"]) for g in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)


def test_shards_of_nothing(spark):
    assert sharding.sharded(frame(spark, []), 4).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 200, 100], [5, 2, 1]) == [30.0, pytest.approx(560 / 3), pytest.approx(280 / 3)]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), ["a", "b", "c", "d", None][i % 5]) for i in range(200)] + [(7, None, "a"), (7, None, "a"), (8, "x y\tz", "e")]
    got = [r.asDict() for r in mixing.mixed(frame(spark, rows), slots=64).collect()]
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    assert sorted((g["doc_id"], g["size"]) for g in got) == sorted((i, size(t)) for i, t, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    goal = mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    taken = {}
    for g in got:
        assert g["taken"] <= 3 * g["size"] and g["taken"] >= 0
        assert (g["first_slot"] is None) == (g["taken"] == 0)
        taken[(g["source_size"], g["target"])] = taken.get((g["source_size"], g["target"]), 0) + g["taken"]
    for s, goal_ in zip(sizes, goal, strict=True):
        assert any(a == s and abs(b - goal_) < 1e-6 for a, b in taken)
    assert all(abs(v - k[1]) <= len(names) for k, v in taken.items())
    again = [r.asDict() for r in mixing.mixed(frame(spark, rows).repartition(3), slots=64).collect()]
    key = lambda g: (g["doc_id"], g["size"], g["taken"], g["first_slot"] or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(frame(spark, [])).count() == 0 and mixing.remixed(frame(spark, [])).count() == 0


def test_schedule_spreads_sources(spark):
    sources = [mixing.Source("a", 600, 600.0, 600, 0), mixing.Source("b", 300, 300.0, 300, 600), mixing.Source("c", 5, 5.0, 5, 900)]
    slots = sorted((r["slot"], r["src"], r["r"]) for r in mixing.schedule(spark, sources, 10).collect())
    assert len(slots) == 60 + 30 + 1 and len({s for s, _, _ in slots}) == len(slots)
    for n in range(10, 90, 10):
        assert abs(sum(s == 0 for _, s, _ in slots[:n]) - n * 600 / 905) < 4


def mix_by_hand(spark, rows, slots):
    """(doc_id, text, source, taken, first slot) of every row, with lists only; the hash of the shuffle is Spark's."""
    df = frame(spark, rows).select("doc_id", "text", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h"))
    order = sorted(((r["source"] is None, r["source"] or "", r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in df.collect()), key=lambda r: r[:5])
    size = lambda t: len((t or "").encode().split())
    names = sorted({(o[0], o[1]) for o in order})
    streams = [[(o[4] if o[3] else None, o[5]) for o in order if o[:2] == n] for n in names]
    sizes = [sum(size(t) for _, t in s) for s in streams]
    taken = [min(round(t), 3 * n) for t, n in zip(mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(names))]), sizes, strict=True)]
    block = max(1, -(-sum(taken) // slots))
    need = [-(-t // block) for t in taken]
    of, n, acc, ends = {}, -(-sum(taken) // block), 0.0, []
    for t in taken:
        acc += t / max(1, sum(taken))
        ends.append(acc)
    count = [0] * len(names)
    for slot in range(n):
        u = ((slot + 0.5) * mixing.GOLDEN) % 1.0
        src = min(sum(e <= u for e in ends), len(names) - 1)
        if count[src] < need[src]:
            of[src, count[src]] = slot
        count[src] += 1
    for src, k in enumerate(need):
        for r in range(k):
            of.setdefault((src, r), n + r * len(names) + src)
    out, uses = [], []
    for src, stream in enumerate(streams):
        at = 0
        for doc, text in stream:
            took, first = 0, None
            for e in range(3):
                lo = at + e * sizes[src]
                words = range(lo, min(lo + size(text), taken[src]))
                took += len(words)
                if len(words):
                    slot = [of[src, r] for r in sorted({w // block for w in words})]
                    first = min([*slot, first] if first is not None else slot)
                    uses.append((slot[0], src, lo, doc, text))
            out.append((doc, size(text), sizes[src], took, first))
            at += size(text)
    return out, [(u[3], u[4]) for u in sorted(uses, key=lambda u: u[:3])]


MIXED = [(i, " ".join(["w", str(i)] * (i % 9)), ["a", "b", "c", "d", None][i * i % 5]) for i in range(150)] + [(7, None, "a"), (7, None, "a"), (8, "x y\tz", "e"), (None, "p q r", "b"), (9, "", "c"), (9, "s t u", "c"), (9, "s t u", "c"), (10, "long " * 3000, "a")]


@pytest.mark.parametrize("slots", [16, 3000])
def test_mix_by_hand(spark, monkeypatch, slots):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    want, order = mix_by_hand(spark, MIXED, slots)
    got = mixing.mixed(frame(spark, MIXED), slots=slots).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"], r["first_slot"]) for r in got), key=key) == sorted(want, key=key)
    rows = mixing.remixed(frame(spark, MIXED), slots=slots).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == order


def test_mix_of_nothing_to_take(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \n", "b")]
    assert sorted(tuple(r)[1:] for r in mixing.mixed(frame(spark, rows)).collect()) == [(0, 0, 0.0, 0, None)] * 3
    assert mixing.remixed(frame(spark, rows)).count() == 0


def test_remix_keeps_columns(spark):
    rows = [(i, "a b c", "s") for i in range(5)] + [(9, "d", "t")]
    clash = ("size", "pos", "part", "rid", "doc", "slot", "src", "lo", "r", "shuffle")
    docs = frame(spark, rows).select("*", *(F.lit(k).alias(c) for k, c in enumerate(clash)))
    got = mixing.remixed(docs)
    assert got.columns == docs.columns and {tuple(r[c] for c in clash) for r in got.collect()} == {tuple(range(len(clash)))}
    assert {r["doc_id"] for r in got.collect()} <= {i for i, _, _ in rows}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (102, 100), (100, 102)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["root"] for r in graph.components(df).collect()}
    assert got == {r["id"]: r["root"] for r in graph.components(df, one_task=0).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
