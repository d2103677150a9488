"""Text operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import decontaminate, jaccard, kernels, licences, mixing, quality, registry, store, suffixes, token_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], SCHEMA)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 90]))) for _ in range(n)]
    passage = " ".join(rnd.choice(vocab) for _ in range(30))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i % 5]) for i in range(12)]
    for i in range(25):
        w = texts[1].split() * 2
        w[rnd.randrange(len(w))] = "changed"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, f"{texts[i]} {passage}\n{texts[i + 1]}") for i in range(8)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "one"), (4004, "ONE"), (4005, "the " * 400), (4006, "the " * 300 + "end"), (None, texts[0]), (4007, "long " + " ".join(texts) * 3)]
    rows += [rows[3], rows[3], (5000, "x" * 49), (5001, "x" * 50), (5002, "y" + "x" * 60)]
    return rows


def grams(t):
    w = [x.lower() for x in (t or "").encode().split()]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(grams(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for k, (i, s) in enumerate(flat):
        for j, u in flat[:k]:
            if 100 * len(s & u) >= 80 * len(s | u):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = jaccard.linked(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len(grams(t)), find(i) if i is not None else -1) for i, t in rows)
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got) == want
    assert jaccard.linked(frame(spark, [])).count() == 0


def test_jaccard_far_from_star(spark, monkeypatch):
    """Clusters that only chains of links hold together, with the last join and without rounds before it."""
    rnd = random.Random(3)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w[rnd.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    want = {i: 0 for i in range(40)}
    sets = [grams(t) for _, t in rows]
    assert min(len(a & b) / len(a | b) for a in sets for b in sets) < 0.5
    for rounds in (0, 5):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        links = {(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        comp = dict(want)
        for i in range(40):
            comp[i] = min([comp[j] for j in range(i) if (i, j) in links] or [i])
        got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(frame(spark, rows)).collect()}
        assert len(set(got.values())) <= len(set(comp.values()))
        assert all(got[i] == got[j] for i, j in links)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_jaccard_of_words_made_to_collide(spark):
    """Words on which polynomial hashes modulo a power of two meet are told apart."""
    rows = []
    for k, n in enumerate((64, 1024, 4096)):
        w = thue_morse(n)
        rows += [(10 * k, w), (10 * k + 1, w.translate(str.maketrans("ab", "ba"))), (10 * k + 2, w.upper()), (10 * k + 3, f"x {w} y"), (10 * k + 4, f"x {w.translate(str.maketrans('ab', 'ba'))} y")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(frame(spark, rows)).collect()}
    assert got == {i: (1, i - 2 if i % 10 == 2 else i) for i, _ in rows}


def test_jaccard_signatures_that_meet(spark, monkeypatch):
    """Two sets of one signature are seen by their proofs, and all is done with another salt."""
    real = jaccard._signatures
    monkeypatch.setattr(jaccard, "_signatures", lambda h, first, salt: real(h, first, salt) if salt != 0 else np.diff(first) * 0)
    rows = [(1, "a b c d e"), (2, "f g h i j"), (3, "A b c d e"), (4, None)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


@pytest.mark.parametrize(("rows_a_task", "hot"), [(1000, 8 * 14), (20, 8 * 14), (20, 0)])
def test_jaccard_family_below_the_threshold(spark, monkeypatch, rows_a_task, hot):
    """Hundreds of sets under one rare token that resemble each other, few of which link; dealt to few and to many tasks."""
    for name, value in (("TOKEN_ROWS", rows_a_task), ("PARTNERS", max(1, rows_a_task // 10)), ("HOT_CLASS", hot)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(11)
    core = [f"c{i}" for i in range(180)]
    rows = [(i, " ".join([*core, *(f"t{i}x{k}" for k in range(24))])) for i in range(240)]
    for i in range(240, 300):
        near = rnd.randrange(240)
        w = rows[near][1].split()
        w[-1] = f"z{i}"
        rows.append((i, " ".join(w)))
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and 200 < len(set(got.values())) < 300


def test_gram_sets_of_a_long_text(monkeypatch):
    rnd = random.Random(13)
    text = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(9)) for _ in range(6000)).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    want = jaccard._gram_sets(data, offs)
    for size in (64, 1000, 30_000):
        monkeypatch.setattr(kernels, "SLICE_BYTES", size)
        monkeypatch.setattr(jaccard, "SLICE_BYTES", size)
        monkeypatch.setattr(jaccard, "word_windows", lambda d, a, b, m=size: kernels.word_windows(d, a, b, m))
        assert all(np.array_equal(x, y) for x, y in zip(jaccard._gram_sets(data, offs), want, strict=True))
        assert np.array_equal(quality.features(data, offs, size), quality.features(data, offs, 1 << 30))
    for odd in (b"x" * 5000, b" " * 3000, b"a b " + b" " * 4000 + b"c", b"a" * 3000 + b" b c d e f" + b" " * 500):
        one = jaccard._gram_sets(np.frombuffer(odd, np.uint8), np.array([0, len(odd)]))
        w = kernels.Words(np.frombuffer(odd, np.uint8), np.array([0, len(odd)]))
        assert np.array_equal(one[0], np.unique(kernels.shingles(w)[0]))


def removed_by_force(rows):
    out, by_id = [], {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                by_id[w] = min(by_id.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if i is not None and by_id[b[p : p + 50]] < i:
                cover[p] += 1
                cover[p + 50] -= 1
        c = np.cumsum(cover[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((-1 if i is None else i, len(b), int(c.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest()))
    return sorted(out)


def test_suffixes(spark, monkeypatch):
    for seed, slice_bytes in ((0, 2 << 20), (1, 3000)):
        monkeypatch.setattr(suffixes, "SLICE", slice_bytes)
        rows = corpus(seed)
        got = suffixes.deduplicated(frame(spark, rows)).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == removed_by_force(rows)
    assert suffixes.deduplicated(frame(spark, [])).count() == 0


def test_suffixes_copy_ahead_of_sharer(spark, monkeypatch):
    """A text in one slice; its exact copy, and a text of larger id that shares a passage with both, in another."""
    monkeypatch.setattr(suffixes, "SLICE", 3000)
    rnd = random.Random(4)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    lead = prose(400)
    rows = [(1, lead), (2, prose(2800)), (3, lead), (4, prose(200) + lead[100:300] + prose(200))]
    got = suffixes.deduplicated(frame(spark, rows).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == removed_by_force(rows)


def test_suffixes_in_many_buckets_and_of_long_texts(spark, monkeypatch):
    """Far more buckets than entries, texts longer than a slice, and texts that polynomial hashes can't tell apart."""
    rnd = random.Random(21)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    long, part = prose(9000), prose(120)
    word = thue_morse(4096)
    rows = [(5, long), (2, prose(700) + long[3900:4300] + prose(300)), (9, prose(50) + long[100:8800] + part), (11, part + prose(2500) + part), (12, long[4950:5050] + prose(10)), (3, word), (4, word.translate(str.maketrans("ab", "ba"))), (6, word[1000:1100]), (7, None)]
    monkeypatch.setattr(suffixes, "SLICE", 1000)
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 0.01)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 0.5)
    got = suffixes.deduplicated(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == removed_by_force(rows)


def test_common_prefixes():
    rnd = np.random.default_rng(2)
    text = rnd.integers(97, 99, 500).astype(np.uint8)
    text[200:300] = text[40:140]
    at = np.concatenate([rnd.integers(0, 450, 200), np.array([40, 200, 45, 205, 140, 300])])
    raw = text.tobytes()
    want = [next((k for k in range(50) if raw[a + k] != raw[b + k]), 50) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert suffixes.common_prefixes(text, at).tolist() == want and max(want) == 50


@pytest.mark.parametrize("top", [1, 2, 3, 255])
def test_suffix_array(top):
    rng = np.random.default_rng(top)
    t = rng.integers(1, top + 1, 600)
    t = np.concatenate([t, [0], t[50:300], [0], np.full(80, 2), [0], t[:70]]).astype(np.uint16)
    sa = suffixes.suffix_array(t)
    keys = [tuple(t[i : i + 50]) for i in sa]
    assert sorted(sa.tolist()) == list(range(len(t))) and all(a <= b for a, b in zip(keys, keys[1:], strict=False))
    assert len(suffixes.suffix_array(t[:0])) == 0


def test_decontaminate(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(30)).capitalize() + ".") for k in range(6)] + [(7, None), (8, "too short"), (9, "")]
    filler = lambda: " ".join(word() for _ in range(80))
    rows = [(0, filler()), (1, filler() + "\n" + items[0][1].upper() + " " + filler()), (2, None), (3, ""), (4, items[1][1])]
    edited = list(items[2][1])
    for p in range(10, len(edited), 25):
        edited[p] = "#z"
    rows += [(5, filler() + " " + "".join(edited)), (6, filler() + items[3][1].replace(" ", "  \n")), (7, items[4][1][: len(items[4][1]) // 8] + filler()), (8, filler() + items[5][1] + filler()), (8, filler() + items[5][1] + filler())]
    rows += [(9, "too short " + filler())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 0), (4, 1), (5, 2), (6, 3), (8, 5), (8, 5)]
    one = next(r for r in got if r["doc_id"] == 1)
    assert rows[1][1].encode()[one["start"] : one["end"]].decode().lower().startswith(items[0][1][:-1].lower()[:20])
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [0, 2, 3, 7, 9]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def test_decontaminate_runs_between_pieces_and_items_without_id(spark):
    rnd = random.Random(6)
    prose = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    item, other = prose(1000), prose(200)
    rows = [(a, f"{prose(70)} {item[a : a + 100 + a % 40]} {prose(90)}") for a in range(0, 860, 13)]
    rows += [(2000, f"{prose(300)} {item[333:383]} {prose(300)}"), (2001, prose(500)), (2002, prose(30) + " " + other), (2003, item[20:120]), (2004, None), (2005, item[:60]), (2006, item[60:140])]
    bench = spark.createDataFrame([(1, item), (2, item), (None, other)], "item_id long, text string")
    docs = frame(spark, rows).coalesce(1)
    got = decontaminate.contaminated(docs, bench).collect()
    hold = [a for a, _ in rows if a < 1000] + [2003]
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(a, k) for a in hold for k in (1, 2)]
    text = dict(rows)
    assert all(r["pieces"] >= 1 and r["edits"] == 0 and text[r["doc_id"]][r["start"] : r["end"]].strip().find(item[r["doc_id"] : r["doc_id"] + 100]) >= 0 for r in got if r["doc_id"] < 1000)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2000, 2001, 2004, 2005, 2006]


def test_decontaminate_short_items(spark):
    """Items too short for the q-gram bound, as whole words without edits."""
    rnd = random.Random(7)
    filler = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    items = [(1, "Zug um Zug!"), (2, "x"), (3, "zug um zug"), (4, "the forty-seven bytes of this item are no more"), (5, "?!"), (6, None), (None, "kontra")]
    rows = [(1, filler() + " ZUG,  um\nzug " + filler()), (2, "Zug um Zug"), (3, "Zugum Zug um Zuge"), (4, filler() + " x"), (5, filler() + "x " + filler()), (6, None), (7, ""), (8, filler() + "\n" + items[3][1] + "."), (9, "?!"), (10, "kontra")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = decontaminate.contaminated(docs, bench, least=1).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"], r["pieces"]) for r in got) == [(1, 1, 0, 1), (1, 3, 0, 1), (2, 1, 0, 1), (2, 3, 0, 1), (4, 2, 0, 1), (8, 4, 0, 1)]
    texts = dict(rows)
    assert {texts[r["doc_id"]][r["start"] : r["end"]].lower() for r in got if r["item_id"] in (1, 3)} == {"zug,  um\nzug", "zug um zug"}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, least=1).collect()) == [3, 5, 6, 7, 9]
    assert decontaminate.contaminated(docs, bench).count() == 0


def by_force(text, item):
    """Least edits of each of an item's pieces anywhere in the text, with the ends, by the full table."""
    norm = lambda t: decontaminate.normalised(np.frombuffer(t.encode(), np.uint8))
    (n, _), m = norm(text), np.frombuffer(norm(item)[0].tobytes().strip(), np.uint8)
    out = []
    for a in range(0, max(1, len(m) - 50), 50):
        a = max(0, min(a, len(m) - 100))
        p = m[a : a + 100]
        d = np.zeros(len(n) + 1, int)
        for i in range(len(p)):
            new = np.concatenate([[i + 1], np.minimum(d[:-1] + (n != p[i]), d[1:] + 1)])
            d = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        out.append((len(p) // 10, int(d.min())))
    exact = {m[k : k + 100].tobytes() for k in range(len(m) - 99)}
    return out, any(n[k : k + 100].tobytes() in exact for k in range(len(n) - 99))


@pytest.mark.parametrize("size", [250, 1 << 19])
def test_decontaminate_by_force(spark, monkeypatch, size):
    """Finds and non-finds against the full alignment table; edits on both sides of the budget, stretches of many sizes."""
    rnd = random.Random(size)
    letters = "abcde fghij"
    prose = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((60, 90, 100, 130, 160, 260, 420))]
    texts = []
    for k in range(48):
        part = list(items[k % 7][1][rnd.choice([0, 0, 20]) :])
        for _ in range(rnd.choice([0, 2, 5, 8, 10, 12, 16])):
            p = rnd.randrange(len(part))
            part[p : p + 1] = rnd.choice([[], ["q"], [part[p], "q"]])
        texts.append(prose(rnd.randrange(400)) + "".join(part) + prose(rnd.randrange(400)))
    want = {}
    for d, t in enumerate(texts):
        for k, item in items:
            pieces, exact = by_force(t, item)
            near = [e for most, e in pieces if e <= most]
            if near or exact:
                want[d, k] = 0 if exact else min(near)
    index = decontaminate.Index(items)
    monkeypatch.setattr(decontaminate, "SLICE", size)
    if size < 1000:
        monkeypatch.setattr(decontaminate, "PAIRS", 40)
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = index.search(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert {(g[0], g[1]): g[3] for g in got} == want and len(got) == len(want) > 20
    assert len(want) < 48 and all(e > 0 for e in want.values()) is False
    for row, item, _, edits, a, z in got:
        assert 0 <= a < z <= len(raw[row]) and z - a <= len(items[item][1]) + 2 * 10 + 2 and edits <= 10


def test_decontaminate_blocks_and_long_texts(spark, monkeypatch):
    """Many blocks, more than a worker keeps, over texts longer than a stretch."""
    rnd = random.Random(12)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    items = [(k, prose(150)) for k in range(30)]
    rows = [(k, prose(3000) + items[k % 30][1] + prose(2000 + 40 * k)) for k in range(40)] + [(99, None), (100, prose(9000))]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    want = [(k, k % 30) for k in range(40)]
    assert len(decontaminate.blocks(spark.createDataFrame(items, "item_id long, text string"))[1]) > 2 * decontaminate.BLOCKS_KEPT
    for held in (1 << 12, 1 << 25):
        monkeypatch.setattr(decontaminate, "HELD", held)
        got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    assert all(rows[r["doc_id"]][1][r["start"] : r["end"]].strip() == items[r["item_id"]][1].strip() for r in got if r["edits"] == 0 and r["pieces"] == 2)


def test_qgram_bound_loses_nothing():
    """Every window with at most e random edits is found."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(100))  # no spaces: losing a letter between two would count twice
    index = decontaminate.Index([(1, text)])
    e = int(index.edits[0])
    for trial in range(60):
        s = list(text)
        for _ in range(e):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["q"], [s[p], "q"]])
        body = ("zyx wvu " * 9 + "".join(s) + " zyx wvu" * rng.randrange(9)).encode()
        found = index.search(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
        assert [f[1] for f in found] == [1] and found[0][3] <= e, trial


def test_licences(spark):
    mit = "Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, "Prose here.\nLicensed under CC BY-NC 4.0."), (2, "x***\nThis work is licensed under the GNU General Public License, version 3. More"), (3, "Released under the MIT License."), (4, "Licensed under the Apache License, Version 2.0."),
        (5, mit), (6, "A licence to kill; permission denied."), (7, None), (8, ""), (9, "// SPDX-License-Identifier: BSD-3-Clause\ncode"), (3, "Released under the MIT License."), (10, "word " * 50_000 + "end. Released under the MIT License."),
    ]
    got = sorted((r["doc_id"], r["licence"], r["kind"], r["sentences"]) for r in licences.scanned(frame(spark, rows)).collect())
    assert got == [(1, "CC-BY-NC-4.0", "notice", 1), (2, "GPL-3.0", "notice", 1), (3, "MIT", "notice", 1), (3, "MIT", "notice", 1), (4, "Apache-2.0", "notice", 1), (5, "MIT", "part", 2), (9, "BSD-3-Clause", "tag", 1), (10, "MIT", "notice", 1)]
    assert licences.scanned(frame(spark, [])).count() == 0
    import re

    assert all(re.search(licences.TRIGGER, s) for s in licences.SENTENCES.values())
    assert {s for _, _, rule in licences.RULES for s in rule} <= set(licences.SENTENCES)


AS_PUBLISHED = {
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n",
    "mit.asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. ',
    "mit.liability": "IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n",
    "isc.asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. ',
    "isc.liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR\nANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES\nWHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION\nOF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN\nCONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.\n",
    "bsd.redistribute": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n",
    "bsd.source": "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n",
    "bsd.binary": "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n",
    "bsd.endorse": "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n",
    "bsd.asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. ',
    "apache.licensed": 'Licensed under the Apache License, Version 2.0 (the "License");\n',
    "apache.comply": "you may not use this file except in compliance with the License.\n",
    "apache.copy": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n",
    "apache.unless": 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n',
    "apache.see": "See the License for the specific language governing permissions and\nlimitations under the License.\n",
    "gpl.free2": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\n",
    "gpl.free3": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\n",
    "gpl.hope": "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  ",
    "gpl.see": "See the\nGNU General Public License for more details.\n",
    "mpl.form": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    "unlicense.public": "This is free and unencumbered software released into the public domain.\n",
    "cc0.waive": "To the extent possible under law, the author has waived all copyright and\nrelated or neighboring rights to this work.\n",
}


@pytest.mark.parametrize("rule", licences.RULES, ids=lambda r: f"{r[0]}-{r[1]}-{len(r[2])}")
def test_every_rule_from_published_text(rule):
    """Each rule from its text with its punctuation and lines: bare, after other prose, and as a block of comments."""
    licence, kind, names = rule
    body = "".join(AS_PUBLISHED[n] for n in names)
    for text in (body, "Some prose; more: prose.\n\n" + body + "\nMore prose."):
        got = licences.matched(licences.identified(text))
        assert [m[:3] for m in got] == [(licence, kind, len(names))]
        assert text[got[0][3] :].lstrip().startswith(body[:30])
    if licence.startswith(("GPL", "MPL")):
        comment = "/*\n * Copyright (C) 2020 A\n *\n" + "".join(f" * {x}\n" for x in body.splitlines()) + " */\nint x;"
        assert [m[:3] for m in licences.matched(licences.identified(comment))] == [(licence, kind, len(names))]


def test_licence_notices_over_lines_and_whole_expressions(spark):
    tag = "SPDX-License-Identifier: "
    rows = [
        (1, "Released\nunder CC0."), (2, "Released  under GPLv3."), (3, "# Released\n# under the GPLv3."), (4, tag + "MIT OR Apache-2.0\nword"), (5, f"/* {tag}(GPL-2.0-only WITH Linux-syscall-note) OR MIT */"), (6, f"<!-- ({tag}MIT) -->"),
        (7, f"{tag}( MIT  AND (ISC OR CC0-1.0) ) or so"), (8, tag + "MIT OR\nelse"), (9, tag + "BSD-3-Clause and more"), (10, tag + "MIT or Apache-2.0"),
    ]
    got = sorted((r["doc_id"], r["licence"], r["kind"]) for r in licences.scanned(frame(spark, rows)).collect())
    assert got == [
        (1, "CC0-1.0", "notice"), (2, "GPL-3.0", "notice"), (3, "GPL-3.0", "notice"), (4, "MIT OR Apache-2.0", "tag"), (5, "(GPL-2.0-only WITH Linux-syscall-note) OR MIT", "tag"), (6, "MIT", "tag"),
        (7, "(MIT AND (ISC OR CC0-1.0))", "tag"), (8, "MIT", "tag"), (9, "BSD-3-Clause", "tag"), (10, "MIT or Apache-2.0", "tag"),
    ]


def test_licences_in_linear_time():
    """Twice the sentences or tags, about twice the time."""
    import time

    def seconds(unit, n):
        began = time.process_time()
        got = licences.matched(licences.identified(unit * n))
        return time.process_time() - began, len(got)

    for unit, each in (("Released under the MIT License. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n", 1), ("SPDX-License-Identifier: MIT\nint x;\n\n", 1), (AS_PUBLISHED["bsd.redistribute"], 1)):
        few, many = seconds(unit, 2500), seconds(unit, 20_000)
        assert many[1] == 20_000 * each and many[0] < 30 * max(few[0], 0.05)


def test_rules_are_ordered():
    ids = lambda *names: [(k, k, k + 1, n) for k, n in enumerate(names)]
    two = ids("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.asis")
    three = ids("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")
    assert [m[0] for m in licences.matched(two)] == ["BSD-2-Clause"] and [m[0] for m in licences.matched(three)] == ["BSD-3-Clause"]
    assert [m[:2] for m in licences.matched(ids("bsd.source", "bsd.redistribute"))] == [("BSD", "part")]
    far = [(0, 0, 1, "mit.grant"), (9, 9, 10, "mit.notice")]
    assert [m[1:3] for m in licences.matched(far)] == [("part", 1)]


def test_quality(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice("the a of tree house walks river and slowly".split()) for _ in range(30)) + "."
    bad = lambda: " | ".join(rnd.choice("AA BB!! the house$$$".split()) for _ in range(20))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (902, "Z" * 200_000), (5, good()), (None, "x y")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    kept = quality.scored(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == len(rows)
    named = docs.withColumn("score", F.lit(7.0))
    few = quality.good(named, model)
    assert few.columns == named.columns and {r["score"] for r in few.collect()} == {7.0} and few.count() == sum(r["score"] >= 0.5 for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), none).count() == 0
    assert quality.train(docs, labels, most=7).weight.shape == (quality.DIM,)


def test_hinge_loss_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 20), rng.integers(1000, 1010, 3) + 20 * (k % 2)])) for k in range(200)]
    y = np.where(np.arange(200) % 2 == 0, 1, -1)
    w, b = quality.nb_svm(rows, y)
    assert all((w[r].sum() + b > 0) == (v > 0) for r, v in zip(rows, y, strict=True))


def test_token_ids(spark):
    from tokenizers import Tokenizer

    rows = corpus(4, 20) + [(6000, "a<|endoftext|>b <|startoftext|> C"), (6001, "Isn't it (fine)., OK!! ÀÉ, 12.5% é x　y"), (-(2**40), "low")]
    rows = [(i, t) for i, t in rows if i is not None]
    tok = Tokenizer.from_file(token_ids.vocabulary())
    manifest = token_ids.write_shards(frame(spark, rows), token_ids.vocabulary(), shard_ids=2000)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_ids.read_shards(manifest).collect()), key=lambda r: r[1])
    assert len(got) == len(rows) and manifest.count() > 2 and [g[0] for g in got] == sorted(i for i, _ in rows)
    at, by = 0, {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        by.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for doc, start, n, crc in got:
        assert start == at and (n, crc) in by[doc]
        at += n
    assert token_ids.read_shards(token_ids.write_shards(frame(spark, []), token_ids.vocabulary())).count() == 0


def test_token_ids_of_null_and_least_keys(spark):
    rows = [(None, "one two"), (-(2**63), "three"), (None, None), (4, "the end"), (-(2**63), "four five six")]
    got = sorted((tuple(r)[:3] for r in token_ids.read_shards(token_ids.write_shards(frame(spark, rows), token_ids.vocabulary(), shard_ids=3)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -(2**63), -(2**63), 4]
    assert sorted(r[2] for r in got[:2]) == [1, 3] and sorted(r[2] for r in got[2:4]) == [2, 4] and got[0][1] == 0


def test_token_ids_in_a_given_order(spark, tmp_path):
    """Shards in the order in which rows stand in a table, found by key all the same."""
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    rows = [(rnd.randrange(-3, 12), " ".join(["word", "of", "x"] * rnd.randrange(4)), k) for k in range(90)] + [(None, "none", 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").repartitionByRange(5, "file").sortWithinPartitions("file")
    docs.write.parquet(str(tmp_path / "t"))
    numbered, order = store.numbered(spark.read.parquet(str(tmp_path / "t")), "doc_id", "text", "file")
    assert [r["file"] for r in numbered.orderBy(*order).collect()] == list(range(91))
    manifest = token_ids.write_shards(numbered, token_ids.vocabulary(), shard_ids=40, order=order)
    got = sorted(token_ids.read_shards(manifest).collect(), key=lambda r: r["start"])
    tok, at = Tokenizer.from_file(token_ids.vocabulary()), 0
    for (doc, text, _), r in zip(rows, got, strict=True):
        n = len(tok.encode(text, add_special_tokens=False).ids) + 1
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, at, n)
        at += n


def test_word_memo_knows_its_tokenizer(tmp_path):
    """A tokenizer that keeps capitals, or has no separator, encodes whole texts."""
    import json

    assert token_ids.memo(token_ids.vocabulary()).by_word
    plain = json.load(open(token_ids.vocabulary(), encoding="utf-8"))
    plain["normalizer"] = None
    path = tmp_path / "t.json"
    path.write_text(json.dumps(plain))
    coder = token_ids.WordMemo(str(path))
    assert not coder.by_word
    ids, n = coder.encode(pa.array(["A Word, two", None]), 1)
    assert ids.tolist() == [*coder.tok.encode("A Word, two", add_special_tokens=False).ids, 1, 1] and n.tolist() == [len(ids) - 1, 1]


def test_word_memo_places_ids_in_parts():
    """Beside the ids and a few numbers a word, encoding holds the places of some ids only; a text encoded whole counts as a word."""
    coder, rnd = token_ids.memo(token_ids.vocabulary()), random.Random(3)
    words = ["".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(40)) for _ in range(50)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (30_000, 0, 1, 10_000)] + ["<| " + " ".join(words)]
    own = [coder.tok.encode(x, add_special_tokens=False).ids for x in words]
    coder.encode(pa.array(texts[:1]), 1)
    tracemalloc.start()
    ids, n = coder.encode(pa.array(texts[:4]), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known = dict(zip(words, own, strict=True))
    assert ids.tolist() == [x for t in texts[:4] for x in [*(i for w in t.split() for i in known[w]), 1]] and len(ids) == n.sum() > 1 << 19
    assert peak < 10 * len(ids)
    ids, n = coder.encode(pa.array([texts[4], None, *texts[1:3], texts[4]]), None)
    whole = coder.tok.encode(texts[4], add_special_tokens=False).ids
    assert ids.tolist() == [*whole, *known[texts[2]], *whole] and n.tolist() == [len(whole), 0, 0, len(known[texts[2]]), len(whole)]


def test_rows_of_the_driver_pass_no_python_worker(spark, tmp_path, monkeypatch):
    """Lists that Spark parallelizes start another Python daemon on every executor, which stays."""
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} word {i}", "s" if i % 3 else None) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    def refused(*_):
        raise AssertionError("rows pass Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    docs, labels = (store.table(spark, str(tmp_path), x) for x in ("documents", "labels"))
    assert quality.good(docs, quality.train(docs, labels)).count() > 0
    assert mixing.mixed(docs).count() == 40 and mixing.remixed(docs).count() > 0
    got = store.local(spark, [(1, "a", None), (None, None, 2.5)], "x long, y string, z double")
    assert got.dtypes == [("x", "bigint"), ("y", "string"), ("z", "double")] and [tuple(r) for r in got.orderBy("z").collect()] == [(1, "a", None), (None, None, 2.5)]
    assert store.local(spark, [], "x int, y string").count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**60), 2**60, 5000))
    mph = token_ids.PerfectHash.build(keys)
    assert sorted(mph.slot(keys).tolist()) == list(range(len(keys)))
    rows = np.repeat(keys[:50], 2)
    shard = token_ids.Shard(token_ids.index_bytes(rows, np.full(100, 3), 2), np.arange(300, dtype="<u2").tobytes())
    assert [x.tolist() for x in shard.get(int(keys[1]))] == [[6, 7, 8], [9, 10, 11]]
    absent = np.setdiff1d(np.arange(3000), rows)
    assert int(shard.locate(absent)[1].sum()) == 0


def test_registry():
    assert sorted(registry.QUERIES) == sorted(f"op{n}_{x}" for n, x in ((1, "licences"), (2, "quality"), (3, "media"), (4, "jaccard"), (5, "chat"), (6, "sharding"), (7, "decontaminate"), (8, "mixing"), (9, "token_ids"), (10, "suffixes")))


def test_pipeline(spark, tmp_path):
    """Each stage on its predecessor's rows, checked by what it promises."""
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, seen[-1], d)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k + 1 < len(cp.STAGES):
            assert seen[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    bad = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 0").collect()}
    assert len(ids[1] & bad) <= 0.1 * len(bad)
    texts = {r["doc_id"]: grams(r["text"]) for r in seen[2].collect()}
    items = list(texts.items())
    assert not any(s and u and 100 * len(s & u) >= 80 * len(s | u) for k, (_, s) in enumerate(items) for _, u in items[:k])
    assert decontaminate.contaminated(seen[3], spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert seen[5].count() == seen[4].count() and cp.run(spark, d).count() == seen[5].count()
    assert seen[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
