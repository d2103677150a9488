"""WebP round trips and chat formatting."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from loomstone.llm import chat, media, webp


def test_files_of_other_encoders():
    assert webp.decode([base64.b64decode("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")])[0].tolist() == [[0xFFFFFFFF]]
    assert webp.decode([base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")])[0].shape == (1, 1)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 1), (19, 23)])
def test_round_trips(shape):
    rng = np.random.default_rng(shape[1])
    h, w = shape
    grey = lambda k: (rng.integers(0, k, shape).astype(np.uint32) * 0x01030507)
    bh, bw = (h + 3) // 4, (w + 3) // 4
    files, want = [], []
    for a in (rng.integers(0, 2**32, shape, dtype=np.uint32), grey(2), grey(4), grey(16), grey(17), grey(200) | np.uint32(0xFF000000)):
        steps = [(), (("green",),), (("predict", 2, rng.integers(0, 14, (bh, bw))), ("cross", 2, rng.integers(0, 2**24, (bh, bw), dtype=np.uint32)), ("green",))]
        steps += [(("predict", 2, np.full((bh, bw), m)),) for m in range(14)]
        if len(np.unique(a)) <= 256:
            steps.append((("palette",),))
        for s in steps:
            files.append(webp.encode(a, s))
            want.append(a)
        for more in ({"cache_bits": 1}, {"cache_bits": 11}, {"reach": 4000}, {"cache_bits": 5, "reach": 300}, {"meta": (2, rng.integers(0, 3, (bh, bw)))}):
            files.append(webp.encode(a, **more))
            want.append(a)
    got = webp.decode(files)  # all in lockstep
    assert all(np.array_equal(g, a) for g, a in zip(got, want, strict=True))


def test_damaged_files():
    good = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"", b"RIFF", b"x" * 40, good[:8] + b"JUNK" + good[12:]):
        with pytest.raises(ValueError):
            webp.decode([bad])


def test_media(spark):
    texts = [None, "", "a", "é" * 500, "x" * 576, "word " * 9000, "ab" * 300, "".join(chr(i) for i in range(1, 400)), "a"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in media.read_back(media.stored(docs)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2][1:] == got[8][1:] and got[0][1:] == got[1][1:]
    assert media.read_back(media.stored(docs.limit(0))).count() == 0


TREE = [
    # tree, node, parent, role, text, score
    (1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "low", 0.0), (1, 3, 1, "assistant", "high", 2.0), (1, 4, 3, "user", None, 1.0), (1, 5, 4, "assistant", "end", None), (1, 5, 4, "assistant", "end", None),
    (2, 9, 77, "user", "orphan", 0.5), (3, 1, None, None, "\\# </turn> ### a: b\\", 0.0), (3, 2, 1, "assist:ant", "x", 0.0),
]


def test_reply_trees(spark):
    rows = spark.createDataFrame(TREE, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r for r in chat.formatted(rows, best=2).collect()}
    assert chat.parsed(got[1, 1]["formatted"]) == [("user", "hi"), ("assistant", "high"), ("user", ""), ("assistant", "end")]
    assert got[1, 1]["score"] == 1.0 and [got[1, 1]["formatted"][m["start"] : m["end"]] for m in got[1, 1]["mask"]] == ["high", "end"]
    assert chat.parsed(got[1, 2]["formatted"]) == [("user", "hi"), ("assistant", "low")]
    assert chat.parsed(got[2, 1]["formatted"]) == [("user", "orphan")]
    assert chat.parsed(got[3, 1]["formatted"]) == [("", "\\# </turn> ### a: b\\"), ("assist:ant", "x")] and got[3, 1]["mask"] == []
    assert chat.formatted(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([(1, 1, None), (1, 2, 3), (1, 3, 2), (1, 4, 3)], "tree long, node long, parent long"))


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 5, "assistant", "é\n### x"), (None, 0, "user", "z"), (3, None, None, "q"), *((4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(70))]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.replies(conv))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, -(2**63): 1, 3: 1, 4: 70}
    assert got[2]["loss_chars"] == 7 and got[1]["loss_chars"] == 0
    assert got[4]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 4).encode()).hexdigest()


def test_pixels_of_a_column(spark):
    """Every image of the stored bytes as an array: all kinds of transforms, several files in a row, nulls."""
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 2**32, (3, 5), dtype=np.uint32), np.full((2, 2), 0xFF00FF00, np.uint32), rng.integers(0, 9, (17, 19)).astype(np.uint32) * np.uint32(0x01010101)]
    files = [webp.encode(images[0], (("green",),)), webp.encode(images[1], (("palette",),)), webp.encode(images[2], cache_bits=4, reach=300)]
    rows = [(1, files[0]), (2, files[1] + files[2]), (3, None), (4, b""), (None, files[1]), (1, files[0])]
    got = media.pixels(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    want = [(1, 0, 0), (2, 0, 1), (2, 1, 2), (None, 0, 1), (1, 0, 0)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    shown = sorted((r["doc_id"], r["image"], r["width"], r["height"], tuple(r["pixels"])) for r in got if r["doc_id"] is not None) + [tuple(r)[:4] + (tuple(r["pixels"]),) for r in got if r["doc_id"] is None]
    assert shown == [(d, k, images[i].shape[1], images[i].shape[0], tuple(images[i].reshape(-1).view(np.int32).tolist())) for d, k, i in sorted(want, key=key)]
    assert media.pixels(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_conversations_long_and_none(spark):
    rows = [(6, 0, "user", "a"), (7, 0, "assistant", "long " * 50_000)]
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.formatted(chat.replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got == {6: (1, 0), 7: (1, 250_000)}
    assert chat.read_back(chat.formatted(chat.replies(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def test_conversations_without_an_id(spark, tmp_path):
    """A null conv_id comes back as null, and apart from the smallest number that an id can be."""
    rows = [(None, 1, "assistant", "n"), (None, 0, "user", "z"), (-(2**63), 0, "assistant", "min"), (2**63 - 1, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    assert got == {None: (2, 1), -(2**63): (1, 3), 2**63 - 1: (1, 0), -7: (2, len(chat.TRICKY[1]))}
