"""Reply trees to conversations.

Messages know their parent. Self-joins that double their reach enumerate the
paths from leaf to root: a jump table leads to the ancestor 2**k above, and each
round adds to every path the ancestors that far above its messages. Paths are
ranked within their tree by the mean score of their messages, and each chosen
path is formatted as one conversation.

A turn is written `### role: text</turn>` and a line feed. Inside roles and
texts a backslash stands before every backslash, `#` and `<`, and in roles
before `:` too, so no text can form a mark, and reading back is exact. The loss
mask is the list of stretches that hold assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import store

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
TRICKY = (-7, "\\### Assistant: </turn> ok")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, above: for every leaf, its ancestors and how far above they are, itself included.

    messages: tree, node, parent. A parent that is null or absent makes a root.
    Replies that form a cycle have no root and raise.
    """
    key = messages.select("tree", "node")
    up = messages.where("parent is not null").select("tree", "node", F.col("parent").alias("up")).join(key.withColumnRenamed("node", "up"), ["tree", "up"], "left_semi")
    jump = store.written(up.select("tree", "node", "up"), "reply-jumps")
    leaves = key.join(jump.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    have = store.written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "reply-paths")
    most, reach = key.count(), 1
    while not jump.isEmpty():
        if reach > 2 * most:
            raise ValueError("replies form a cycle")
        far = have.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + reach).alias("above"))
        have = store.written(have.unionByName(far), "reply-paths")
        nxt = jump.withColumnRenamed("up", "mid").join(jump.select("tree", F.col("node").alias("mid"), "up"), ["tree", "mid"])
        jump, reach = store.written(nxt.select("tree", "node", "up"), "reply-jumps"), 2 * reach
    return have


def escaped(c, also: str = ""):
    return F.regexp_replace(c, r"([\\#<" + also + "])", r"\\$1")


def formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, score, formatted, mask: the best-ranked paths of each tree as conversations.

    messages: tree, node, parent, role, text, score. Null texts and roles count
    as empty, null scores as 0. Equal scores are ranked by leaf. Rows that repeat a (tree, node) count
    once, the first by role and text. mask holds the stretches [start, end) of
    code points that are learned.
    """
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*")
    rows = store.written(rows, "reply-messages")
    lines = paths(rows).join(rows.drop("parent"), ["tree", "node"])
    turn = F.struct((-F.col("above")).alias("at"), "role", "text")
    whole = lines.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))  # a path is one output row
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    whole = whole.withColumn("rank", rank).where(F.col("rank") <= best)
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(HEAD), escaped(t["role"], ":"), F.lit(COLON)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learn")))
    whole = whole.withColumn("parts", parts).withColumn("formatted", F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL)))))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(TAIL)).alias("at"),
        F.when(p["learn"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["mask"]).alias("mask"),
    )
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    mask = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,end:int>>")).alias("mask")), step)["mask"]
    return whole.select("tree", "leaf", "rank", "score", "formatted", mask.alias("mask"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted text and its mask hold: conv_id, n_turns, digests and lengths.

    conv_id is the tree as a number, null where it is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parsed(text)
                h = hashlib.sha256()
                for role, body in turns:
                    h.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in mask)
                out.append((conv, len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return chats.select(F.col("tree").try_cast("long").alias("tree"), "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def replies(conversations: DataFrame, as_text: bool = False) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn (then role, then text).

    Rows of one conversation and turn follow each other; so do rows that are
    the same. A null conv_id is a conversation of its own: as_text, trees are
    named by the digits of their ids, and it by none, so that read_back gives it
    back as null; else trees are numbers, and it is the smallest of them.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text")
    tree = F.coalesce(F.col("tree").cast("string"), F.lit("")) if as_text else F.coalesce("tree", F.lit(-(2**63)))
    rows = rows.withColumn("tree", tree).withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, text = TRICKY
    extra = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, LEARNED, text)], "conv_id long, turn long, role string, text string")
    rows = store.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = store.written(formatted(replies(rows, as_text=True)), "chats")
    return read_back(chats)
