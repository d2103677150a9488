"""A corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before kept, from a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontaminate, jaccard, mixing, quality, store, token_ids

#: SQL can express neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1; it is fitted on the labelled ones among them."""
    model = quality.train(docs, store.table(spark, sf_dir, "labels"))
    return quality.good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each similarity component; documents without words or id stay."""
    found = jaccard.linked(docs).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no piece of a benchmark item."""
    return decontaminate.clean(docs, store.table(spark, sf_dir, "benchmark"), least=1)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its slots."""
    return mixing.remixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the id shards hold for each row; the shards keep the rows in the order of the table, which is the mix's."""
    rows, order = store.numbered(docs, "doc_id", "text")
    return token_ids.read_shards(token_ids.write_shards(rows, token_ids.vocabulary(), order=order))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_leaks),
    ("source mix", source_mix),
    ("token ids", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store.written(docs, f"stage{k}")
    return docs
