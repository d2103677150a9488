"""Sources and sinks: link lists, sitemaps, item exports, gated writes."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.html import RETRY
from loomstone.functions.jsonx import length_is
from loomstone.functions.text import present

#: The item's fields in export order; the one place that declares them.
ITEM = T.StructType([T.StructField(n, T.DoubleType() if n == "price" else T.StringType()) for n in ("title", "price", "currency", "availability", "category", "upc", "description", "product_url", "image_url")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this machine only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomstone-shared")
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Dealt:
    """A table in the shared folder, dealt by a key into as many files as there are shuffle partitions.

    Joins and groups by the key read `table` without an exchange. The catalog
    names it until forget(); the files stay.
    """

    def __init__(self, df: DataFrame, tag: str, key: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.name = f"{tag}_{uuid.uuid4().hex}"
        self.path = f"{shared(self.spark)}/{self.name}"
        df.write.format("parquet").bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", self.path).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def forget(self) -> None:
        self.spark.sql(f"drop table if exists `{self.name}`")


# --- sources ----------------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of one text file, in file order. Link lists are small files, so each is one row first."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def links(lines: DataFrame) -> DataFrame:
    """line_no, section, url, annotation of a sectioned link list (line_no, value).

    A line of = or - only is a rule; a line with a URL is an entry, with what
    stands after `for` as its annotation; any other line is a heading. Entries
    before the first heading are left out.
    """
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").rlike(r"^[=\-]+$"))
    url = present(F.regexp_extract("line", r"(https?://\S+)", 1))
    rows = rows.withColumn("url", url).withColumn("head", F.when(F.col("url").isNull(), F.col("line")))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    rest = F.regexp_extract("line", r"https?://\S+\s*(.*)$", 1)
    note = F.coalesce(present(F.trim(F.regexp_extract(rest, r"^for \(([^)]*)\) ?(?:search)?$", 1))), present(F.trim(F.regexp_extract(rest, r"^for ([^(].*?) ?(?:search)?$", 1))))
    rows = rows.withColumn("section", F.last("head", ignorenulls=True).over(w))
    return rows.where("url is not null and section is not null").select("line_no", "section", "url", note.alias("annotation"))


def pattern_lines(lines: DataFrame) -> DataFrame:
    """name, regex of `name: regex` lines."""
    part = F.split("value", ": ", 2)
    return lines.where(F.trim("value") != "").select(F.get(part, F.lit(0)).alias("name"), F.get(part, F.lit(1)).alias("regex"))


def drift(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """name, problem: patterns that differ between two registries, or that one of them lacks."""
    a, b = expected.select("name", F.col("regex").alias("a"), F.lit(1).alias("l")), listed.select("name", F.col("regex").alias("b"), F.lit(1).alias("r"))
    what = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unknown").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, "name", "full_outer").select("name", what.alias("problem")).where("problem is not null")


def case_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, url) cases of `kind url` lines, and the lines that are no case."""
    rows = lines.select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))
    part = F.split("line", r"\s+", 2)
    good = F.size(part) == 2
    return rows.where(good).select(F.get(part, F.lit(0)).alias("kind"), F.trim(F.get(part, F.lit(1))).alias("url")), rows.where(~good)


def locations(xml: Column) -> Column:
    """The <loc> values of a sitemap, entities decoded; <image:loc> is not among them."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def first_product_map(xml: Column) -> Column:
    return F.get(F.filter(locations(xml), lambda x: x.contains("sitemap_products_")), F.lit(0))


def product_maps(xml: Column, include: str = r"/sitemap_products_\d+\.xml") -> Column:
    return F.filter(locations(xml), lambda x: x.rlike(include))


def product_count(xml: Column) -> Column:
    return F.size(F.filter(locations(xml), lambda x: x.contains("/products/")))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc, lastmod of the entries of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod date").load(path)


def newer(entries: DataFrame, than) -> DataFrame:
    """Entries changed after a date."""
    return entries.where(F.col("lastmod") > F.lit(than))


def paged_items(responses: DataFrame, stop_when: str = "$.products length == 0") -> DataFrame:
    """source, page, pos, item: items of stored pages (source, page, body), up to each source's first page that says stop.

    A page that is null or can't be read has no items and stops nothing: the
    pages after it count.
    """
    items = responses.select("source", "page", F.from_json("body", "products array<string>")["products"].alias("items"), length_is("body", stop_when).alias("last"))
    stop = items.where("last").groupBy("source").agg(F.min("page").alias("stop"))
    live = items.join(stop, "source", "left").where(F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    return live.select("source", "page", F.posexplode("items").alias("pos", "item"))


def limited(items: DataFrame, most: int) -> DataFrame:
    """At most so many items, any of them, as a crawl that stops by count."""
    return items.limit(most)


@dataclass(frozen=True)
class FetchSettings:
    """How stored pages were, or are to be, fetched; read from a config, nothing here fetches."""

    user_agent: str = ""
    obey_robots: bool = True
    timeout: float = 30.0
    delay: float = 0.25
    concurrency: int = 8
    autothrottle: bool = True
    retries: int = 3
    retry_statuses: tuple[int, ...] = RETRY
    item_limit: int | None = None

    @classmethod
    def of(cls, config: dict) -> FetchSettings:
        """The settings that a config names; others keep their defaults, unknown names raise."""
        unknown = set(config) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in config.items()})

    def again(self, status: Column, tries: Column) -> Column:
        """Is a response worth another try?"""
        return F.coalesce(status.isin(*self.retry_statuses) & (tries <= self.retries), F.lit(False))


def throttled(spark: SparkSession, path: str, schema: str, files: int) -> DataFrame:
    """A stream of stored pages that takes in at most so many files at a time, as slow readers need it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


# --- sinks ------------------------------------------------------------------

def items(df: DataFrame, schema: T.StructType = ITEM) -> DataFrame:
    """df in the schema's columns, order and types; columns it lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def export(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite", schema: T.StructType = ITEM) -> None:
    """Write items as json (one object a line, nulls said), csv, xml or parquet."""
    w = items(df, schema).write.mode(mode)
    if kind == "json":
        w.option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    elif kind == "xml":
        w.format("xml").option("rootTag", "items").option("rowTag", "item").option("nullValue", "").save(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown kind: {kind}")


def gated_export(df: DataFrame, path: str, verdicts, kind: str = "json") -> bool:
    """Write beside path, judge what was written, and move it there only if no verdict failed.

    verdicts: a function from the written items to DataFrames with a boolean
    column failed. A failed run leaves the last good data as they are.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    export(df, staged, "parquet")
    got = spark.read.parquet(staged)
    ok = all(v.where("failed").isEmpty() for v in verdicts(got))
    if ok:
        export(got, path, kind)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return ok


def read_items(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Items of a JSON export; array: files that hold one JSON array."""
    return spark.read.schema(ITEM).option("multiLine", array).json(path)
