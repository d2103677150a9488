"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this machine only in a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomstone-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's.

    They go as Arrow: a list would pass Python workers of another daemon, which
    stays on each executor beside that of the functions.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))
    cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)]
    return spark.createDataFrame(pa.Table.from_arrays(cols, schema=kind), schema)


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() whose readers have all been written themselves."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, _PATHS.pop(t, None)
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def numbered(table: DataFrame, *columns: str) -> tuple[DataFrame, tuple[str, str]]:
    """Columns of a Parquet table and the names of two more, by which its rows stand as they were written."""
    at = table.metadataColumn("_metadata")
    file, row = (next(x for k in range(len(columns) + 1) if (x := f"{c}_{k}") not in columns) for c in ("file", "row"))
    return table.select(*(F.col(f"`{c}`") for c in columns), at["file_name"].alias(file), at["row_index"].alias(row)), (file, row)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(file system, path) of a URI, for the files that are not Spark tables."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
