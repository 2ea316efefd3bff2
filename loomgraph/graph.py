"""The graph value: two or three DataFrames that operators take and return."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    directed: bool = True
    commit: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes) -> Graph:
        return Graph(**{**self.__dict__, **changes})

    def cached(self) -> Graph:
        return self.with_(nodes=self.nodes.cache(), edges=self.edges.cache())


def hadoop_path(spark: SparkSession, path: str):
    """The path and the file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def tables_folder(spark: SparkSession) -> str:
    """This session's folder for tables, in the one that ``spark.checkpoint.dir`` names; it goes when the driver ends.

    Only in local mode, where all share one machine, an unset name means a temporary folder.
    """
    own = getattr(spark, "_loom_tables", None)
    if own is None:
        context = spark.sparkContext
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"{named.rstrip('/')}/loom-tables-{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix="loom-tables-")
        where, system = hadoop_path(spark, own)
        system.mkdirs(where)
        system.deleteOnExit(where)
        spark._loom_tables = own
    return own


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """The same rows from a table in the shared folder: a loop's plan stays short, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of ``cut`` before the driver ends."""
    for t in tables:
        where, system = hadoop_path(t.sparkSession, t._loom_path)
        system.delete(where, True)


def unique(df: DataFrame) -> DataFrame:
    """Rows of unique keys to join with: each task holds its share of them in a hash table, and the many rows that meet them are not sorted.

    Ids begin alike, so sorts by them compare whole texts.
    """
    return df.hint("shuffle_hash")


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).take(1)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """The rows with their place in an order as a long from 0: ranges of the order are numbered by themselves, then moved by the counts before them."""
    dealt = cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    # One row a range: this window is as small as the number of partitions.
    before = F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")
    starts = dealt.groupBy("range_").agg(F.count("*").alias("n_")).select("range_", before.alias("before_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1 + F.col("before_")
    return dealt.join(starts, "range_").withColumn(name, place).select(*df.columns, name)
