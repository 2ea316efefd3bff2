"""Shared folder tables, connected components and small guards."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only in local mode, where
    all share one machine, an unset name means a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark, "_loom_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        spark._loom_shared = own
    return own


#: Seconds between two calls that make the driver give back memory.
TRIM_EVERY = 2.0
_last_trim = 0.0


def trim_driver(spark: SparkSession) -> bool:
    """Make the driver's JVM give back native memory that it does not use; else its allocator keeps what compilers and many short-lived threads have freed.

    Whether the JVM can (Linux, Java 17.0.9 or later).
    """
    vm = spark.sparkContext._jvm
    try:
        # By reflection on the interface, as the server's own class is not exported.
        invoke = next(m for m in vm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(vm.java.lang.Object, 4)
        given[0], given[1] = vm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(vm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


class Workspace:
    """Written tables under the shared folder; they cut lineage and survive lost executors.

    The folder goes when the driver ends, after a failed run too, or earlier by close().
    """

    #: Folders of this process that are not closed yet, oldest first.
    live: list[Workspace] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"
        self._n = 0
        where, system = self._at(self.root)
        system.mkdirs(where)
        system.deleteOnExit(where)
        self.live.append(self)

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str = "t", hashes: bool = False) -> DataFrame:
        """Write df and read it again; ``hashes``: most columns are hashes, which neither a dictionary nor compression makes smaller."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.mode("overwrite").option("compression", "snappy" if hashes else "zstd")
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # else shuffle files stay until the driver happens to collect its garbage
        try:
            (writer.option("parquet.enable.dictionary", "false") if hashes else writer).parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        global _last_trim
        if time.monotonic() - _last_trim >= TRIM_EVERY:
            trim_driver(self.spark)
            _last_trim = time.monotonic()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() returned and that no later plan reads."""
        path = getattr(df, "_loom_path", None)
        if path is not None:
            where, system = self._at(path)
            system.delete(where, True)

    def close(self) -> None:
        """Delete the folder; nothing read from it may be used any more."""
        where, system = self._at(self.root)
        system.delete(where, True)
        if self in self.live:
            self.live.remove(self)


def freed(run: Callable) -> Callable:
    """run, a function of mapInArrow, after which the worker gives back memory that it does not use; idle workers otherwise keep the most that they ever had."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def is_empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0


def connected_components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node.

    Alternating star contraction: every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows.  Each round is a grouped
    minimum (combined before its shuffle, so a hub costs one row a task) and
    one join; rounds grow with the logarithm of the longest chain.  The edge
    table is written to the shared folder once a round.  Null ends are ignored;
    a self-link only makes its node appear.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = work.save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:  # every round at least halves the chains, so it ends
        # Large star: every larger neighbour of u is linked to the smallest node that u sees.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = links.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = work.save(up.where("u >= v").distinct(), "large")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        # Nodes that only point to themselves stay as such, so that none is lost.
        new = work.save(small.distinct().where("u > v or u = v"), "links")
        mark = new.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") > F.col("v")).cast("long"))
        ).first()
        for old in (links, large):
            work.drop(old)
        links = new
        if mark == before:
            break
        before = mark
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def byte_batches(items: list, limit: int):
    """Split a list of byte strings into runs of at most ``limit`` bytes (at least one item each); yields (start, end)."""
    start = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)
