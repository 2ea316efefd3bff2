"""Graph files: node-link JSON documents and a partitioned Parquet store with one folder a repo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..operators.setops import split_shards
from ..schemas import file_type

#: Refused unless forced: bytes of a JSON document and nodes of a loaded graph.
MOST_BYTES, MOST_NODES = 50 << 20, 100_000


def path_size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength()


def read_json(spark: SparkSession, path: str, force: bool = False) -> Graph:
    """A node-link document (links or edges); unknown keys go to `extra`, dangling links are dropped, later nodes of an id win."""
    if not force and path_size(spark, path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes; pass force=True")
    doc = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    text = lambda name, at="x": F.get_json_object(at, f"$.{name}")
    strings = "array<string>"
    nodes = doc.select(F.posexplode(F.from_json(F.get_json_object("v", "$.nodes"), strings)).alias("seq", "x"))
    span = F.from_json(text("span"), "struct<start_line:int,start_col:int,end_line:int,end_col:int>")
    n = nodes.select(
        text("id").alias("id"), text("label").alias("label"), file_type(text("file_type")).alias("file_type"), F.coalesce(text("source_file"), F.lit("")).alias("source_file"), text("source_location").alias("source_location"),
        text("community").cast("int").alias("community"), text("repo").alias("repo"), text("kind").alias("kind"), text("visibility").alias("visibility"), span.alias("span"), F.col("x").alias("extra"), F.col("seq").cast("long").alias("seq"),
    )
    from ..operators.build import drop_dangling, upsert_nodes

    n = upsert_nodes(n)
    links = F.coalesce(F.get_json_object("v", "$.links"), F.get_json_object("v", "$.edges"))
    e = doc.select(F.posexplode(F.from_json(links, strings)).alias("seq", "x")).select(
        text("source").alias("src"), text("target").alias("dst"), text("relation").alias("relation"), F.coalesce(text("confidence"), F.lit("EXTRACTED")).alias("confidence"), text("context").alias("context"),
        F.coalesce(text("weight").cast("double"), F.lit(1.0)).alias("weight"), text("source_file").alias("source_file"), text("source_location").alias("source_location"), F.col("x").alias("extra"), F.col("seq").cast("long").alias("seq"),
    )
    h = doc.select(F.explode(F.from_json(F.get_json_object("v", "$.hyperedges"), strings)).alias("x")).select(
        text("id").alias("id"), text("label").alias("label"), F.from_json(text("nodes"), strings).alias("nodes"), text("relation").alias("relation"), text("confidence").alias("confidence")
    )
    head = doc.select(F.get_json_object("v", "$.directed").alias("d"), F.get_json_object("v", "$.built_at_commit").alias("c")).first()
    return Graph(n, drop_dangling(e, n), h, directed=(head.d or "true") == "true", commit=head.c)


def write_store(g: Graph, root: str) -> None:
    """Parquet by repo: nodes/repo=..., edges/repo=... for links inside a repo, bridge for links across."""
    inside, bridge = split_shards(g)
    _write_schemas(g, root, "overwrite")
    g.nodes.withColumn("repo", F.coalesce("repo", F.lit("local"))).write.partitionBy("repo").mode("overwrite").parquet(f"{root}/nodes")
    inside.withColumnRenamed("shard", "repo").write.partitionBy("repo").mode("overwrite").parquet(f"{root}/edges")
    bridge.write.mode("overwrite").parquet(f"{root}/bridge")


def _write_schemas(g: Graph, root: str, mode: str) -> None:
    """Empty tables that keep the schemas, as a folder by repo without any rows has no file."""
    for part, df in (("nodes", g.nodes), ("edges", g.edges)):
        df.limit(0).coalesce(1).write.mode(mode).parquet(f"{root}/schemas/{part}")


def read_store(spark: SparkSession, root: str, repo: str | None = None, bridge: bool = False) -> Graph:
    """All repos or one (only its folders are read), with or without the links across."""
    n, e = (spark.read.schema(_by_repo(spark.read.parquet(f"{root}/schemas/{p}").schema)).parquet(f"{root}/{p}") for p in ("nodes", "edges"))
    if repo is not None:
        n, e = n.where(F.col("repo") == repo), e.where(F.col("repo") == repo)
    e = e.drop("repo")
    if bridge and repo is None:
        e = e.unionByName(spark.read.parquet(f"{root}/bridge"))
    return Graph(n, e)


def _by_repo(schema: T.StructType) -> T.StructType:
    """With the repo of the folder as a string, whatever it looks like."""
    return T.StructType([f for f in schema if f.name != "repo"] + [T.StructField("repo", T.StringType())])


def replace_repo(g: Graph, root: str, repo: str) -> None:
    """Rewrites the folders of one repo only."""
    one = g.nodes.where(F.coalesce("repo", F.lit("local")) == repo).drop("repo")
    inside, _ = split_shards(g)
    _write_schemas(g, root, "ignore")
    one.write.mode("overwrite").parquet(f"{root}/nodes/repo={repo}")
    inside.where(F.col("shard") == repo).drop("shard").write.mode("overwrite").parquet(f"{root}/edges/repo={repo}")


def prune_repo(spark: SparkSession, root: str, repo: str) -> None:
    jvm = spark.sparkContext._jvm
    for part in ("nodes", "edges"):
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/{part}/repo={repo}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Immutable JSON records by id; an id with two different contents is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    clash = rows.groupBy("id").agg(F.count_distinct(F.xxhash64(F.to_json(F.struct(*rows.columns)))).alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"record {clash[0].id} has conflicting contents")
    return rows.dropDuplicates(["id"])
