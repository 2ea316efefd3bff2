"""Compositions: clustering with its repairs, analysis bundles, merged and global graphs, revisions, refined forecasts, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, cut, numbered
from ..sources.store import read_json, read_store, replace_repo
from . import analytics, community, history, setops
from .primitives import degree
from .traversal import resolve

#: Communities above this share of the nodes are split again, as are large loose ones.
OVERSIZE, LOOSE, LOOSE_SIZE = 0.25, 0.05, 50


def cluster(g: Graph, hub_percentile: float | None = None, resolution: float = 1.0) -> DataFrame:
    """(id, community): hubs above a degree percentile are left out and join most of their neighbours' community;
    communities that are too large or too loose are clustered once more by themselves; numbered by size."""
    inner = g
    if hub_percentile is not None:
        d = degree(g.edges)
        limit = d.agg(F.percentile("degree", hub_percentile)).first()[0]
        hubs = d.where(F.col("degree") > limit).select("id")
        rest = g.nodes.join(hubs, "id", "left_anti").select(*g.nodes.columns)
        ids = rest.select("id")
        inner = g.with_(nodes=rest, edges=g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*g.edges.columns))
    labels = cut(community.cluster(inner, resolution).drop("approximate").withColumn("community", F.col("community").cast("int")), "labels")
    marked = inner.with_(nodes=inner.nodes.drop("community").join(labels, "id"))
    total = labels.count()
    wide = analytics.cohesion(marked).where((F.col("size") > OVERSIZE * total) & (F.col("size") > 10) | (F.col("size") >= LOOSE_SIZE) & (F.col("cohesion") < LOOSE)).select("community")
    members = labels.join(wide, "community", "left_semi")
    if members.limit(1).take(1):
        names = labels.select("id", F.col("community").alias("c"))
        e = marked.edges.join(names.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select(*marked.edges.columns)
        own = members.select("id")
        e = e.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(*marked.edges.columns)
        again = community.cluster(inner.with_(nodes=inner.nodes.join(own, "id", "left_semi"), edges=e), resolution * 2).drop("approximate").withColumn("community", F.col("community").cast("int") + total)
        labels = cut(labels.join(own, "id", "left_anti").select("id", "community").unionByName(again), "labels")
    if hub_percentile is not None:
        lacking = g.with_(nodes=g.nodes.drop("community").join(labels, "id", "left"))
        labels = labels.unionByName(analytics.local_assignment(lacking, 2))
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    number = numbered(sizes, "new", F.desc("n"), F.col("first")).select("community", "new")
    return labels.join(number, "community").select("id", F.col("new").alias("community"))


def analysis(g: Graph) -> dict[str, DataFrame]:
    """The usual bundle: ten hubs, five surprises, seven questions, twenty file cycles."""
    files = analytics.file_graph(g, ["imports", "imports_from", "uses", "calls"])
    return {"gods": analytics.god_nodes(g, 10), "surprises": analytics.surprising(g, 5), "questions": analytics.questions(g, 7), "cycles": analytics.cycles(files, 5, 20)}


def bridging_links(g: Graph, n: int = 5, most: int = 5000) -> DataFrame:
    """Links of the highest edge betweenness; nothing for graphs above a size."""
    if g.nodes.count() > most:
        return g.spark.createDataFrame([], "a string, b string, value double")
    return community.betweenness(g, edges=True).orderBy(F.desc("value"), "a", "b").limit(n)


def merge_files(spark: SparkSession, paths: list[str]) -> Graph:
    """Graph files under tags from their names; equal tags get -2, -3 and so on."""
    parts: dict[str, Graph] = {}
    for path in paths:
        base = tag = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json")
        k = 2
        while tag in parts:
            tag, k = f"{base}-{k}", k + 1
        parts[tag] = read_json(spark, path)
    return setops.compose(parts, dedup=False)


def global_add(root: str, tag: str, g: Graph, known_digest: str | None = None) -> str | None:
    """Adds or replaces one repo of a store; returns its digest, None if it is the known one already."""
    tagged = setops.prefix(g, tag)
    digest = setops.shard_digest(tagged).where(F.col("shard") == tag).first().digest
    if digest == known_digest:
        return None
    replace_repo(tagged, root, tag)
    return digest


def revision_report(spark: SparkSession, old_root: str, new_root: str) -> dict[str, DataFrame]:
    """What changed between two stored revisions: topology, module dependencies, removed interfaces, drift."""
    a, b = read_store(spark, old_root, bridge=True), read_store(spark, new_root, bridge=True)
    return {"diff": analytics.graph_diff(a, b), "dependencies": history.dependency_delta(a, b), "removed": history.removed_interfaces(a, b), "drift": history.drift(a, b)}


def refine_risk(features: DataFrame, numstat: DataFrame) -> DataFrame:
    """Risk with the churn of the files (file, added, deleted) put in.  features: file and the other features."""
    churn = numstat.groupBy(F.col("path").alias("file")).agg(F.sum(F.col("added") + F.col("deleted")).alias("lines"))
    return history.risk(features.join(churn, "file", "left").withColumn("churn", F.coalesce("lines", F.lit(0))).drop("lines"))


def edit_target(g: Graph, name: str) -> str:
    """The one real definition of a name (or name@file); an error names the candidates."""
    real = g.with_(nodes=g.nodes.where("source_file <> ''"))
    how, ids = resolve(real, name)
    if how != "unique":
        raise ValueError(f"{name} is {how}: {', '.join(ids[:10])}")
    return ids[0]


def federated_forecast(g: Graph, seeds: list[str], depth: int = 3) -> DataFrame:
    """(repo, id, depth, via): impact that stays inside the repos of the seeds; one walk over links that do not cross."""
    from .traversal import affected

    inside, _ = setops.split_shards(g)
    hit = affected(g.with_(edges=inside.drop("shard")), seeds, depth)
    return hit.join(g.nodes.select("id", "repo"), "id").select("repo", "id", "depth", "via").orderBy("repo", "depth", "id")


def notes(g: Graph) -> DataFrame:
    """(path, text): one Markdown note a node with links to its neighbours, for note-taking programs."""
    e = g.edges.select(F.col("src").alias("id"), F.concat(F.lit("- "), "relation", F.lit(" [["), "dst", F.lit("]]")).alias("line")).distinct()
    lines = e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    name = F.concat(F.regexp_replace("id", r'[\\/:*?"<>|]', "_"), F.lit(".md"))
    return g.nodes.join(lines, "id", "left").select(name.alias("path"), F.concat(F.lit("# "), "label", F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))

