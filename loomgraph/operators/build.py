"""Assembling graphs: identities, upserts, merged provenance, ghost remaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


def edge_key(directed: bool = True) -> list[Column]:
    """Identity of a link: its ends (ordered if undirected), relation and context."""
    if directed:
        return [F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("relation"), F.col("context")]
    return [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("relation"), F.col("context")]


def assemble_edges(links: DataFrame, directed: bool = True) -> DataFrame:
    """Links of equal identity become one: the first by seq gives confidence and weight, n_sites counts them.

    One hash aggregate with a combine before the shuffle; null contexts are equal.
    """
    keyed = links.select(*edge_key(directed), "confidence", "weight", "seq")
    first = F.struct("seq", "confidence", "weight")
    out = keyed.groupBy("src", "dst", "relation", "context").agg(F.min(first).alias("f"), F.count("*").alias("n_sites"))
    return out.select("src", "dst", "relation", "context", "f.confidence", "f.weight", "n_sites")


def merge_sites(links: DataFrame, directed: bool = True) -> DataFrame:
    """Union of the distinct sites (file, location) of each identity, in first-seen order."""
    keyed = links.select(*edge_key(directed), "seq", F.struct("source_file", "source_location").alias("site"))
    seen = keyed.groupBy("src", "dst", "relation", "context", "site").agg(F.min("seq").alias("seq"))
    ordered = seen.groupBy("src", "dst", "relation", "context").agg(F.array_sort(F.collect_list(F.struct("seq", "site"))).alias("s"))
    return ordered.select("src", "dst", "relation", "context", F.transform("s", lambda x: x.site).alias("sites"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """Last row of an id wins, but a stub without a file never replaces a located node; the first-seen position stays."""
    located = F.coalesce(F.col("source_file"), F.lit("")) != ""
    best = Window.partitionBy("id").orderBy(located.desc(), F.desc("seq"))
    marked = nodes.withColumn("first_seq", F.min("seq").over(Window.partitionBy("id"))).withColumn("rank", F.row_number().over(best))
    return marked.where("rank = 1").drop("rank", "seq").withColumnRenamed("first_seq", "seq")


def ghost_map(nodes: DataFrame) -> DataFrame:
    """(ghost, id): a node without AST origin stands for the located one of equal base name of its file and equal label."""
    base = F.element_at(F.split("source_file", "/"), -1)
    keyed = nodes.select("id", "origin", "seq", base.alias("base"), F.trim("label").alias("name")).where("base <> '' and name <> ''")
    canonical = keyed.where("origin = 'ast'").groupBy("base", "name").agg(F.min_by("id", F.struct("seq", "id")).alias("to"))
    ghosts = keyed.where("origin is null or origin <> 'ast'")
    return ghosts.join(canonical, ["base", "name"]).where("id <> to").select(F.col("id").alias("ghost"), F.col("to").alias("id"))


def rewire(edges: DataFrame, renames: DataFrame, old: str, new: str, drop_loops: bool = False) -> DataFrame:
    """Both ends of each link replaced through a rename table."""
    a = renames.select(F.col(old).alias("src"), F.col(new).alias("new_src"))
    b = renames.select(F.col(old).alias("dst"), F.col(new).alias("new_dst"))
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    made = (F.coalesce("new_src", "src") == F.coalesce("new_dst", "dst")) & (F.col("src") != F.col("dst"))
    if drop_loops:
        out = out.where(~made)
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    return out.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), *keep)


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id"))
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def build(nodes: DataFrame, links: DataFrame, directed: bool = True) -> Graph:
    """Upsert nodes, map ghosts, drop dangling links, merge links of equal identity."""
    n = upsert_nodes(nodes)
    ghosts = ghost_map(n)
    kept = n.join(ghosts.select(F.col("ghost").alias("id")), "id", "left_anti")
    moved = rewire(links, ghosts, "ghost", "id", drop_loops=True)
    return Graph(kept, assemble_edges(drop_dangling(moved, kept), directed), directed=directed)


def shrink_guard(before: Graph, after: Graph, force: bool = False) -> None:
    old, new = before.nodes.count(), after.nodes.count()
    if new < old and not force:
        raise ValueError(f"the graph would shrink from {old} to {new} nodes")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, problem) for missing required values, unknown enum values and missing end points."""
    out = None
    for part, df, required in (("node", nodes, ("id", "label", "file_type", "source_file")), ("edge", edges, ("src", "dst", "relation", "confidence"))):
        key = F.col("id") if part == "node" else F.concat_ws(">", "src", "dst")
        checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
        if part == "edge":
            checks.append(F.when(~F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.lit("unknown confidence")))
        else:
            checks.append(F.when(~F.col("file_type").isin("code", "document", "paper", "image", "rationale", "concept"), F.lit("unknown file_type")))
        rows = df.select(F.lit(part).alias("part"), key.alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))
        out = rows if out is None else out.unionByName(rows)
    for end in ("src", "dst"):
        lost = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
        out = out.unionByName(lost.select(F.lit("edge").alias("part"), F.concat_ws(">", "src", "dst").alias("key"), F.lit(f"{end} is no node").alias("problem")))
    return out
