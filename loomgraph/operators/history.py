"""Change history: modules, coupling, drift, removed interfaces, hotspots, co-change, risk and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut, unique
from .analytics import cycles
from .primitives import is_test_path
from .traversal import affected

DEPENDENCIES = ("calls", "imports", "imports_from", "uses", "depends_on", "references", "inherits", "implements")


def module_of(path: str | Column, depth: int = 2) -> Column:
    """First ``depth`` folders of a path, its file left out; (root) for a bare file."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    n = F.least(F.size(parts) - 1, F.lit(depth))
    return F.when(n >= 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), "/")).otherwise("(root)")


def module_links(g: Graph, relations: tuple[str, ...] = DEPENDENCIES, depth: int = 2) -> DataFrame:
    """Distinct (a, b): modules of which one depends on the other."""
    n = g.nodes.where("source_file <> ''").select("id", module_of("source_file", depth).alias("m"))
    e = g.edges.where(F.col("relation").isin(*relations)).select("src", "dst").distinct()
    joined = e.join(n.select(F.col("id").alias("src"), F.col("m").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("m").alias("b")), "dst")
    return joined.where("a <> b").select("a", "b").distinct()


def dependency_delta(old: Graph, new: Graph, depth: int = 2) -> DataFrame:
    a, b = module_links(old, depth=depth), module_links(new, depth=depth)
    added = b.join(a, ["a", "b"], "left_anti").select("a", "b", F.lit("added").alias("change"))
    return added.unionAll(a.join(b, ["a", "b"], "left_anti").select("a", "b", F.lit("removed").alias("change"))).orderBy("change", "a", "b")


def removed_interfaces(old: Graph, new: Graph, n: int = 50) -> DataFrame:
    """Code nodes that are gone and were public, or of unknown visibility with uses from other files; most used first."""
    gone = cut(old.nodes.where("file_type = 'code'").join(unique(new.nodes.select("id")), "id", "left_anti").select("id", "label", "source_file", "visibility"), "gone")
    file = old.nodes.select(F.col("id"), F.col("source_file").alias("f"))
    # Only links to what is gone are asked for.
    into = old.edges.select("src", "dst").join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").repartition("src").distinct()
    used = into.join(unique(file.select(F.col("id").alias("src"), F.col("f").alias("fa"))), "src").join(gone.select(F.col("id").alias("dst"), F.col("source_file").alias("fb")), "dst")
    refs = used.where("fa <> fb").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("refs"))
    out = gone.join(refs, "id", "left").fillna(0, ["refs"]).where("visibility = 'public' or (visibility is null and refs > 0)")
    return out.select("id", "label", "refs").orderBy(F.desc("refs"), "id").limit(n)


def coupling(g: Graph, depth: int = 2) -> DataFrame:
    """(module, crossing, total, coupling): links that leave a module over all its links, distinct undirected pairs."""
    n = g.nodes.where("source_file <> ''").select("id", module_of("source_file", depth).alias("m"))
    e = g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    joined = e.join(n.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(n.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    each = joined.select(F.explode(F.array_distinct(F.array("ma", "mb"))).alias("module"), (F.col("ma") != F.col("mb")).cast("long").alias("crosses"))
    out = each.groupBy("module").agg(F.sum("crosses").alias("crossing"), F.count("*").alias("total"))
    return out.withColumn("coupling", F.col("crossing") / F.col("total"))


def drift(old: Graph, new: Graph, depth: int = 2) -> DataFrame:
    a = coupling(old, depth).select("module", F.col("coupling").alias("before"))
    b = coupling(new, depth).select("module", F.col("coupling").alias("after"))
    out = a.join(b, "module", "full_outer").fillna(0.0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    return out.where(F.abs("delta") > 1e-9).orderBy(F.desc("delta"), "module")


def new_cycles(old_pairs: DataFrame, new_pairs: DataFrame, longest: int = 12) -> DataFrame:
    return cycles(new_pairs, longest, None).join(cycles(old_pairs, longest, None), "cycle", "left_anti").orderBy(F.size("cycle"), "cycle")


def hotspots(numstat: DataFrame, node_changes: DataFrame, n: int = 20) -> DataFrame:
    """(path, score): changed lines plus three a changed node.  numstat: added, deleted, path; node_changes: path."""
    lines = numstat.groupBy("path").agg((F.sum("added") + F.sum("deleted")).alias("lines"))
    nodes = node_changes.groupBy("path").agg(F.count("*").alias("nodes"))
    out = lines.join(nodes, "path", "full_outer").fillna(0, ["lines", "nodes"])
    return out.withColumn("score", F.col("lines") + 3 * F.col("nodes")).orderBy(F.desc("score"), "path").limit(n)


def co_change(transactions: DataFrame, changed: list[str], least: int = 2, percent: int = 30, n: int = 10) -> DataFrame:
    """Files that change together with the given ones.  transactions: commit, file.

    support: commits that touch both; confidence: its share of the commits that touch a given file, in whole percent.
    """
    tx = transactions.select("commit", "file").distinct()
    hits = tx.where(F.col("file").isin(changed)).select("commit").distinct()
    total = hits.count()
    support = tx.join(hits, "commit", "left_semi").where(~F.col("file").isin(changed)).groupBy("file").agg(F.count("*").alias("support"))
    out = support.withColumn("confidence", F.floor((F.col("support") * 200 + total) / (2 * max(total, 1))).cast("int"))
    return out.where((F.col("support") >= least) & (F.col("confidence") >= percent)).orderBy(F.desc("confidence"), F.desc("support"), "file").limit(n)


# Weights and caps of the six features of risk, and the bands.
RISK = (("dependents", 0.30, 50.0), ("files", 0.20, 20.0), ("public_api", 0.20, 10.0), ("communities", 0.10, 5.0), ("untested", 0.10, 10.0), ("churn", 0.10, 500.0))
BANDS = ((66, "high"), (33, "medium"), (0, "low"))


def risk(features: DataFrame) -> DataFrame:
    """features with score (0 to 100), band and factors (names that add 0.04 or more)."""
    parts = [(name, F.least(F.col(name) / cap, F.lit(1.0)) * weight) for name, weight, cap in RISK]
    total = sum((p for _, p in parts), F.lit(0.0))
    score = F.floor(total * 100 + 0.5).cast("int")
    band = F.when(score >= BANDS[0][0], BANDS[0][1]).when(score >= BANDS[1][0], BANDS[1][1]).otherwise(BANDS[2][1])
    factors = F.array_compact(F.array(*(F.when(p >= 0.04, F.lit(name)) for name, p in parts)))
    return features.withColumn("score", score).withColumn("band", band).withColumn("factors", factors)


def forecast(g: Graph, seeds: list[str], depth: int = 3, most: int = 200) -> dict[str, DataFrame]:
    """What a change of the seeds reaches: tests (all), other nodes (limited), public interfaces."""
    hit = affected(g, seeds, depth).join(g.nodes.select("id", "source_file", "visibility"), "id")
    tests = hit.where(is_test_path()).orderBy("depth", "id")
    blast = hit.where(~is_test_path()).orderBy("depth", "id").limit(most)
    public = g.nodes.where(F.col("id").isin(seeds) & (F.col("visibility") == "public")).select("id").orderBy("id")
    return {"tests": tests, "blast": blast, "public_api": public}


def edit_impact(g: Graph, target: str, edit: str) -> DataFrame:
    """(id, relation, verdict): dependents of a node that a delete, signature or visibility change breaks or asks to review."""
    into = cut(g.edges.where(F.col("dst") == target).select(F.col("src").alias("id"), "relation", "confidence").distinct(), "into")
    own = g.nodes.where(F.col("id") == target).agg(F.min("source_file")).first()[0]
    rows = into.join(g.nodes.select("id", "source_file"), "id")
    sure = F.col("confidence") == "EXTRACTED"
    callers = F.col("relation").isin("calls", "invokes", "uses", "method", "inherits", "implements")
    breaks = {"delete": sure, "signature": sure & callers, "visibility": sure & (F.col("source_file") != F.lit(own))}[edit]
    return rows.select("id", "relation", F.when(breaks, "breaks").otherwise("review").alias("verdict")).orderBy("verdict", "id", "relation")
