"""Scoring an extracted graph against labels: edges, reach, blast radius, tests, anchors, other indexers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .metrics import percent, scores
from .primitives import bare_name, is_test_path
from .traversal import affected, reachable

# Relations that cross languages or services.
CROSSING = ("calls_service", "handled_by", "binds_native", "invokes", "queries", "writes_to", "reads_from", "calls_proc")


def resolve_labels(g: Graph, labels: DataFrame) -> DataFrame:
    """(label, id): labels `path::symbol` to the node of that file and bare name; ambiguous ones are left out."""
    parts = labels.select("label", F.split_part("label", F.lit("::"), F.lit(1)).alias("source_file"), F.split_part("label", F.lit("::"), F.lit(2)).alias("name"))
    n = g.nodes.select("id", "source_file", bare_name().alias("name"))
    hit = parts.join(n, ["source_file", "name"]).groupBy("label").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return hit.where("n = 1").select("label", "id")


def edge_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pairs (src, dst) within the labelled sources."""
    p = found.select("src", "dst").distinct().join(truth.select("src").distinct(), "src", "left_semi").withColumn("p", F.lit(1))
    t = truth.select("src", "dst").distinct().withColumn("t", F.lit(1))
    c = p.join(t, ["src", "dst"], "full_outer").agg(F.count("p").alias("n_predicted"), F.count("t").alias("n_relevant"), F.count(F.col("p") + F.col("t")).alias("hits"))
    return c.select("*", *scores(F.col("n_predicted"), F.col("n_relevant"), F.col("hits")))


def cross_scores(g: Graph, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """Scores of reach over crossing relations on labelled pairs (src, dst, expected)."""
    reach = reachable(g.edges, pairs.select(F.col("src").alias("id")), list(CROSSING), depth)
    j = pairs.join(reach.select(F.col("start").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("got")), ["src", "dst"], "left")
    c = j.agg(F.count_if(F.col("got")).alias("n_predicted"), F.count_if(F.col("expected")).alias("n_relevant"), F.count_if(F.col("got") & F.col("expected")).alias("hits"))
    return c.select("*", *scores(F.col("n_predicted"), F.col("n_relevant"), F.col("hits")))


def blast_score(g: Graph, seed: str, expected: DataFrame, distractors: DataFrame, depth: int = 3) -> DataFrame:
    """One row: expected, found, missed, and distractors that leaked in."""
    hit = affected(g, [seed], depth).select("id").distinct()
    e = expected.select("id").distinct().join(hit.withColumn("h", F.lit(1)), "id", "left").agg(F.count("*").alias("expected"), F.count("h").alias("found"))
    d = distractors.select("id").distinct().join(hit, "id", "left_semi").agg(F.count("*").alias("leaked"))
    return e.join(d, F.lit(True)).select("expected", "found", (F.col("expected") - F.col("found")).alias("missed"), "leaked", percent(F.col("found"), F.col("expected")).alias("recall"))


def affected_tests(g: Graph, seeds: list[str], links: DataFrame, depth: int = 3) -> DataFrame:
    """Scores of predicted tests on labelled links (test, expected)."""
    tests = affected(g, seeds, depth).join(g.nodes.where(is_test_path()).select("id"), "id", "left_semi").select(F.col("id").alias("test"), F.lit(True).alias("got"))
    j = links.join(tests, "test", "left")
    c = j.agg(F.count_if(F.col("got")).alias("n_predicted"), F.count_if(F.col("expected")).alias("n_relevant"), F.count_if(F.col("got") & F.col("expected")).alias("hits"))
    return c.select("*", *scores(F.col("n_predicted"), F.col("n_relevant"), F.col("hits")))


def boundary_calibration(g: Graph) -> DataFrame:
    """(relation, edges, two_sided): crossing links, and those whose boundary has both a consumer and a provider."""
    e = g.edges.where(F.col("relation").isin(*CROSSING))
    used = e.where("relation <> 'handled_by'").select(F.col("dst").alias("b")).distinct()
    made = e.where("relation = 'handled_by'").select(F.col("src").alias("b")).distinct()
    both = used.join(made, "b", "left_semi").withColumn("both", F.lit(1))
    at = F.when(F.col("relation") == "handled_by", F.col("src")).otherwise(F.col("dst"))
    return e.withColumn("b", at).join(both, "b", "left").groupBy("relation").agg(F.count("*").alias("edges"), F.count("both").alias("two_sided"))


def anchor_exactness(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(lang, anchors, exact): declarations whose name stands on their first line."""
    from .primitives import language

    lines = files.select(F.col("path").alias("source_file"), F.posexplode(F.split("content", "\n")).alias("n", "text")).withColumn("start_line", F.col("n") + 1)
    j = nodes.where("start_line is not null").select("source_file", "start_line", bare_name().alias("name")).join(lines, ["source_file", "start_line"], "left")
    return j.groupBy(language().alias("lang")).agg(F.count("*").alias("anchors"), F.count_if(F.contains("text", F.col("name"))).alias("exact"))


def index_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(lang, agreed, only_theirs, only_ours) by distinct (file, name); lines are left out.  Both: lang, file, name."""
    a = ours.select("lang", "file", "name").distinct().withColumn("a", F.lit(1))
    b = theirs.select("lang", "file", "name").distinct().withColumn("b", F.lit(1))
    j = a.join(b, ["lang", "file", "name"], "full_outer")
    return j.groupBy("lang").agg(F.count(F.col("a") + F.col("b")).alias("agreed"), F.count_if(F.col("a").isNull()).alias("only_theirs"), F.count_if(F.col("b").isNull()).alias("only_ours"))


def replay_commit(forecast: DataFrame, edited: DataFrame) -> DataFrame:
    """Scores of a forecast set of files (file) against what a later commit edited (file)."""
    p, r = forecast.select("file").distinct().withColumn("p", F.lit(1)), edited.select("file").distinct().withColumn("r", F.lit(1))
    c = p.join(r, "file", "full_outer").agg(F.count("p").alias("n_predicted"), F.count("r").alias("n_relevant"), F.count(F.col("p") + F.col("r")).alias("hits"))
    return c.select("*", *scores(F.col("n_predicted"), F.col("n_relevant"), F.col("hits")))


def gate(measured: dict[str, float], bounds: dict[str, float]) -> list[str]:
    """Reasons why a retrieval benchmark fails its least values."""
    return [f"{k} is {measured.get(k, 0.0):.3f}, below {v:.3f}" for k, v in sorted(bounds.items()) if measured.get(k, 0.0) < v]


def historical(cases: DataFrame) -> DataFrame:
    """Mean precision and recall and median delay of cases (predicted array, relevant array, delay)."""
    hits = F.size(F.array_intersect("predicted", "relevant"))
    p = F.when(F.size("predicted") > 0, hits / F.size("predicted")).otherwise(0.0)
    r = F.when(F.size("relevant") > 0, hits / F.size("relevant")).otherwise(0.0)
    return cases.agg(F.count("*").alias("cases"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.median("delay").alias("median_delay"))
