"""Pull requests: states, checks, impact on communities, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut

# States in order of precedence.
STATES = ("WRONG-BASE", "CI-FAIL", "CHANGES", "DRAFT", "STALE", "APPROVED", "PENDING", "READY")
STALE_DAYS = 14
FAILING = ("FAILURE", "CANCELLED", "TIMED_OUT", "ERROR", "ACTION_REQUIRED")


def checks(conclusions: str) -> Column:
    """Roll-up of an array of conclusions: any failure, else anything running, else any success, else none."""
    c = F.coalesce(F.col(conclusions), F.array().cast("array<string>"))
    return (
        F.when(F.exists(c, lambda x: x.isin(*FAILING)), "FAILURE")
        .when(F.exists(c, lambda x: x.isin("IN_PROGRESS", "QUEUED", "PENDING")), "PENDING")
        .when(F.exists(c, lambda x: x == "SUCCESS"), "SUCCESS")
        .otherwise("NONE")
    )


def status(base: str = "main") -> Column:
    """State of a row (base, checks, review, draft, age_days)."""
    return (
        F.when(F.col("base") != base, STATES[0])
        .when(F.col("checks") == "FAILURE", STATES[1])
        .when(F.col("review") == "CHANGES_REQUESTED", STATES[2])
        .when(F.col("draft"), STATES[3])
        .when(F.col("age_days") >= STALE_DAYS, STATES[4])
        .when(F.col("review") == "APPROVED", STATES[5])
        .when(F.col("checks") == "PENDING", STATES[6])
        .otherwise(STATES[7])
    )


def actionable(prs: DataFrame) -> DataFrame:
    """Without those on a wrong base or stale, by state, then age."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("status"))
    return prs.where("status not in ('WRONG-BASE', 'STALE')").orderBy(rank, "age_days", "number")


def _same_paths(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, source_file): distinct paths that equal a node's file or of which one ends with the other at a slash.

    Joined on the base name; the suffix test is the residual.  Pull requests
    stay out: as many share a path as there are, and would meet at its name.
    """
    a = files.select("path", F.element_at(F.split("path", "/"), -1).alias("base")).distinct()
    b = nodes.select("source_file", F.element_at(F.split("source_file", "/"), -1).alias("base")).distinct()
    same = (F.col("path") == F.col("source_file")) | F.endswith("path", F.concat(F.lit("/"), "source_file")) | F.endswith("source_file", F.concat(F.lit("/"), "path"))
    return cut(a.join(b, "base").where(same).select("path", "source_file"), "paths")


def path_matches(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(number, source_file): changed paths that equal a node's file or of which one ends with the other at a slash."""
    return files.select("number", "path").join(_same_paths(files, nodes), "path").select("number", "source_file").distinct()


def impact(files: DataFrame, g: Graph) -> DataFrame:
    """(number, communities, nodes) of each pull request.

    Files are counted before pull requests meet them; only ids that lie in
    several files, and communities, meet them as rows.
    """
    paths = _same_paths(files, g.nodes)
    n = g.nodes.select("source_file", "id", "community").join(paths.select("source_file"), "source_file", "left_semi")
    ids = n.where("id is not null").select("source_file", "id").distinct()
    several = cut(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    alone = cut(ids.join(several, "id", "left_anti").groupBy("source_file").agg(F.count("*").alias("k")), "counts")
    shared = cut(ids.join(several, "id", "left_semi"), "shared")
    places = cut(n.where("community is not null").select("source_file", "community").distinct(), "places")
    held = cut(n.select("source_file").distinct(), "held")
    hit = cut(files.select("number", "path").join(paths, "path").select("number", "source_file").repartition("number").distinct(), "hits")
    none = F.lit(0).cast("long")
    parts = [
        hit.join(held, "source_file", "left_semi").select("number", none.alias("communities"), none.alias("nodes")),
        hit.join(alone, "source_file").select("number", none.alias("communities"), F.col("k").alias("nodes")),
        hit.join(shared, "source_file").select("number", "id").distinct().select("number", none.alias("communities"), (none + 1).alias("nodes")),
        hit.join(places, "source_file").select("number", "community").distinct().select("number", (none + 1).alias("communities"), none.alias("nodes")),
    ]
    return reduce(DataFrame.unionAll, parts).groupBy("number").agg(F.sum("communities").alias("communities"), F.sum("nodes").alias("nodes"))


def conflicts(files: DataFrame, g: Graph) -> DataFrame:
    """(community, numbers): communities that two pull requests or more touch, the most contested first."""
    places = _same_paths(files, g.nodes).join(g.nodes.where("community is not null").select("source_file", "community").distinct(), "source_file")
    places = cut(places.select("path", "community").distinct(), "places")
    hit = files.select("number", "path").join(places, "path").select("number", "community").distinct()
    out = hit.groupBy("community").agg(F.array_sort(F.collect_list("number")).alias("numbers")).where(F.size("numbers") >= 2)
    return out.orderBy(F.desc(F.size("numbers")), "community")
