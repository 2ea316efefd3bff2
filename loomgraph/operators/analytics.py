"""Whole-graph statistics, rankings, cycles, components, diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, cut, is_empty, unique
from .primitives import degree_map, structural


def stats(g: Graph) -> DataFrame:
    """One row: nodes, links, communities, links by confidence, links across repos."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    repo = g.nodes.select(F.col("id"), "repo")
    e = g.edges.join(repo.select(F.col("id").alias("src"), F.col("repo").alias("a")), "src", "left").join(repo.select(F.col("id").alias("dst"), F.col("repo").alias("b")), "dst", "left")
    levels = [F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")]
    m = e.agg(F.count("*").alias("edges"), *levels, F.count_if(F.col("a") != F.col("b")).alias("cross_repo"))
    return n.join(m, F.lit(True))


def god_nodes(g: Graph, n: int = 10, leave_out: Column | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """The n nodes with most distinct structural neighbours, files and concepts left out."""
    some = g.nodes.where("file_type <> 'concept'") if leave_out is None else g.nodes.where(~leave_out)
    return unique(some).join(degree_map(g.edges) if degrees is None else degrees, "id").select("id", "label", "neighbours").orderBy(F.desc("neighbours"), "id").limit(n)


def surprise_scores(g: Graph, degrees: DataFrame | None = None) -> DataFrame:
    """Cross-file links with a score: uncertain, across kinds, folders and communities, from the periphery to a hub.

    Links and degrees are tables before both ends ask for them, so that neither is worked out twice; ``degrees``: they are already.
    """
    if degrees is None:
        g = g.with_(edges=cut(g.edges.select("src", "dst", "relation", "context", "confidence", "weight"), "edges"))
        degrees = cut(degree_map(g.edges), "degrees")
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    n = g.nodes.select("id", "label", "file_type", "kind", "source_file", "community", folder.alias("folder")).join(unique(degrees), "id", "left").fillna(0, ["neighbours"])
    a, b = (unique(n).select(*(F.col(c).alias(f"{p}_{c}") for c in n.columns)) for p in "ab")
    e = g.edges.where("src <> dst").join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).where("a_source_file <> b_source_file")
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    score = base + F.when(F.col("a_file_type") != F.col("b_file_type"), 2).otherwise(0) + F.when(F.col("a_folder") != F.col("b_folder"), 2).otherwise(0)
    score = score + F.coalesce((F.col("a_community") != F.col("b_community")).cast("int"), F.lit(0))
    score = score.cast("double") * F.when(F.col("relation").rlike("semantic|conceptual"), 1.5).otherwise(1.0)
    low, high = F.least("a_neighbours", "b_neighbours"), F.greatest("a_neighbours", "b_neighbours")
    score = score + F.when((low <= 2) & (high >= 5), 1).otherwise(0)
    return e.select("src", "dst", "relation", "context", "confidence", F.col("a_label").alias("src_label"), F.col("b_label").alias("dst_label"), score.alias("score"))


def surprising(g: Graph, n: int = 5, degrees: DataFrame | None = None) -> DataFrame:
    return surprise_scores(g, degrees).orderBy(F.desc("score"), "src_label", "dst_label", "src", "dst", "relation", "context").limit(n)


def cross_community(g: Graph) -> DataFrame:
    """One link a pair of communities, the most uncertain first."""
    c = unique(g.nodes.where("community is not null").select("id", "community"))
    e = g.edges.select("src", "dst", "relation", "confidence").join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").where("a <> b")
    doubt = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    best = F.min(F.struct(doubt.alias("doubt"), "src", "dst", "relation"))
    pairs = e.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(best.alias("e"))
    return pairs.select("low", "high", "e.src", "e.dst", "e.relation")


def questions(g: Graph, budget: int = 7) -> DataFrame:
    """Suggested questions by family in a fixed order, up to a budget."""
    g = g.with_(edges=cut(g.edges.select("src", "dst", "relation", "context", "confidence", "weight"), "edges"))
    degrees = cut(degree_map(g.edges), "degrees")
    gods = god_nodes(g, 3, degrees=degrees).select(F.lit(1).alias("family"), F.concat(F.lit("What depends on "), "label", F.lit("?")).alias("question"), "id")
    odd = surprising(g, 3, degrees).select(F.lit(2).alias("family"), F.concat(F.lit("Why is "), "src_label", F.lit(" linked to "), "dst_label", F.lit("?")).alias("question"), F.col("src").alias("id"))
    unsure = g.edges.where("confidence = 'AMBIGUOUS'").select("src", "dst").distinct().orderBy("src", "dst").limit(3)
    unsure = unsure.select(F.lit(3).alias("family"), F.concat(F.lit("Is "), "src", F.lit(" really linked to "), "dst", F.lit("?")).alias("question"), F.col("src").alias("id"))
    alone = g.nodes.join(unique(degrees), "id", "left_anti").orderBy("id").limit(3).select(F.lit(4).alias("family"), F.concat(F.lit("What is "), "label", F.lit(" for?")).alias("question"), "id")
    return reduce(DataFrame.unionAll, [gods, odd, unsure, alone]).orderBy("family", "id", "question").limit(budget)


def cohesion(g: Graph, group: str = "community") -> DataFrame:
    """(group, size, pairs, cohesion): distinct linked pairs inside a group over all its pairs; 0 for a single node."""
    c = g.nodes.where(F.col(group).isNotNull()).select("id", F.col(group).alias("g"))
    e = g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inside = e.join(c.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(c.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b").where("ga = gb")
    pairs = inside.groupBy(F.col("ga").alias("g")).agg(F.count("*").alias("pairs"))
    size = c.groupBy("g").agg(F.count("*").alias("size"))
    out = size.join(pairs, "g", "left").fillna(0, ["pairs"])
    return out.select(F.col("g").alias(group), "size", "pairs", F.when(F.col("size") > 1, F.col("pairs") / (F.col("size") * (F.col("size") - 1) / 2)).otherwise(0.0).alias("cohesion"))


def file_graph(g: Graph, relations: list[str]) -> DataFrame:
    """Distinct (a, b): files linked over the relations."""
    f = g.nodes.where("source_file <> ''").select("id", "source_file")
    e = g.edges.where(F.col("relation").isin(relations)).join(f.select(F.col("id").alias("src"), F.col("source_file").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("source_file").alias("b")), "dst")
    return e.where("a <> b").select("a", "b").distinct()


def cycles(pairs: DataFrame, longest: int = 5, n: int | None = 20) -> DataFrame:
    """Simple cycles of 2 to ``longest`` nodes of a distinct directed pair table, each from its smallest node; by length, then names.

    Only nodes that lie on some closed walk take part: those without a way in or
    out are peeled off before paths are grown.
    """
    p = pairs
    for _ in range(3):
        p = p.join(p.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(p.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
    p = cut(p, "pairs")
    paths = p.where("a < b").select(F.col("a").alias("start"), F.col("b").alias("end"), F.array("a", "b").alias("path"))
    found = []
    back = p.select(F.col("a").alias("end"), F.col("b").alias("start"))
    for length in range(2, longest + 1):
        found.append(paths.join(back, ["start", "end"]).select(F.col("path").alias("cycle")))
        if length == longest:
            break
        grown = paths.join(p.select(F.col("a").alias("end"), F.col("b").alias("next")), "end").where("next > start and not array_contains(path, next)")
        paths = cut(grown.select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path")), "paths")
        if is_empty(paths):
            break
    out = reduce(DataFrame.unionAll, found).orderBy(F.size("cycle"), "cycle")
    return out if n is None else out.limit(n)


def components(pairs: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(id, component): smallest id reachable over undirected pairs (a, b); with ``label`` (id, l) only between equal labels.

    Minimum labels with pointer jumping; a round is two grouped minima.
    """
    e = pairs
    if label is not None:
        e = e.join(label.select(F.col("id").alias("a"), F.col("l").alias("la")), "a").join(label.select(F.col("id").alias("b"), F.col("l").alias("lb")), "b").where("la = lb").select("a", "b")
    both = cut(e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("c"))
        new = labels.join(seen, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        if is_empty(new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old")):
            return new
        labels = new


def strong_components(pairs: DataFrame) -> DataFrame:
    """(id, component) of all strongly connected groups of two nodes or more, and of nodes with a loop.

    Forward and backward minimum labels: nodes that share both lie in one group;
    settled nodes leave, the rest goes another round.
    """
    p = cut(pairs.select("a", "b").distinct(), "pairs")
    loops = p.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    rest = p.where("a <> b")
    found = []
    while not is_empty(rest):  # a round settles at least the group of the smallest id
        ids = rest.select(F.col("a").alias("id")).unionAll(rest.select(F.col("b").alias("id"))).distinct()

        def spread(here: str, there: str, ids: DataFrame = ids, rest: DataFrame = rest) -> DataFrame:
            """Smallest id that reaches each node along the links."""
            labels = cut(ids.select("id", F.col("id").alias("l")), "labels")
            while True:
                step = rest.join(labels.select(F.col("id").alias(here), "l"), here).groupBy(F.col(there).alias("id")).agg(F.min("l").alias("m"))
                new = cut(labels.join(step, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l")), "labels")
                if is_empty(new.join(labels.withColumnRenamed("l", "old"), "id").where("l <> old")):
                    return new
                labels = new

        ahead = spread("a", "b").withColumnRenamed("l", "f")
        behind = spread("b", "a").withColumnRenamed("l", "k")
        both = cut(ahead.join(behind, "id"), "both")
        settled = both.where("f = k").select("id", F.col("f").alias("component"))
        found.append(settled)
        # Links stay between unsettled nodes of equal labels only: others cross groups.
        open_ = both.where("f <> k")
        rest = rest.join(open_.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("k").alias("ka")), "a").join(open_.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("k").alias("kb")), "b")
        rest = cut(rest.where("fa = fb and ka = kb").select("a", "b"), "rest")
    if not found:
        return loops
    out = reduce(DataFrame.unionAll, found)
    large = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    groups = out.join(large, "component", "left_semi").select("id", "component")
    return groups.unionAll(loops.join(groups, "id", "left_anti").select("id", "component"))


def graph_diff(old: Graph, new: Graph) -> DataFrame:
    """(what, change, key): nodes by id, and links by undirected ends and relation, that one graph has alone."""

    def links(g: Graph) -> DataFrame:
        return g.edges.select(F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst"), "relation").alias("key"))

    parts = []
    for what, a, b in (("node", old.nodes.select(F.col("id").alias("key")), new.nodes.select(F.col("id").alias("key"))), ("edge", links(old), links(new))):
        # Both sides meet once, dealt by key.
        both = a.select("key", F.lit(1).alias("side")).unionAll(b.select("key", F.lit(2).alias("side")))
        alone = both.repartition("key").groupBy("key").agg(F.bit_or("side").alias("sides")).where("sides < 3")
        parts.append(alone.select(F.lit(what).alias("what"), F.when(F.col("sides") == 2, "added").otherwise("removed").alias("change"), "key"))
    return reduce(DataFrame.unionAll, parts)


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, w): undirected pairs with summed weight; loops count once."""
    return structural(edges).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Q of a partition (id, l) of an undirected weighted pair table; a pair may have several rows."""
    l = unique(labels.select("id", "l"))  # noqa: E741
    e = pairs.join(l.select(F.col("id").alias("a"), F.col("l").alias("la")), "a").join(l.select(F.col("id").alias("b"), F.col("l").alias("lb")), "b")
    # Links are read once; all sums are over pairs of labels.
    e = cut(e.groupBy("la", "lb").agg(F.sum("w").alias("w")), "sums")
    inside, total = e.agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    if not total:
        return 0.0
    ends = e.select(F.col("la").alias("l"), "w").unionAll(e.select(F.col("lb").alias("l"), "w")).groupBy("l").agg(F.sum("w").alias("k"))
    square = ends.agg(F.sum(F.pow("k", 2))).first()[0]
    return inside / total - resolution * square / (4 * total * total)


def community_labels(g: Graph, n: int = 5) -> DataFrame:
    """(community, labels): the first labels of each community by node id."""
    order = Window.partitionBy("community").orderBy("id")
    some = g.nodes.where("community is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return some.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x.label).alias("labels"))


def local_assignment(g: Graph, rounds: int = 2) -> DataFrame:
    """(id, community) of nodes without one: the community most of their neighbours have, ties to the smallest."""
    e = g.edges.where("src <> dst")
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionAll(e.select(F.col("dst").alias("id"), F.col("src").alias("n")))
    known = g.nodes.where("community is not null").select("id", "community")
    new = known.limit(0)
    for _ in range(rounds):
        lacking = g.nodes.select("id").join(known, "id", "left_anti")
        # Only links of nodes that lack one are made distinct.
        votes = both.join(unique(lacking), "id").repartition("n").distinct().join(unique(known.select(F.col("id").alias("n"), "community")), "n").groupBy("id", "community").agg(F.count("*").alias("c"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("c"), "community")).alias("b")).select("id", "b.community")
        best = cut(best, "joined")
        if is_empty(best):
            break
        new, known = new.unionAll(best), known.unionAll(best)
    return new
