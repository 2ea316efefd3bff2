"""Shortest paths, reverse impact, references and name resolution: loops of set-based level joins.

Each level is written to the shared folder, so plans stay short; a loop stops on
an empty level or at its depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut, is_empty
from ..schemas import IMPACT_RELATIONS, type_like
from .primitives import bare_name, degree

# Priority classes of relations on a path, best first.
PATH_CLASSES = (
    ("calls", "calls_service", "invokes", "calls_proc", "method", "handled_by"),
    ("inherits", "implements", "extends", "mixes_in"),
    ("imports", "imports_from", "re_exports"),
    ("uses", "depends_on", "uses_api"),
    ("references",),
)
OWNERSHIP = r"^(contains|method|member_of)$|^(defines|declares)|^has_"


def path_priority(relation: str | Column = "relation") -> Column:
    c = F.col(relation) if isinstance(relation, str) else relation
    out = F.when(c.isin(*PATH_CLASSES[0]), 0)
    for i, names in enumerate(PATH_CLASSES[1:], 1):
        out = out.when(c.isin(*names), i)
    return out.otherwise(len(PATH_CLASSES))


def ownership(relation: str | Column = "relation") -> Column:
    return (F.col(relation) if isinstance(relation, str) else relation).rlike(OWNERSHIP)


def shortest_path(g: Graph, start: str, end: str) -> list[str] | None:
    """None if there is no path, however long.  Fewest undirected hops; of equal paths the one whose relations have the better class, then lower degree, then id.

    Each level keeps one trail a node; only the path itself comes to the driver.
    """
    held = {r.id for r in g.nodes.where(F.col("id").isin(start, end)).select("id").collect()}
    if held != {start, end}:
        return None
    if start == end:
        return [start]
    e = g.edges.where("src <> dst")
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), path_priority().alias("p")).unionAll(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), path_priority().alias("p")))
    # Cut before the loop: a level reads the steps, it does not work them out again.
    steps = cut(both.groupBy("a", "b").agg(F.min("p").alias("p")).join(degree(g.edges).select(F.col("id").alias("b"), "degree"), "b"), "steps")
    # The trail of a node compares as a breadth-first queue would serve it.
    front = g.spark.createDataFrame([(start, [])], "a string, trail array<struct<p:int,degree:bigint,id:string>>")
    seen = front.select(F.col("a").alias("b"))
    while True:
        step = F.array(F.struct(F.col("p").cast("int").alias("p"), F.col("degree").cast("bigint").alias("degree"), F.col("b").alias("id")))
        reached = front.join(steps, "a").join(seen, "b", "left_anti").select("b", F.concat("trail", step).alias("trail"))
        level = cut(reached.groupBy("b").agg(F.min("trail").alias("trail")), "level")
        if is_empty(level):
            return None
        got = level.where(F.col("b") == end).first()
        if got is not None:
            return [start, *(t.id for t in got.trail)]
        front = level.select(F.col("b").alias("a"), "trail")
        seen = seen.unionAll(level.select("b"))


def explain_node(g: Graph, node_id: str) -> DataFrame:
    """Neighbours with relation, direction and context, ordered by (direction, relation, id)."""
    n = g.nodes.select("id", "label")
    out = g.edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), "relation", "context", F.col("dst").alias("id"))
    into = g.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), "relation", "context", F.col("src").alias("id"))
    return out.unionAll(into).join(n, "id").select("direction", "relation", "id", "label", "context").orderBy("direction", "relation", "id", "context")


def references(edges: DataFrame, node_id: str) -> DataFrame:
    """Distinct (src, relation) of incoming links other than ownership."""
    return edges.where((F.col("dst") == node_id) & ~ownership()).select("src", "relation").distinct()


def affected(g: Graph, seeds: list[str] | DataFrame, depth: int, relations: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(id, depth, via): what depends on the seeds (ids, or a table of them) over the relations, with the least depth and the smallest relation there.

    Seeds are left out of the result; with ``exclude`` only those are, so a seed
    that another seed reaches is reported.
    """
    relations = IMPACT_RELATIONS if relations is None else relations
    into = g.edges.where(F.col("relation").isin(relations) & (F.col("src") != F.col("dst"))).select("src", "dst", "relation")
    spark = g.spark
    roots = (seeds.select("id") if isinstance(seeds, DataFrame) else spark.createDataFrame([(s,) for s in seeds], "id string")).distinct()
    seen = roots.select("id") if exclude is None else spark.createDataFrame([(s,) for s in exclude], "id string").distinct()
    front, found = cut(roots, "roots"), []
    for d in range(1, depth + 1):
        # A semi-join moves below the merging of links, to the tables: each level reads what its front asks for.
        level = into.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.min("relation").alias("via")).withColumnRenamed("src", "id")
        level = cut(level.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "via"), "level")
        if is_empty(level):
            break
        found.append(level)
        front = level.select("id")
        seen = seen.unionAll(front)
    if not found:
        return roots.limit(0).select("id", F.lit(0).alias("depth"), F.lit("").alias("via"))
    return reduce(DataFrame.unionAll, found)


def members(g: Graph, type_id: str) -> DataFrame:
    """Distinct members of a type, sorted."""
    return g.edges.where((F.col("src") == type_id) & F.col("relation").isin("method", "contains", "has_method")).select(F.col("dst").alias("id")).distinct().orderBy("id")


def affected_with_members(g: Graph, seed: str, depth: int, relations: list[str] | None = None) -> DataFrame:
    """Impact of a node; a type-like seed stands for its members too, and members reached otherwise are reported."""
    seeds = g.spark.createDataFrame([(seed,)], "id string")
    if g.nodes.where((F.col("id") == seed) & type_like()).limit(1).take(1):
        seeds = cut(seeds.unionAll(members(g, seed)), "seeds")
    return affected(g, seeds, depth, relations, exclude=[seed])


SHOWN = 100
STAGES = ("exact", "label", "bare", "file", "part")


def resolve(g: Graph, name: str) -> tuple[str, list[str]]:
    """('unique', [id]), ('ambiguous', ids of the first stage with any) or ('missing', []).

    Stages: id, label without case, bare name, file, part of a label; `name@file` narrows by file.  More than
    SHOWN ambiguous ids are no list that anyone can choose from: the first so many come with 'ambiguous-more'.
    """
    wanted, _, hint = name.partition("@")
    n = g.nodes.where(F.contains("source_file", F.lit(hint))) if hint else g.nodes
    low = F.lit(wanted.lower())
    tests = [F.col("id") == wanted, F.lower("label") == low, F.lower(bare_name()) == F.lower(bare_name(F.lit(wanted))), (F.col("source_file") == wanted) | F.endswith("source_file", F.lit("/" + wanted)), F.contains(F.lower("label"), low)]
    stage = F.coalesce(*(F.when(t, i) for i, t in enumerate(tests)))
    hits = n.select("id", stage.alias("stage")).where("stage is not null")
    first = hits.agg(F.min("stage")).first()[0]
    if first is None:
        return "missing", []
    ids = [r.id for r in hits.where(F.col("stage") == first).orderBy("id").limit(SHOWN + 1).collect()]
    return ("unique" if len(ids) == 1 else "ambiguous" if len(ids) <= SHOWN else "ambiguous-more"), ids[:SHOWN]


def candidates(g: Graph, ids: list[str]) -> DataFrame:
    """Ambiguous ids with file, degree and a reference that names each alone."""
    some = g.nodes.where(F.col("id").isin(ids)).join(degree(g.edges), "id", "left")
    return some.select("id", "label", "source_file", F.coalesce("degree", F.lit(0)).alias("degree"), F.concat_ws("@", "label", "source_file").alias("reference")).orderBy("id")


def reverse_index(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(dst, src, relation) dealt and sorted by target, for repeated impact queries."""
    some = edges.where(F.col("relation").isin(IMPACT_RELATIONS if relations is None else relations)).select("dst", "src", "relation").distinct()
    return some.repartition("dst").sortWithinPartitions("dst", "src", "relation")


def importers(g: Graph, module_file: str) -> DataFrame:
    """(id, confirmed): importers of stubs whose label has the stem of the module's file; confirmed if the import names it."""
    stem = module_file.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    stub = g.nodes.where(F.coalesce(F.col("source_file"), F.lit("")) == "").where(F.lower(F.regexp_replace(F.element_at(F.split("label", r"[/\\]"), -1), r"\.[^.]*$", "")) == stem)
    links_ = g.edges.where("relation in ('imports_from', 're_exports')").join(stub.select(F.col("id").alias("dst")), "dst")
    return links_.groupBy(F.col("src").alias("id")).agg(F.max(F.coalesce(F.col("context") == F.lit(stem), F.lit(False))).alias("confirmed")).orderBy("id")


def dependents_caveat(g: Graph, sites: DataFrame) -> DataFrame:
    """Ids that may have unseen dependents: no extracted impact link from a located node, but their file has opaque dynamic sites.

    sites: (file, key), key null where the site names nothing.
    """
    opaque = sites.where("key is null").groupBy(F.col("file").alias("source_file")).agg(F.count("*").alias("opaque"))
    located = g.nodes.where("source_file <> ''").select(F.col("id").alias("src"))
    known = g.edges.where(F.col("relation").isin(IMPACT_RELATIONS) & (F.col("confidence") == "EXTRACTED")).join(located, "src", "left_semi").select(F.col("dst").alias("id"))
    return g.nodes.join(known, "id", "left_anti").join(opaque, "source_file").select("id", "opaque")


def describe(g: Graph, most: int = 8) -> DataFrame:
    """(id, callees, summary): distinct sorted labels of what a node calls, and the first of them in one string."""
    called = g.edges.where("relation in ('calls', 'invokes', 'calls_service', 'binds_native', 'uses')").select(F.col("src").alias("id"), "dst").distinct()
    labels = called.join(g.nodes.select(F.col("id").alias("dst"), "label"), "dst").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("callees"))
    more = F.when(F.size("callees") > most, F.concat(F.lit(" +"), (F.size("callees") - most).cast("string"))).otherwise("")
    return labels.select("id", "callees", F.concat(F.array_join(F.slice("callees", 1, most), ", "), more).alias("summary"))


def reachable(edges: DataFrame, starts: DataFrame, relations: list[str] | None, depth: int, forward: bool = True) -> DataFrame:
    """(start, id, depth): least number of hops from each start (column id), up to a depth."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    some = edges if relations is None else edges.where(F.col("relation").isin(relations))
    steps = cut(some.select(F.col(here).alias("id"), F.col(there).alias("next")).distinct(), "steps")
    front = starts.select(F.col("id").alias("start"), "id").distinct()
    seen, found = front, []
    for d in range(1, depth + 1):
        level = front.join(steps, "id").select("start", F.col("next").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        front = cut(level, "level")
        if is_empty(front):
            break
        found.append(front.withColumn("depth", F.lit(d)))
        seen = seen.unionAll(front)
    return reduce(DataFrame.unionAll, found) if found else front.withColumn("depth", F.lit(0)).limit(0)


def entry_points(g: Graph, sites: DataFrame, relations: list[str], depth: int = 8) -> DataFrame:
    """(site, entry, path): reverse walks from call sites that stop at the first surface node (public or handled).

    sites: (id).  One walk a pair of site and node is kept, the smallest by path.
    """
    surface = g.nodes.where("visibility = 'public'").select("id").withColumn("surface", F.lit(True))
    into = g.edges.where(F.col("relation").isin(relations)).select(F.col("dst").alias("id"), F.col("src").alias("next")).distinct()
    front = sites.select(F.col("id").alias("site"), "id", F.array("id").alias("path")).join(surface, "id", "left")
    seen, found = front.select("site", "id"), [front.where("surface")]
    front = front.where("surface is null")
    for _ in range(depth):
        level = front.join(into, "id").select("site", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        level = level.join(seen, ["site", "id"], "left_anti").groupBy("site", "id").agg(F.min("path").alias("path")).join(surface, "id", "left")
        level = cut(level.select("id", "site", "path", "surface"), "level")
        if is_empty(level):
            break
        found.append(level.where("surface").select("id", "site", "path", "surface"))
        front = level.where("surface is null")
        seen = seen.unionAll(level.select("site", "id"))
    out = reduce(DataFrame.unionByName, found)
    return out.select("site", F.col("id").alias("entry"), "path")
