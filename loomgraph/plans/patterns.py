"""Named structural patterns: fixed multi-join queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, unique
from ..operators.primitives import effective_loc, fan
from ..schemas import type_like


def implementations(edges: DataFrame) -> DataFrame:
    """(id, n): distinct sources that implement or inherit it."""
    return edges.where("relation in ('implements', 'inherits')").select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def god_classes(g: Graph, loc: int = 500, out: int = 20) -> DataFrame:
    size = effective_loc(g) if "start_line" in g.nodes.columns else g.nodes.select("id", F.col("loc").alias("effective_loc"))
    big = g.nodes.where(type_like()).join(size.where(F.col("effective_loc") > loc), "id")
    return big.join(fan(g.edges, True).where(F.col("fan_out") > out), "id").select("id").orderBy("id")


@dataclass(frozen=True)
class Chain:
    """References of two steps, left (src, mid) and right (mid, dst): each source of a mid refers to each target of it.

    Kept as two tables: their pairs grow as sources times targets of a mid.
    """

    context: str
    left: DataFrame
    right: DataFrame


def singletons(g: Graph, chains: tuple[Chain, ...] = ()) -> DataFrame:
    """Classes with a reference to themselves in a field or return type, from themselves or one of their methods."""
    refs = g.edges.where("relation = 'references' and context in ('field', 'return_type')").select("src", "dst").distinct()
    own = g.edges.where("relation = 'method'").select(F.col("src").alias("owner"), F.col("dst").alias("src")).distinct()
    by_method = refs.join(own, "src").where("owner = dst").select(F.col("dst").alias("id"))
    found = refs.where("src = dst").select(F.col("src").alias("id")).unionAll(by_method)
    for c in chains:
        if c.context in ("field", "return_type"):
            # A class by itself, and by its methods: the two steps have to end where they came from.
            ends = c.left.join(unique(own), "src").select("mid", F.col("owner").alias("dst")).unionAll(c.left.select("mid", F.col("src").alias("dst")))
            found = found.unionAll(ends.join(c.right, ["mid", "dst"], "left_semi").select(F.col("dst").alias("id")))
    found = found.distinct()
    return g.nodes.where("kind = 'class'").join(found, "id", "left_semi").select("id").orderBy("id")


def _to_abstraction(g: Graph, kinds: tuple[str, ...], context: str, chains: tuple[Chain, ...]) -> DataFrame:
    abstract = implementations(g.edges).where("n >= 2").select(F.col("id").alias("dst"))
    refs = g.edges.where((F.col("relation") == "references") & (F.col("context") == context)).join(abstract, "dst", "left_semi").select(F.col("src").alias("id"))
    for c in chains:
        if c.context == context:
            mids = c.right.join(unique(abstract), "dst", "left_semi").select("mid").distinct()
            refs = refs.unionAll(c.left.join(unique(mids), "mid", "left_semi").select(F.col("src").alias("id")))
    return g.nodes.where(F.col("kind").isin(*kinds)).join(refs, "id", "left_semi").select("id").orderBy("id")


def factories(g: Graph, chains: tuple[Chain, ...] = ()) -> DataFrame:
    return _to_abstraction(g, ("function", "method"), "return_type", chains)


def observers(g: Graph, chains: tuple[Chain, ...] = ()) -> DataFrame:
    return _to_abstraction(g, ("class",), "field", chains)


def service_locators(g: Graph, least: int = 3) -> DataFrame:
    """Classes that nodes of three communities or more call or refer to; needs communities."""
    if not g.nodes.where("community is not null").limit(1).take(1):
        raise ValueError("no communities are assigned; run clustering first")
    callers = g.edges.where("relation in ('calls', 'references')").select("src", "dst").distinct()
    by = callers.join(g.nodes.select(F.col("id").alias("src"), "community").where("community is not null"), "src")
    wide = by.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("community").alias("n")).where(F.col("n") >= least)
    return g.nodes.where("kind = 'class'").join(wide, "id", "left_semi").select("id").orderBy("id")


def dangling_endpoints(g: Graph, consumes: tuple[str, ...] = ("calls_service",), provides: tuple[str, ...] = ("handled_by",)) -> DataFrame:
    """Boundary nodes with a consumer or a provider, but not both."""
    node_type = F.get_json_object("extra", "$.node_type")
    boundary = g.nodes.where(node_type.isNotNull())
    used = g.edges.where(F.col("relation").isin(*consumes)).select(F.col("dst").alias("id")).distinct().withColumn("consumed", F.lit(True))
    made = g.edges.where(F.col("relation").isin(*provides)).select(F.col("src").alias("id")).distinct().withColumn("provided", F.lit(True))
    both = boundary.join(used, "id", "left").join(made, "id", "left")
    return both.where(F.coalesce("consumed", F.lit(False)) != F.coalesce("provided", F.lit(False))).select("id").orderBy("id")
