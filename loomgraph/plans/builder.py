"""Pattern queries as DataFrame plans; Catalyst pushes filters and columns into the scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut, is_empty
from ..operators.primitives import degree, fan, node_props
from .parser import Both, Compare, Has, Node, Not, Query, Step, compares, parse

NUMERIC = ("loc", "fan_in", "fan_out", "degree", "community")


def _props(g: Graph, fields: set[str]) -> DataFrame:
    """Nodes with the fields asked for; degrees are joined only if they are among them."""
    out = node_props(g)
    if "fan_out" in fields:
        out = out.join(fan(g.edges, True), "id", "left").fillna(0, ["fan_out"])
    if "fan_in" in fields:
        out = out.join(fan(g.edges, False), "id", "left").fillna(0, ["fan_in"])
    if "degree" in fields:
        out = out.join(degree(g.edges), "id", "left").fillna(0, ["degree"])
    return out.select("id", *sorted(fields | {"kind"}))


def _named(df: DataFrame, var: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{var}__{c}") for c in df.columns))


def pairs(edges: DataFrame, relation: str | None, direction: str) -> DataFrame:
    """Distinct (a, b): from a one step leads to b."""
    some = edges if relation is None else edges.where(F.col("relation") == relation)
    out = some.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = some.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def walk(starts: DataFrame, steps: DataFrame, low: int, high: int) -> DataFrame:
    """Distinct (a, b): b is a neighbour of a node first reached from a by low-1 to high-1 steps (so a may come back)."""
    if (low, high) == (1, 1):
        return starts.join(steps, "a").select("a", "b")
    front = starts.select("a", F.col("a").alias("n"))
    seen = front
    found = []
    for depth in range(1, high + 1):
        level = cut(front.join(steps.select(F.col("a").alias("n"), F.col("b").alias("m")), "n").select("a", F.col("m").alias("n")).distinct(), "level")
        if is_empty(level):
            break
        if depth >= low:
            found.append(level)
        if depth < high:
            front = cut(level.join(seen, ["a", "n"], "left_anti"), "front")
            seen = seen.unionAll(front)
            if is_empty(front):
                break
    if not found:
        return front.limit(0).select("a", F.col("n").alias("b"))
    return reduce(DataFrame.unionAll, found).distinct().select("a", F.col("n").alias("b"))


def _scan(props: DataFrame, node: Node) -> DataFrame:
    some = props if node.kind is None else props.where(F.lower("kind") == node.kind.lower())
    return _named(some, node.var)


def _expand(bound: DataFrame, g: Graph, props: DataFrame, before: str, step: Step) -> DataFrame:
    steps = pairs(g.edges, step.relation, step.direction)
    here = f"{before}__id"
    if step.walks:
        steps = walk(bound.select(F.col(here).alias("a")).distinct(), steps, step.low, step.high)
    joined = bound.join(steps, bound[here] == steps["a"])
    # A variable that appears again is bound anew; the earlier binding goes.
    again = [c for c in bound.columns if c.startswith(f"{step.node.var}__")]
    joined = joined.drop("a", *again)
    target = _scan(props, step.node)
    return joined.join(target, joined["b"] == target[f"{step.node.var}__id"]).drop("b")


def condition(where: object) -> Column:
    """Two-valued: a comparison with a missing property is false, and its negation true."""
    if isinstance(where, Not):
        return ~condition(where.inner)
    if isinstance(where, Both):
        left, right = condition(where.left), condition(where.right)
        return left & right if where.op == "and" else left | right
    if isinstance(where, Has):
        return F.lit(False)
    assert isinstance(where, Compare)
    column = F.col(f"{where.var}__{where.field}")
    number = isinstance(where.value, float)
    if where.op == "=~":
        return F.lit(False) if where.field in NUMERIC else F.coalesce(column.rlike(str(where.value)), F.lit(False))
    if number != (where.field in NUMERIC):
        return column.isNotNull() if where.op == "!=" else F.lit(False)
    value = F.lit(where.value)
    result = {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[where.op]
    return F.coalesce(result, F.lit(False))


def rendered(column: Column, numeric: bool) -> Column:
    """As text: whole numbers without a fraction, null as empty."""
    if not numeric:
        return F.coalesce(column.cast("string"), F.lit(""))
    d = column.cast("double")
    return F.coalesce(F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string")), F.lit(""))


def bindings(g: Graph, q: Query) -> DataFrame:
    """One row a match of pattern and condition, with the columns that conditions and results use."""
    fields = {c.field for c in compares(q.where) if isinstance(c, Compare)} | {i.field for i in q.items if i.field}
    if any(i.count for i in q.items) and any(i.field is None and not i.count for i in q.items):
        fields |= {"label"}
    if any(i.field for i in q.items):
        fields |= {"label"}
    props = _props(g, fields)
    bound, before = _scan(props, q.start), q.start.var
    for step in q.steps:
        bound = _expand(bound, g, props, before, step)
        before = step.node.var
    return bound if q.where is None else bound.where(condition(q.where))


def run(g: Graph, text: str) -> DataFrame:
    """Result rows: ids of the returned variables, or text groups with counts; sorted, then limited."""
    q = parse(text)
    bound = bindings(g, q)
    keys = [i for i in q.items if not i.count]
    if not any(i.count or i.field for i in q.items):
        out = bound.select(*(F.col(f"{i.var}__id").alias(i.column) for i in keys)).distinct().orderBy(*(i.column for i in keys))
        return out if q.limit is None else out.limit(q.limit)
    shown = [
        rendered(F.col(f"{i.var}__{i.field}"), i.field in NUMERIC).alias(i.column) if i.field else F.coalesce(f"{i.var}__label", f"{i.var}__id").alias(i.column) for i in keys
    ]
    counts = [F.count(F.lit(1)).alias(i.column) for i in q.items if i.count]
    rows = bound.select(*shown)
    if not counts:
        out = rows.distinct()
    elif keys:
        out = rows.groupBy(*(i.column for i in keys)).agg(*counts)
    else:
        out = bound.agg(*counts).where(F.col(next(i.column for i in q.items if i.count)) > 0)
    out = out.select(*(i.column for i in q.items))
    if keys:
        out = out.orderBy(*(i.column for i in keys))
    return out if q.limit is None else out.limit(q.limit)


def run_federated(g: Graph, text: str) -> DataFrame:
    """As if each repo were queried by itself and the results merged: no match crosses repos, groups and LIMIT apply once.

    The repo becomes a part of every id, so the same plan serves all repos in one pass.
    """
    n = g.nodes.where("repo is not null")
    repo_of = n.select("id", "repo")
    e = g.edges.join(repo_of.select(F.col("id").alias("src"), F.col("repo").alias("a")), "src").join(repo_of.select(F.col("id").alias("dst"), F.col("repo").alias("b")), "dst")
    return run(Graph(n, e.where("a = b").drop("a", "b")), text)


def explain(text: str) -> list[str]:
    """The steps of a query in words, one a line."""
    q = parse(text)
    lines = [f"SCAN {q.start.var}" + (f" kind={q.start.kind.lower()}" if q.start.kind else "")]
    for s in q.steps:
        arrow = {"out": "->", "in": "<-", "both": "--"}[s.direction]
        lines.append(f"JOIN {arrow} {s.relation or 'any'}" + (f" *{s.low}..{s.high}" if s.walks else "") + f" {s.node.var}" + (f" kind={s.node.kind.lower()}" if s.node.kind else ""))
    if q.where is not None:
        lines.append("FILTER " + ", ".join(f"{c.var}.{c.field} {c.op}" if isinstance(c, Compare) else f"has({c.var})" for c in compares(q.where)))
    lines.append(("AGGREGATE " if any(i.count for i in q.items) else "PROJECT ") + ", ".join(i.column for i in q.items))
    if q.limit is not None:
        lines.append(f"LIMIT {q.limit}")
    return lines


def outline(g: Graph, part: str) -> DataFrame:
    """Symbols of the files whose path contains the text, by start line (unknown last), then id."""
    line = F.col("span.start_line") if "span" in g.nodes.columns else F.col("start_line") if "start_line" in g.nodes.columns else F.lit(None).cast("int")
    return g.nodes.where(F.contains("source_file", F.lit(part))).withColumn("start", line).orderBy(F.col("start").asc_nulls_last(), "id").drop("start")


def view(g: Graph, ids: DataFrame, column: str) -> DataFrame:
    """Result ids with the labels, kinds and files of their nodes."""
    n = g.nodes.select(F.col("id").alias(column), "label", "kind", "source_file")
    return ids.join(n, column, "left")
