"""Readiness audit and refactoring plans: placeholders, stubs, rationale notes, rename and move plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut
from .primitives import bare_name, is_test_path
from .traversal import affected

# Fixed values.
PLACEHOLDER = r"(?i)\b(todo|fixme|hack|xxx|not\s*implemented|unimplemented|placeholder|stub)\b|raise NotImplementedError|todo!\(|unimplemented!\("
SENTINEL = r"^\s*(return\s+(None|null|nil|0|-1|\"\"|''|\[\]|\{\}|false|False)\s*;?|pass)\s*$"
BASE = {"high": 60, "medium": 35, "low": 15}


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) of files (path, content); lines count from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def enclosing(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, line, id): the smallest span of a node of the file that holds the line.  A range join within each file."""
    n = nodes.where("start_line is not null").select(F.col("source_file").alias("path"), "start_line", "end_line", "id")
    j = sites.select("path", "line").distinct().join(n, "path").where("line between start_line and end_line")
    best = j.groupBy("path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("start_line"), "id")).alias("b"))
    return best.select("path", "line", "b.id")


def placeholders(files: DataFrame) -> DataFrame:
    """(path, line, text, severity): generated files count low, tests medium."""
    hits = lines_of(files).where(F.col("text").rlike(PLACEHOLDER))
    severity = F.when(F.col("path").rlike(r"(?i)(^|/)(gen|generated|vendor|third_party|node_modules)/"), "low").when(is_test_path("path"), "medium").otherwise("high")
    return hits.select("path", "line", F.trim("text").alias("text"), severity.alias("severity"))


def sentinel_bodies(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, severity): functions whose body is one sentinel value."""
    n = nodes.where("kind in ('function', 'method') and start_line is not null").select("id", "label", F.col("source_file").alias("path"), "start_line", "end_line")
    body = lines_of(files).join(n, "path").where("line > start_line and line <= end_line and trim(text) not in ('', '}', ')')")
    whole = body.groupBy("id", "label").agg(F.count("*").alias("lines"), F.count_if(F.col("text").rlike(SENTINEL)).alias("sentinels"))
    nullable = F.col("label").rlike(r"(?i)^(find|try|get|maybe|opt)")
    return whole.where("lines = 1 and sentinels = 1").select("id", F.when(nullable, "low").otherwise("medium").alias("severity"))


def rationale_notes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("file_type") == "rationale").where(F.upper("label").rlike("TODO|FIXME|HACK|XXX|NOTIMPLEMENTED")).select("id", "label")


def shadows(g: Graph) -> DataFrame:
    return g.edges.where("relation = 'shadows'").select("src", "dst").orderBy("src", "dst")


def node_impact(severity: Column, degree: Column, dependents: Column, generated: Column, test: Column) -> Column:
    """Base by severity, two a link up to 20, three a dependent up to 30; a third for generated code, ten less for tests."""
    base = F.when(severity == "high", BASE["high"]).when(severity == "medium", BASE["medium"]).otherwise(BASE["low"])
    raw = base + F.least(degree, F.lit(20)) * 2 + F.least(dependents, F.lit(30)) * 3
    return F.greatest(F.when(generated, F.floor(raw / 3)).otherwise(raw) - F.when(test, 10).otherwise(0), F.lit(0))


def subsystem_report(findings: DataFrame) -> DataFrame:
    """(subsystem, n, worst): findings (path, line, text, severity), distinct, by the first two folders."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    top = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    out = findings.dropDuplicates(["path", "line", "text"]).groupBy(top.alias("subsystem")).agg(F.count("*").alias("n"), F.min(rank).alias("rank"))
    return out.select("subsystem", "n", F.when(F.col("rank") == 0, "high").when(F.col("rank") == 1, "medium").otherwise("low").alias("worst")).orderBy(F.col("rank"), F.desc("n"), "subsystem")


def text_scan(files: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """(path, line, col): whole-word places of a name, in order, all to be reviewed; with ``most`` only the first so many."""
    quoted = r"\b\Q" + name + r"\E\b"
    hits = lines_of(files).where(F.contains("text", F.lit(name))).where(F.col("text").rlike(quoted))
    # Each place: the lengths of what stands before it add up.
    parts = F.split("text", quoted, -1)
    before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * len(name) + 1)
    places = hits.select("path", "line", F.explode(before).alias("col")).orderBy("path", "line", "col")
    return places if most is None else places.limit(most)


def candidates(nodes: DataFrame, name: str) -> DataFrame:
    """Located definitions of that name, by file and id."""
    return nodes.where((F.col("file_type") == "code") & (F.col("source_file") != "") & (F.lower(bare_name()) == name.lower())).orderBy("source_file", "id")


def select_target(nodes: DataFrame, name: str, node_id: str | None = None, file: str | None = None) -> tuple[str, list[str]]:
    some = candidates(nodes, name)
    if node_id is not None:
        some = some.where(F.col("id") == node_id)
    if file is not None:
        some = some.where(F.contains("source_file", F.lit(file)))
    ids = [r.id for r in some.limit(21).collect()]
    how = "one" if len(ids) == 1 else "none" if not ids else "ambiguous" if len(ids) <= 20 else "ambiguous-more"
    return how, ids[:20]


def rename_plan(g: Graph, target: str, new_name: str, files: DataFrame | None = None, depth: int = 2) -> dict[str, DataFrame]:
    """edits (certain sites), review (uncertain ones and text places), collisions, blast radius."""
    own = g.nodes.where(F.col("id") == target).select("label", "source_file").first()
    into = cut(g.edges.where((F.col("dst") == target) & ~F.col("relation").isin("contains", "method")).select("src", "relation", "confidence"), "into")
    sites = into.join(g.nodes.select(F.col("id").alias("src"), F.col("source_file").alias("path")), "src").select("src", "path", "relation", "confidence").distinct()
    clash = candidates(g.nodes, new_name).where(F.col("source_file") == own.source_file).select("id") if own else g.nodes.limit(0).select("id")
    review = sites.where("confidence <> 'EXTRACTED'")
    out = {"edits": sites.where("confidence = 'EXTRACTED'").orderBy("path", "src", "relation"), "review": review.orderBy("path", "src", "relation"), "collisions": clash, "blast": affected(g, [target], depth)}
    if files is not None and own is not None:
        out["text"] = text_scan(files, own.label.removesuffix("()"))
    return out


def relocate_plan(g: Graph, target: str, new_file: str, depth: int = 2) -> dict[str, DataFrame]:
    """One import update a file that refers to the target, collisions of base name, blast radius."""
    # One node's links are few: as a table they meet the nodes by broadcast, and no node moves.
    into = cut(g.edges.where((F.col("dst") == target) & ~F.col("relation").isin("contains", "method")).select("src"), "into")
    files = into.join(g.nodes.select(F.col("id").alias("src"), F.col("source_file").alias("path")), "src").where("path <> ''").select("path").distinct().orderBy("path")
    base = new_file.rsplit("/", 1)[-1]
    clash = g.nodes.where((F.element_at(F.split("source_file", "/"), -1) == base) & (F.col("source_file") != new_file)).select("source_file").distinct()
    return {"updates": files, "collisions": clash, "blast": affected(g, [target], depth)}


def verify_rename(before: Graph, after: Graph, old_id: str, new_id: str) -> dict[str, bool]:
    """Renamed, references kept, no other node lost."""
    ids = after.nodes.select("id")
    has = {r.id for r in ids.where(F.col("id").isin(old_id, new_id)).collect()}
    lost = before.nodes.where(F.col("id") != old_id).select("id").join(ids, "id", "left_anti")
    refs = lambda g, t: g.edges.where(F.col("dst") == t).select("src", "relation").distinct()
    return {
        "renamed": new_id in has and old_id not in has,
        "references_kept": not refs(before, old_id).where(F.col("src") != old_id).subtract(refs(after, new_id)).limit(1).take(1),
        "nothing_lost": not lost.limit(1).take(1),
    }

