"""Degrees, neighbours, sizes and node predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..schemas import type_like


def lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): links at either end; parallel links count, a loop counts once."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def fan(edges: DataFrame, out: bool, relations: list[str] | None = None) -> DataFrame:
    """(id, fan_out) or (id, fan_in): distinct neighbours other than itself."""
    here, there = ("src", "dst") if out else ("dst", "src")
    some = edges if relations is None else edges.where(F.col("relation").isin(relations))
    pairs = some.where("src <> dst").select(F.col(here).alias("id"), F.col(there).alias("n")).distinct()
    return pairs.groupBy("id").agg(F.count("*").alias("fan_out" if out else "fan_in"))


def structural(edges: DataFrame) -> DataFrame:
    """Links that carry weight and are not mere candidates."""
    return edges.where("weight > 0 and relation <> 'calls_sdk'")


def degree_map(edges: DataFrame) -> DataFrame:
    """(id, neighbours): distinct structural neighbours in either direction."""
    e = structural(edges).where("src <> dst")
    # Dealt by node once: hardly any pair repeats, so a combine before the shuffle would only hold them all.
    pairs = e.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionAll(e.select(F.col("dst").alias("id"), F.col("src").alias("n"))).repartition("id").distinct()
    return pairs.groupBy("id").agg(F.count("*").alias("neighbours"))


def span_loc(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def effective_loc(g: Graph) -> DataFrame:
    """(id, effective_loc): for type-like nodes the extent of itself and its members in the same file, else its own loc.

    Spans are start_line and end_line; nodes without one count by their members only.
    """
    n = g.nodes.select("id", "kind", "source_file", "start_line", "end_line")
    members = g.edges.where("relation in ('contains', 'method')").select("src", "dst").distinct()
    m = n.select(F.col("id").alias("dst"), F.col("source_file").alias("mf"), F.col("start_line").alias("ms"), F.col("end_line").alias("me"))
    owned = members.join(m, "dst").join(n.select(F.col("id").alias("src"), F.col("source_file").alias("of")), "src").where("mf = of")
    extent = owned.groupBy(F.col("src").alias("id")).agg(F.min("ms").alias("ms"), F.max("me").alias("me"))
    out = n.join(extent, "id", "left")
    own = span_loc(F.col("start_line"), F.col("end_line"))
    whole = span_loc(F.least("start_line", "ms"), F.greatest("end_line", "me"))
    return out.select("id", F.when(type_like("kind"), whole).otherwise(own).alias("effective_loc"))


def bare_name(label: str | Column = "label") -> Column:
    """A label without one trailing pair of parentheses."""
    return F.regexp_replace(F.col(label) if isinstance(label, str) else label, r"\(\)$", "")


# Languages by file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "lua": "lua", "sh": "bash", "bash": "bash", "ps1": "powershell", "ex": "elixir", "exs": "elixir", "jl": "julia", "zig": "zig",
    "sql": "sql", "md": "markdown", "yml": "yaml", "yaml": "yaml", "tf": "hcl", "dart": "dart", "groovy": "groovy",
}


def language(path: str | Column = "source_file") -> Column:
    """Language of a path: by its extension, else the extension itself in lower case; null without one."""
    base = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    ext = F.lower(F.substring_index(base, ".", -1))
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(F.contains(base, F.lit(".")), F.coalesce(F.try_element_at(known, ext), ext))


def node_props(g: Graph) -> DataFrame:
    """The wide view that queries read: kind, name, file, lang, visibility, loc, fan_in, fan_out, degree, community and more.

    A query that uses few of them prunes the joins' columns; degrees are joined
    only by those who ask (see plans.builder).
    """
    n = g.nodes
    loc = F.col("loc") if "loc" in n.columns else span_loc(F.col("span.start_line"), F.col("span.end_line"))
    extra = lambda name: F.get_json_object("extra", f"$.{name}") if "extra" in n.columns else F.lit(None).cast("string")
    return n.select(
        "id", "label", F.col("kind"), bare_name().alias("name"), F.col("source_file").alias("file"), language().alias("lang"), "visibility", loc.cast("double").alias("loc"),
        F.col("community").cast("double").alias("community"), extra("rls_enabled").alias("rls_enabled"), extra("dialect").alias("dialect"), extra("operation").alias("operation"), extra("node_type").alias("node_type"),
    )


def is_test_path(path: str | Column = "source_file") -> Column:
    """A test by a folder name or by the usual names of test files."""
    p = F.lower(F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/"))
    parts = F.split(p, "/")
    folder = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin("test", "tests", "__tests__", "testing"))
    base = F.element_at(parts, -1)
    return folder | base.rlike(r"^test_.*\.py$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$")


def code_symbol(nodes: DataFrame) -> DataFrame:
    node_type = F.coalesce(F.get_json_object("extra", "$.node_type"), F.lit("")) if "extra" in nodes.columns else F.lit("")
    return nodes.where((F.col("file_type") == "code") & ~node_type.isin("config_key", "config_resource"))


def external_stub() -> Column:
    return F.coalesce(F.col("source_file"), F.lit("")) == ""


def normal_path(path: str | Column, root: str = "") -> Column:
    p = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/")
    return F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p) if root else p


def clean_label(label: str | Column) -> Column:
    """Without control characters, 256 characters at most."""
    return F.substring(F.regexp_replace(F.col(label) if isinstance(label, str) else label, "[\\x00-\\x1f\\x7f]", ""), 1, 256)
