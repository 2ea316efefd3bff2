"""Text exports of graphs: node-link JSON, GraphML, Cypher, DOT, Mermaid, file tree, wiki pages, report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..schemas import confidence_score
from .analytics import cohesion, god_nodes, stats, surprising


def _xml(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def graphml(g: Graph) -> DataFrame:
    """(part, ord, line) of a GraphML document; write them sorted."""
    head = g.spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, ord string, line string")
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="label">'), _xml(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "relation", "context").alias("ord"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('" label="'), _xml(F.col("relation")), F.lit('"/>')).alias("line"))
    return head.unionAll(n).unionAll(e).orderBy("part", "ord")


def cypher(g: Graph) -> DataFrame:
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit("MERGE (n:Node {id: "), _quoted(F.col("id")), F.lit("}) SET n.label = "), _quoted(F.col("label")), F.lit(";")).alias("line"))
    rel = F.upper(F.regexp_replace("relation", r"\W", "_"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "relation", "context").alias("ord"), F.concat(F.lit("MATCH (a:Node {id: "), _quoted(F.col("src")), F.lit("}), (b:Node {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), rel, F.lit("]->(b);")).alias("line"))
    return n.unionAll(e).orderBy("part", "ord")


def dot(g: Graph) -> DataFrame:
    head = g.spark.createDataFrame([(0, "", "digraph G {"), (3, "", "}")], "part int, ord string, line string")
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.col("label")), F.lit("];")).alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "relation", "context").alias("ord"), F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [label="), _quoted(F.col("relation")), F.lit("];")).alias("line"))
    return head.unionAll(n).unionAll(e).orderBy("part", "ord")


def mermaid(g: Graph, relations: tuple[str, ...] = ("calls", "invokes", "calls_service")) -> DataFrame:
    name = lambda c: F.regexp_replace(c, r"\W", "_")
    head = g.spark.createDataFrame([(0, "", "flowchart LR")], "part int, ord string, line string")
    e = g.edges.where(F.col("relation").isin(*relations)).select("src", "dst").distinct()
    return head.unionAll(e.select(F.lit(1).alias("part"), F.concat_ws("|", "src", "dst").alias("ord"), F.concat(F.lit("  "), name(F.col("src")), F.lit(" --> "), name(F.col("dst"))).alias("line"))).orderBy("part", "ord")


def file_tree(g: Graph) -> DataFrame:
    """(folder, file, symbols): symbols of each file in order of their names."""
    n = g.nodes.where("source_file <> ''")
    return n.groupBy(F.regexp_replace("source_file", "/?[^/]*$", "").alias("folder"), F.element_at(F.split("source_file", "/"), -1).alias("file")).agg(F.array_sort(F.collect_list("label")).alias("symbols")).orderBy("folder", "file")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, in order."""
    lines.orderBy("part", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def wiki_pages(g: Graph, most: int = 50) -> DataFrame:
    """(community, page): a Markdown page with the first members and the cohesion."""
    order = Window.partitionBy("community").orderBy("label", "id")
    n = g.nodes.where("community is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    lists = n.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), "label").alias("line")))).alias("l"))
    j = lists.join(cohesion(g), "community")
    text = F.concat(F.lit("# Community "), F.col("community").cast("string"), F.lit("\n\nsize "), F.col("size").cast("string"), F.lit(", cohesion "), F.format_number("cohesion", 3), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x.line), "\n"))
    return j.select("community", text.alias("page"))


#: Communities that a report lists; it says how many more there are.
COMMUNITIES = 50


def report(g: Graph, thin: int = 3) -> str:
    """A Markdown report of small aggregates: overview, hubs, surprises, communities."""
    s = stats(g).first()
    shown = cohesion(g).where(F.col("size") >= thin).orderBy(F.desc("size"), "community")
    total = max(s.edges, 1)
    out = ["# Graph report", "", f"{s.nodes} nodes, {s.edges} links, {s.communities} communities", f"extracted {100 * s.extracted // total} %, inferred {100 * s.inferred // total} %, ambiguous {100 * s.ambiguous // total} %", "", "## Hubs"]
    out += [f"- {r.label}: {r.neighbours}" for r in god_nodes(g, 10).collect()]
    out += ["", "## Surprises"] + [f"- {r.src_label} {r.relation} {r.dst_label} ({r.score:g})" for r in surprising(g, 5).collect()]
    out += ["", "## Communities"] + [f"- {r.community}: {r['size']} nodes, cohesion {r.cohesion:.3f}" for r in shown.limit(COMMUNITIES).collect()]
    more = shown.count() - COMMUNITIES
    out += [f"- and {more} more"] if more > 0 else []
    return "\n".join(out) + "\n"


def node_link(g: Graph) -> DataFrame:
    """One column of JSON: a row a node and a row a link (part, ord, line), with the norm_label and scores that readers expect."""
    norm = F.trim(F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]+", " "))
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.to_json(F.struct(*g.nodes.columns, norm.alias("norm_label"))).alias("line"))
    cols = [F.col(c) for c in g.edges.columns if c not in ("src", "dst", "confidence_score")]
    score = F.coalesce(F.col("confidence_score") if "confidence_score" in g.edges.columns else F.lit(None).cast("float"), confidence_score("confidence"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "relation", "context").alias("ord"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *cols, score.alias("confidence_score"))).alias("line"))
    return n.unionAll(e)


def write_json(g: Graph, path: str) -> None:
    """A node-link JSON document in one text file.  For graphs that a single file can hold; see sources.store for the others."""
    rows = node_link(g)
    parts = {1: "nodes", 2: "links"}
    first = Window.partitionBy("part").orderBy("ord")
    lines = rows.select("part", "ord", F.concat(F.when(F.row_number().over(first) > 1, F.lit(",")).otherwise(F.lit("")), "line").alias("line"))
    frame = [(0, "", json.dumps({"directed": g.directed, "multigraph": True, "graph": {}, "built_at_commit": g.commit})[:-1] + f', "{parts[1]}": ['), (1, "￿", f'], "{parts[2]}": ['), (2, "￿", "]}")]
    write_lines(lines.unionAll(g.spark.createDataFrame(frame, "part int, ord string, line string")), path)
