"""Rows that meet at one name, file or node do not multiply, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import analytics, contracts, pulls, resolution
from loomgraph.plans import patterns
from loomgraph.sources import tables

N = 300


def most_rows(df):
    """The most rows that one step of the plan put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            m = p.metrics().get("numOutputRows")
            most = max(most, m.get().value()) if m.isDefined() else most
            todo.extend(p.children().apply(i) for i in range(p.children().size()))
    return most


def test_chain_references(spark):
    nodes = spark.range(N).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("function").alias("kind")).unionAll(spark.createDataFrame([("c", "class"), ("d", "class")], "id string, kind string"))
    edges = spark.range(N).select(F.lit("m").alias("src"), F.concat(F.lit("t"), F.col("id") % 100).alias("dst"), F.lit("implements").alias("relation"), F.lit(None).cast("string").alias("context"))
    edges = edges.unionAll(spark.range(2).select(F.concat(F.lit("x"), "id"), F.lit("t0"), F.lit("implements"), F.lit(None).cast("string")))
    edges = edges.unionAll(spark.createDataFrame([("c", "f1", "method", None)], edges.schema))
    left = spark.range(N).select(F.concat(F.lit("f"), "id").alias("src"), F.lit("m").alias("mid"))
    right = spark.range(N).select(F.lit("m").alias("mid"), F.concat(F.lit("t"), "id").alias("dst")).unionAll(spark.createDataFrame([("m", "c")], "mid string, dst string"))
    g, chain = Graph(nodes, edges), (patterns.Chain("return_type", left, right),)
    found = patterns.factories(g, chain)
    assert found.count() == N and most_rows(found) < 10 * N
    assert [r.id for r in patterns.singletons(g, chain).collect()] == ["c"]
    assert patterns.observers(g, chain).count() == 0


def test_pull_impact_counts_files_first(spark):
    nodes = spark.range(N).select(F.col("id").cast("string").alias("id"), F.lit("a/x.py").alias("source_file"), (F.col("id") % 3).cast("int").alias("community"))
    nodes = nodes.unionAll(spark.createDataFrame([("0", "b/y.py", 7)], nodes.schema))
    files = spark.range(N).select("id", F.lit("x.py").alias("path")).withColumnRenamed("id", "number").unionAll(spark.createDataFrame([(0, "y.py"), (5, "none.py")], "number long, path string"))
    out = pulls.impact(files, Graph(nodes, no_edges(spark)))
    got = {r.number: (r.communities, r.nodes) for r in out.collect()}
    assert len(got) == N and got[0] == (4, N) and got[5] == (3, N)
    assert most_rows(out) < 10 * N


def no_edges(spark):
    return spark.createDataFrame([], "src string, dst string, relation string, context string, confidence string, weight double")


def test_calls_do_not_meet_all_symbols_of_a_name(spark):
    nodes = spark.range(N).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("same").alias("label"), F.concat(F.lit("a"), "id", F.lit(".py")).alias("source_file"), F.lit("interface").alias("kind"))
    nodes = nodes.unionAll(spark.createDataFrame([("k", "lone", "k.py", "interface"), ("p", "two", "p.py", "function"), ("q", "two", "q.py", "interface")], nodes.schema))
    name = F.when(F.col("id") == 0, "lone").when(F.col("id") == 1, "two").otherwise("same")
    calls = spark.range(N).select(F.concat(F.lit("c"), "id").alias("call"), F.lit("s").alias("src"), name.alias("name"), F.lit("a/x.py").alias("file"), F.lit(None).cast("string").alias("receiver"))
    imports = spark.createDataFrame([], "file string, target_file string, name string, sourced boolean")
    got = resolution.resolve_calls(Graph(nodes, no_edges(spark)), calls, imports).collect()
    assert {(r.call, r.target, r.step) for r in got} == {("c0", "k", "unique"), ("c1", "p", "unique")}
    one = resolution._ends(nodes.withColumnRenamed("label", "name"), "name")
    assert one.count() == 3


def test_hosts_meet_calls_by_broadcast(spark):
    calls = spark.range(N).select(F.lit("s").alias("src"), F.lit("h").alias("host"), F.lit("POST").alias("method"), F.concat(F.lit("/p/"), "id").alias("path"), F.lit("a").alias("source_file"), F.lit("L1").alias("source_location"))
    hosts = spark.createDataFrame([("h", "v")], "host string, vendor string")
    ops = spark.range(N).select(F.lit("v").alias("vendor"), F.lit("POST").alias("method"), F.concat(F.lit("/p/"), "id").alias("canonical_path"), F.concat(F.lit("k"), "id").alias("key"))
    out = contracts.bind_http(calls, hosts, ops)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == N and "SortMergeJoin [host" not in plan


def test_modularity_of_pairs_in_several_rows(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "id string, l int")
    once = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 1.0)], "a string, b string, w double")
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 1.0)], "a string, b string, w double")
    assert analytics.modularity(once, labels) == pytest.approx(analytics.modularity(rows, labels))


def test_graph_diff_meets_once(spark):
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([("a", "b", "uses"), ("b", "a", "uses")], "src string, dst string, relation string")
    out = analytics.graph_diff(Graph(n("a", "b"), e), Graph(n("b", "c"), e.limit(0)))
    assert {tuple(r) for r in out.collect()} == {("node", "removed", "a"), ("node", "added", "c"), ("edge", "removed", "a|b|uses")}
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()


def test_links_of_one_target_are_read_without_a_store(spark):
    g = tables.graph_from_tables(spark, "/root/testdata/sf0.001")
    plan = g.edges.where("dst = 'part:9' and relation = 'uses'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") + plan.count("l_orderkey") and "o_custkey" not in plan and "n_regionkey" not in plan


def test_merged_links_are_assembled_links(spark):
    from loomgraph.operators.build import assemble_edges

    want = assemble_edges(tables.links(spark, "/root/testdata/sf0.001"))
    got = tables.graph_from_tables(spark, "/root/testdata/sf0.001").edges.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
