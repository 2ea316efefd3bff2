import pytest
from loomgraph.graph import Graph
from loomgraph.operators import exports, setops, workflows
from pyspark.sql import functions as F


def make(spark, pairs, repo=None):
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, i.upper(), "code", f"m{i[0]}/sub/{i}.py", "class", "public", None, repo or i[0], n) for n, i in enumerate(ids)], "id string, label string, file_type string, source_file string, kind string, visibility string, community int, repo string, seq long")
    edges = spark.createDataFrame([(a, b, "calls", None, "EXTRACTED", 1.0) for a, b in pairs], "src string, dst string, relation string, context string, confidence string, weight double")
    return Graph(nodes, edges)


def test_clusters_with_a_hub(spark):
    left = [(f"a{i}", f"a{j}") for i in range(6) for j in range(i)]
    right = [(f"b{i}", f"b{j}") for i in range(6) for j in range(i)]
    hub = [("hub", x) for x in [f"a{i}" for i in range(6)] + [f"b{i}" for i in range(5)]]
    got = {r.id: r.community for r in workflows.cluster(make(spark, left + right + hub), 0.95).collect()}
    assert len(got) == 13 and len({got[f"a{i}"] for i in range(6)}) == 1 and got["a0"] != got["b0"] and got["hub"] == got["a0"] == 0


def test_bundle_and_bridges(spark):
    g = make(spark, [("a1", "a2"), ("a2", "b1"), ("b1", "b2"), ("b2", "a1")])
    out = workflows.analysis(g)
    assert {k: v.count() > 0 for k, v in out.items()} == {"gods": True, "surprises": True, "questions": True, "cycles": True}
    path = make(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert [(r.a, r.b) for r in workflows.bridging_links(path, 1).collect()] == [("b", "c")]


def test_merge_add_and_revisions(spark, tmp_path):
    one, two = make(spark, [("x", "y")]), make(spark, [("x", "z")])
    exports.write_json(one, f"{tmp_path}/p/g.json")
    exports.write_json(two, f"{tmp_path}/q/g.json")
    m = workflows.merge_files(spark, [f"{tmp_path}/p/g.json", f"{tmp_path}/q/g.json"])
    assert {r.id for r in m.nodes.collect()} == {"g::x", "g::y", "g-2::x", "g-2::z"}
    root = f"file://{tmp_path}/store"
    digest = workflows.global_add(root, "r1", one)
    assert digest and workflows.global_add(root, "r1", one, digest) is None
    from loomgraph.sources.store import write_store

    write_store(make(spark, [("a1", "b1"), ("a2", "b1")]), f"file://{tmp_path}/old")
    write_store(make(spark, [("a1", "b1"), ("b1", "c1")]), f"file://{tmp_path}/new")
    report = workflows.revision_report(spark, f"file://{tmp_path}/old", f"file://{tmp_path}/new")
    assert {(r.what, r.change, r.key) for r in report["diff"].collect()} == {("node", "removed", "a2"), ("node", "added", "c1"), ("edge", "removed", "a2|b1|calls"), ("edge", "added", "b1|c1|calls")}
    assert [(r.a, r.b, r.change) for r in report["dependencies"].collect()] == [("mb/sub", "mc/sub", "added")]


def test_targets_forecasts_notes(spark):
    g = make(spark, [("a1", "a2"), ("a2", "a3"), ("b1", "a3")])
    assert workflows.edit_target(g, "A3") == "a3"
    with pytest.raises(ValueError):
        workflows.edit_target(g, "A")
    assert [(r.repo, r.id, r.depth) for r in workflows.federated_forecast(g, ["a3"]).collect()] == [("a", "a2", 1), ("a", "a1", 2)]
    assert {r.path: r.text for r in workflows.notes(g).where(F.col("path") == "a1.md").collect()} == {"a1.md": "# A1\n\n- calls [[a2]]\n"}
    f = spark.createDataFrame([("x", 100, 0, 0, 0, 0)], "file string, dependents int, files int, public_api int, communities int, untested int")
    n = spark.createDataFrame([("x", 300, 300)], "path string, added int, deleted int")
    r = workflows.refine_risk(f, n).first()
    assert (r.score, r.band, r.factors) == (40, "medium", ["dependents", "churn"])
    assert setops.same_topology(g, g)
