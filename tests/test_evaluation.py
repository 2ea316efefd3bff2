import pytest
from loomgraph.functions import version
from loomgraph.graph import Graph
from loomgraph.operators import evaluation, memory, sqlaudit, vuln


def make(spark, pairs, relation="calls"):
    ids = sorted({x for p in pairs for x in p[:2]})
    nodes = spark.createDataFrame([(i, f"{i}()", f"tests/test_{i}.py" if i.startswith("t") else f"src/{i}.py") for i in ids], "id string, label string, source_file string")
    edges = spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else relation, None, "EXTRACTED", 1.0) for p in pairs], "src string, dst string, relation string, context string, confidence string, weight double")
    return Graph(nodes, edges)


def test_labels_and_edges(spark):
    g = make(spark, [("entry", "middle"), ("middle", "base"), ("t1", "entry"), ("other", "lone")])
    labels = spark.createDataFrame([("src/base.py::base",), ("src/none.py::x",)], "label string")
    assert [(r.label, r.id) for r in evaluation.resolve_labels(g, labels).collect()] == [("src/base.py::base", "base")]
    truth = spark.createDataFrame([("entry", "middle"), ("middle", "gone")], "src string, dst string")
    r = evaluation.edge_scores(g.edges, truth).first()
    assert (r.n_predicted, r.n_relevant, r.hits, r.precision, r.recall) == (2, 2, 1, 50, 50)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    b = evaluation.blast_score(g, "base", ids("middle", "entry", "t1", "zz"), ids("other", "lone")).first()
    assert (b.expected, b.found, b.missed, b.leaked, b.recall) == (4, 3, 1, 0, 75)
    links = spark.createDataFrame([("t1", True), ("t2", True), ("t3", False)], "test string, expected boolean")
    assert evaluation.affected_tests(g, ["base"], links).first().recall == 50


def test_crossing(spark):
    g = make(spark, [("a", "route", "calls_service"), ("route", "h", "handled_by"), ("b", "lost", "calls_service")])
    pairs = spark.createDataFrame([("a", "h", True), ("b", "h", False), ("b", "h2", True)], "src string, dst string, expected boolean")
    r = evaluation.cross_scores(g, pairs).first()
    assert (r.n_predicted, r.n_relevant, r.hits) == (1, 2, 1)
    assert {(r.relation, r.edges, r.two_sided) for r in evaluation.boundary_calibration(g).collect()} == {("calls_service", 2, 1), ("handled_by", 1, 1)}


def test_anchors_and_indexes(spark):
    nodes = spark.createDataFrame([("a.py", 1, "foo()"), ("a.py", 2, "bar()"), ("b.go", 9, "x")], "source_file string, start_line int, label string")
    files = spark.createDataFrame([("a.py", "def foo():\n  pass"), ("b.go", "x")], "path string, content string")
    assert {(r.lang, r.anchors, r.exact) for r in evaluation.anchor_exactness(nodes, files).collect()} == {("python", 2, 1), ("go", 1, 0)}
    s = "lang string, file string, name string"
    a, b = spark.createDataFrame([("py", "f", "x"), ("py", "f", "y")], s), spark.createDataFrame([("py", "f", "y"), ("py", "f", "z"), ("py", "f", "z")], s)
    assert tuple(evaluation.index_diff(a, b).first()) == ("py", 1, 1, 1)
    assert evaluation.gate({"mrr": 0.5}, {"mrr": 0.6, "recall": 0.1}) == ["mrr is 0.500, below 0.600", "recall is 0.000, below 0.100"]
    cases = spark.createDataFrame([(["a", "b"], ["a"], 3), ([], ["z"], 5)], "predicted array<string>, relevant array<string>, delay int")
    assert tuple(evaluation.historical(cases).first()) == (2, 0.25, 0.5, 4.0)


@pytest.mark.parametrize(
    ("v", "req", "ok"),
    [("1.2.3", "^1.2", True), ("2.0.0", "^1.2", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", ">=1.2, <1.5", False), ("1.4.9", ">=1.2, <1.5", True), ("1.2.7", "1.2.*", True), ("1.3.0", "1.2.*", False), ("3.0", "*", True), ("x", "^1", None), ("1.0", "=1.0.0", True)],
)
def test_requirements(v, req, ok):
    assert version.satisfies(v, req) is ok


def test_dependency_check(spark):
    adv = spark.createDataFrame(
        [("A1", False, [], [("npm", "left", None, [("SEMVER", [("introduced", "0"), ("fixed", "1.2.0")])])])],
        "id string, withdrawn boolean, severity array<struct<kind:string,score:string>>, affected array<struct<ecosystem:string,name:string,versions:array<string>,ranges:array<struct<kind:string,events:array<struct<type:string,bound:string>>>>>>",
    )
    rules = spark.createDataFrame([(1, "bad", "deny", None, None), (2, "left", "pin", "1.1.0", None)], "ord int, package string, action string, version string, expires string")
    check = lambda n, v: vuln.dependency_check(spark, "npm", n, v, adv, rules, "2024-01-01")
    assert check("bad", "1.0") == ("blocked", None) and check("left", "1.0.0") == ("constrained", "1.2.0") and check("left", "1.3.0") == ("allowed", "1.1.0") and check("free", "9.9") == ("allowed", None)


def test_memory_rules(spark, tmp_path):
    schema = "id string, kind string, title string, summary string, repository string, workspace string, owner string, access_scope string, lifecycle string, verification string, confidence float, occurred_at long, recorded_at long, affected_symbols array<struct<label:string,node_id:string>>, sources array<struct<uri:string>>, links array<struct<relation:string,target:string>>"

    def rec(i, title, scope="repository", repo="r", owner="me", links=(), lifecycle="active", t=1):
        return (i, "decision", title, "", repo, "w", owner, scope, lifecycle, "none", 0.0, t, t, [("Parser", "n1")] if i == "s" else [], [], list(links))

    store = spark.createDataFrame([rec("a", "parser choice"), rec("b", "parser old", links=[("supersedes", "a")]), rec("c", "parser secret", scope="private", owner="you"), rec("d", "parser else", repo="q"), rec("e", "parser gone", lifecycle="retracted"), rec("s", "other", t=5)], schema)
    me = memory.Principal("me", repositories=("r",))
    assert [r.id for r in memory.search(store, me, "parser").collect()] == ["b"]
    assert [r.id for r in memory.search(store, me, symbol="pars").collect()] == ["s"]
    assert [r.id for r in memory.search(store, me).collect()] == ["s", "b"]
    assert {r.id for r in memory.search(store, memory.Principal("you", repositories=("*",)), "parser").collect()} == {"b", "c", "d"}
    digest = memory.export_bundle(store, me, f"{tmp_path}/b")
    merged = memory.import_bundle(store.where("id = 'd'"), f"{tmp_path}/b", digest)
    assert {r.id for r in merged.collect()} == {"a", "b", "d", "e", "s"}
    with pytest.raises(ValueError):
        memory.import_bundle(store, f"{tmp_path}/b", "0")


def test_advice(spark):
    n = [("t", "accounts", "table", "{}"), ("c1", "accounts.tenant_id", "column", "{}"), ("c2", "accounts.name", "column", "{}")]
    e = [("t", "c1", "has_column"), ("t", "c2", "has_column")]
    g = Graph(spark.createDataFrame(n, "id string, label string, kind string, extra string"), spark.createDataFrame([(*x, None, None) for x in e], "src string, dst string, relation string, context string, extra string"))
    got = {(r.rule_id, r.detail) for r in sqlaudit.advise(g, "SELECT * FROM accounts JOIN missing ON 1 = 1 WHERE name = 'x'").collect()}
    assert got == {("PERF-SEL-001", "query text"), ("ADV-TABLE-404", "missing"), ("SEC-RLS-001", "accounts"), ("PERF-IDX-001", "name")}
    assert sqlaudit.parses("SELECT a FROM t WHERE b = %s", spark) and not sqlaudit.parses("SELEC a", spark)
    assert sqlaudit.explain_signal("Seq Scan on t  (cost=0.00..35.50 rows=2550 width=4)") == (True, 35.5, 2550)
