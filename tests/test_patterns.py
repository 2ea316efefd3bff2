import pytest
from loomgraph.graph import Graph
from loomgraph.plans import builder, patterns
from loomgraph.plans.lexer import QueryError
from loomgraph.plans.parser import parse


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(
        [
            ("a", "A", "code", "src/a.py", 1, "r1", "class", "public", 600, 1),
            ("b", "b()", "code", "src/a.py", 1, "r1", "function", "private", 5, 2),
            ("c", "C", "code", "src/c.rs", 2, "r1", "class", None, None, 3),
            ("d", "d()", "code", "lib/d.go", None, "r2", "function", "public", 12, 4),
            ("e", "e()", "code", "lib/noext", 10, "r2", None, "public", 9, 5),
        ],
        "id string, label string, file_type string, source_file string, community int, repo string, kind string, visibility string, loc int, seq long",
    )
    edges = spark.createDataFrame(
        [("a", "b", "calls", None), ("b", "c", "calls", None), ("c", "a", "calls", None), ("a", "a", "calls", None), ("a", "b", "uses", "x"), ("a", "b", "uses", "y"), ("d", "e", "calls", None), ("c", "d", "calls", None)],
        "src string, dst string, relation string, context string",
    ).selectExpr("*", "'EXTRACTED' confidence", "1.0D weight", "1L n_sites")
    return Graph(nodes, edges)


def rows(g, q):
    return [tuple(r) for r in builder.run(g, q).collect()]


def test_rows_are_sorted_and_distinct(g):
    assert rows(g, "MATCH (x)-[]->(y) RETURN x, y") == [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    assert rows(g, "MATCH (x)-[:uses]->(y) RETURN y") == [("b",)]
    assert rows(g, "MATCH (x)<-[:calls]-(y:CLASS) RETURN x LIMIT 2") == [("a",), ("b",)]


def test_walks_are_by_level(g):
    # a -> {a, b} -> c -> {a, d}: from a the levels are 1: a, b; 2: c; 3: a, d; 4: e.
    assert rows(g, 'MATCH (x)-[:calls*2..3]->(y) WHERE x.name = "A" RETURN y') == [("a",), ("c",), ("d",)]
    assert rows(g, 'MATCH (x)-[:calls*4]->(y) WHERE x.name = "A" RETURN y') == [("e",)]
    assert rows(g, 'MATCH (x)-[:calls*]->(y) WHERE x.name = "b" RETURN y') == [("a",), ("b",), ("c",), ("d",), ("e",)]


def test_missing_values_compare_false(g):
    assert rows(g, "MATCH (x) WHERE x.loc > 5 RETURN x") == [("a",), ("d",), ("e",)]
    assert rows(g, "MATCH (x) WHERE NOT x.loc > 5 RETURN x") == [("b",), ("c",)]
    assert rows(g, "MATCH (x) WHERE x.loc != 5 RETURN x") == [("a",), ("d",), ("e",)]
    assert rows(g, 'MATCH (x) WHERE x.loc != "5" RETURN x') == [("a",), ("b",), ("d",), ("e",)]
    assert rows(g, 'MATCH (x) WHERE x.loc = "5" RETURN x') == []
    assert rows(g, 'MATCH (x) WHERE has(x, "async") RETURN x') == []


def test_groups_are_text(g):
    assert rows(g, "MATCH (x) RETURN x.community, count(*)") == [("", 1), ("1", 2), ("10", 1), ("2", 1)]
    assert rows(g, "MATCH (x) RETURN x.community LIMIT 2") == [("",), ("1",)]
    assert rows(g, "MATCH (x:trait) RETURN count(x)") == [] and rows(g, "MATCH (x) RETURN count(x)") == [(5,)]
    assert rows(g, "MATCH (x)-[:calls]->(y) RETURN x, count(y)") == [("A", 2), ("C", 2), ("b()", 1), ("d()", 1)]
    assert rows(g, "MATCH (x) RETURN x.lang, x.name") == [("", "e"), ("go", "d"), ("python", "A"), ("python", "b"), ("rust", "C")]


def test_degrees_and_regex(g):
    assert rows(g, "MATCH (x) WHERE x.fan_out >= 2 RETURN x.name, x.fan_out, x.fan_in, x.degree") == [("C", "2", "1", "3")]
    assert rows(g, 'MATCH (x) WHERE x.file =~ "^src/.*py$" OR x.visibility = "public" AND x.loc < 10 RETURN x') == [("a",), ("b",), ("e",)]


def test_repeated_variable_is_bound_anew(g):
    assert rows(g, "MATCH (x)-[:calls]->(y)-[:calls]->(x) RETURN x, y") == [("a", "a"), ("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")]


def test_federated_has_no_match_across_repos(g):
    got = [tuple(r) for r in builder.run_federated(g, "MATCH (x)-[:calls]->(y) RETURN x, y").collect()]
    assert got == [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")]


@pytest.mark.parametrize("bad", ["", "MATCH x RETURN x", "MATCH (x) RETURN y", "MATCH (x) WHERE y.loc > 1 RETURN x", "MATCH (x) WHERE x.size > 1 RETURN x", 'MATCH (x) WHERE x.name =~ "(" RETURN x', "MATCH (x) RETURN x LIMIT 1.5", "MATCH (x)<-[]->(y) RETURN x", 'MATCH (x) WHERE x.name =~ "(?=a)" RETURN x', "MATCH (x) RETURN x; DROP"])
def test_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_explain(g):
    assert builder.explain("MATCH (x:class)-[:calls*2..3]->(y) WHERE x.loc > 1 RETURN x.kind, count(y) LIMIT 3") == ["SCAN x kind=class", "JOIN -> calls *2..3 y", "FILTER x.loc >", "AGGREGATE x_kind, count_y", "LIMIT 3"]


def test_named_patterns(spark):
    n = [("S", "class", 0), ("get", "method", 0), ("I", "interface", 0), ("X", "class", 1), ("Y", "class", 2), ("make", "function", 3), ("O", "class", 0)]
    nodes = spark.createDataFrame([(i, i, k, c, "f", 600 if i == "X" else 3, "{}" if i != "O" else '{"node_type": "route"}') for i, k, c in n], "id string, label string, kind string, community int, source_file string, loc int, extra string")
    e = [("S", "get", "method", None), ("get", "S", "references", "return_type"), ("X", "I", "implements", None), ("Y", "I", "implements", None), ("make", "I", "references", "return_type"), ("O", "I", "references", "field"), ("make", "S", "calls", None), ("X", "S", "calls", None), ("Y", "S", "calls", None), ("X", "O", "calls_service", None)]
    edges = spark.createDataFrame(e, "src string, dst string, relation string, context string").selectExpr("*", "'EXTRACTED' confidence", "1.0D weight")
    g = Graph(nodes, edges)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(patterns.singletons(g)) == ["S"] and ids(patterns.factories(g)) == ["make"] and ids(patterns.observers(g)) == ["O"]
    assert ids(patterns.service_locators(g)) == ["S"] and ids(patterns.dangling_endpoints(g)) == ["O"]
    assert ids(patterns.god_classes(g, out=2)) == ["X"]
    with pytest.raises(ValueError):
        patterns.service_locators(g.with_(nodes=nodes.withColumn("community", nodes.community.cast("int") * None)))
