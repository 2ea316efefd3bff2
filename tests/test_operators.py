import random
from itertools import permutations

import loomgraph.graph as graphs
import pytest
from loomgraph.functions import text, version
from loomgraph.graph import Graph
from loomgraph.operators import analytics, build, community, contracts, dedup, exports, history, metrics, pulls, readiness, retrieval, setops, sqlaudit, traversal, vuln
from pyspark.sql import functions as F

E = "src string, dst string, relation string, context string, confidence string, weight double, seq long"


def graph(spark, pairs, extra=None, relation="calls"):
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra or ()))
    nodes = spark.createDataFrame([(i, i, "code", f"m{i[0]}/{i}.py", "class", "public", n % 2, "r", n) for n, i in enumerate(ids)], "id string, label string, file_type string, source_file string, kind string, visibility string, community int, repo string, seq long")
    edges = spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else relation, None, "EXTRACTED", 1.0, n) for n, p in enumerate(pairs)], E)
    return Graph(nodes, edges)


# Building


def test_links_merge_by_identity(spark):
    rows = [("a", "b", "calls", None, "EXTRACTED", 1.0, 2), ("a", "b", "calls", None, "INFERRED", 2.0, 1), ("a", "b", "calls", "x", "EXTRACTED", 1.0, 3), ("b", "a", "calls", None, "AMBIGUOUS", 1.0, 0)]
    links = spark.createDataFrame(rows, E)
    got = {(r.src, r.dst, r.context): (r.confidence, r.n_sites) for r in build.assemble_edges(links).collect()}
    assert got == {("a", "b", None): ("INFERRED", 2), ("a", "b", "x"): ("EXTRACTED", 1), ("b", "a", None): ("AMBIGUOUS", 1)}
    assert {(r.src, r.dst, r.context): r.n_sites for r in build.assemble_edges(links, directed=False).collect()} == {("a", "b", None): 3, ("a", "b", "x"): 1}


def test_build_upserts_maps_ghosts_and_drops_dangling(spark):
    n = spark.createDataFrame(
        [("a", "A", "code", "x/a.py", "ast", 1), ("a", "A", "code", "", None, 5), ("g", "A", "code", "y/a.py", None, 2), ("b", "B", "code", "b.py", "ast", 3)], "id string, label string, file_type string, source_file string, origin string, seq long"
    )
    links = spark.createDataFrame([("b", "g", "calls", None, "EXTRACTED", 1.0, 1), ("b", "zz", "calls", None, "EXTRACTED", 1.0, 2), ("a", "g", "calls", None, "EXTRACTED", 1.0, 3)], E)
    g = build.build(n, links)
    assert {(r.id, r.source_file, r.seq) for r in g.nodes.collect()} == {("a", "x/a.py", 1), ("b", "b.py", 3)}
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("b", "a")]


def test_validation_reports_rows(spark):
    n = spark.createDataFrame([("a", None, "code", "f"), ("b", "B", "nonsense", "f")], "id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("a", "zz", "calls", "SURE")], "src string, dst string, relation string, confidence string")
    assert {(r.part, r.problem) for r in build.validate(n, e).collect()} == {("node", "missing label"), ("node", "unknown file_type"), ("edge", "unknown confidence"), ("edge", "dst is no node")}


# Traversal


def test_shortest_path_and_ties(spark):
    g = graph(spark, [("a", "b"), ("b", "d"), ("a", "c", "references"), ("c", "d", "references"), ("d", "e")], extra=["z"])
    assert traversal.shortest_path(g, "a", "e") == ["a", "b", "d", "e"]
    assert traversal.shortest_path(g, "e", "a") == ["e", "d", "b", "a"]
    assert traversal.shortest_path(g, "a", "a") == ["a"]
    assert traversal.shortest_path(g, "a", "z") is None and traversal.shortest_path(g, "a", "nobody") is None


def test_affected_levels_and_exclusion(spark):
    g = graph(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("c", "a", "uses")])
    got = lambda **k: {(r.id, r.depth, r.via) for r in traversal.affected(g, depth=3, **k).collect()}
    assert got(seeds=["a"]) == {("b", 1, "calls"), ("c", 1, "uses"), ("d", 2, "calls")}
    assert got(seeds=["a", "b"]) == {("c", 1, "calls"), ("d", 2, "calls")}
    assert got(seeds=["a", "b"], exclude=["a"]) == {("b", 1, "calls"), ("c", 1, "calls"), ("d", 2, "calls")}
    assert got(seeds=["nobody"]) == set()


def test_resolve_cascade(spark):
    n = spark.createDataFrame([("x1", "Foo()", "a/x.py"), ("x2", "foo", "b/y.py"), ("x3", "Foobar", "c/z.py"), ("x4", "Other", "d/w.py")], "id string, label string, source_file string")
    g = Graph(n, spark.createDataFrame([], E))
    assert traversal.resolve(g, "x3") == ("unique", ["x3"])
    assert traversal.resolve(g, "FOO") == ("unique", ["x2"])
    assert traversal.resolve(g, "foo()@a/x") == ("unique", ["x1"])
    assert traversal.resolve(g, "w.py") == ("unique", ["x4"])
    assert traversal.resolve(g, "oo") == ("ambiguous", ["x1", "x2", "x3"]) and traversal.resolve(g, "nope") == ("missing", [])


# Analytics


def brute_cycles(pairs, longest):
    ids = sorted({x for p in pairs for x in p})
    out = set()
    for k in range(2, longest + 1):
        for c in permutations(ids, k):
            if c[0] == min(c) and all((c[i], c[(i + 1) % k]) in pairs for i in range(k)):
                out.add(c)
    return sorted(out, key=lambda c: (len(c), c))


def test_cycles_against_brute_force(spark):
    rng = random.Random(2)
    for _ in range(3):
        pairs = {(a, b) for a in "abcdef" for b in "abcdef" if a != b and rng.random() < 0.35}
        got = [tuple(r.cycle) for r in analytics.cycles(spark.createDataFrame(sorted(pairs), "a string, b string"), 4, None).collect()]
        assert got == brute_cycles(pairs, 4)


def test_components_and_strong_components(spark):
    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randint(0, 25):02d}", f"n{rng.randint(0, 25):02d}") for _ in range(30)})
    df = spark.createDataFrame(pairs, "a string, b string")
    reach = {a: {a} for p in pairs for a in p}
    for _ in range(30):
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    strong = {}
    for a in reach:
        group = {b for b in reach[a] if a in reach[b]}
        if len(group) > 1 or (a, a) in pairs:
            strong[a] = min(group)
    assert {r.id: r.component for r in analytics.strong_components(df).collect()} == strong
    weak = {a: {a} for p in pairs for a in p}
    for _ in range(30):
        for a, b in pairs:
            both = weak[a] | weak[b]
            for x in both:
                weak[x] = both
    assert {r.id: r.component for r in analytics.components(df).collect()} == {a: min(s) for a, s in weak.items()}


def test_two_cliques_are_two_communities(spark):
    left = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)]
    right = [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)]
    g = graph(spark, [*left, *right, ("a0", "b0")], extra=["lone"])
    got = {r.id: r.community for r in community.cluster(g).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == len({got[f"b{i}"] for i in range(5)}) == 1 and len(set(got.values())) == 3 and got["lone"] == 2
    labels = spark.createDataFrame([(k, v) for k, v in got.items()], "id string, l int")
    one = labels.withColumn("l", F.lit(0))
    pairs = analytics.weighted_pairs(g.edges)
    assert analytics.modularity(pairs, labels) > analytics.modularity(pairs, one)
    assert {r.id for r in community.propagate(pairs).collect()} == set(got) - {"lone"}


def test_betweenness_of_a_path(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    got = {r.id: r.value for r in community.betweenness(g).collect()}
    assert got == pytest.approx({"a": 0, "b": 4 / 6, "c": 4 / 6, "d": 0})
    edges = {(r.a, r.b): r.value for r in community.betweenness(g, edges=True).collect()}
    assert edges == pytest.approx({("a", "b"): 6 / 12, ("b", "c"): 8 / 12, ("c", "d"): 6 / 12})


def test_betweenness_equals_counted_paths(spark):
    rng = random.Random(5)
    links = sorted({(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(40)) if a != b})
    g = graph(spark, [*links, links[0][::-1], ("n01", "n01")], extra=["lone"])
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def shortest(a, b):
        found, front = [], [[a]]
        while front and not found:
            found = [p for p in front if p[-1] == b]
            seen = {x for p in front for x in p}
            front = [[*p, x] for p in front for x in near[p[-1]] if x not in seen]
        return found

    n, nodes, edges = len(near) + 1, dict.fromkeys([*near, "lone"], 0.0), {}
    for a in near:
        for b in near:
            ways = shortest(a, b) if a != b else []
            for way in ways:
                for x in way[1:-1]:
                    nodes[x] += 1 / len(ways) / ((n - 1) * (n - 2))
                for x, y in zip(way, way[1:]):
                    edges[min(x, y), max(x, y)] = edges.get((min(x, y), max(x, y)), 0.0) + 1 / len(ways) / (n * (n - 1))
    assert {r.id: r.value for r in community.betweenness(g).collect()} == pytest.approx(nodes)
    assert {(r.a, r.b): r.value for r in community.betweenness(g, edges=True).collect()} == pytest.approx(edges)
    nothing = graph(spark, [("a", "a")])
    assert [tuple(r) for r in community.betweenness(nothing).collect()] == [("a", 0.0)] and community.betweenness(nothing, edges=True).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_leiden_is_connected_and_never_below_louvain(seed):
    rng = random.Random(seed)
    spots = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)]
    pairs = [(f"n{min(p):02}", f"n{max(p):02}", rng.choice([0.5, 1.0, 3.0])) for p in sorted(set(spots))]
    total = 2 * sum(w for _, _, w in pairs)

    def quality(label):
        mass = {}
        for a, b, w in pairs:
            for x in (a, b):
                mass[label[x]] = mass.get(label[x], 0.0) + w
        return sum(2 * w for a, b, w in pairs if label[a] == label[b]) / total - sum((m / total) ** 2 for m in mass.values())

    plain, fine = community.louvain(pairs), community.leiden(pairs)
    assert quality(fine) >= quality(community.connected_parts(plain, pairs)) - 1e-9
    assert community.connected_parts(fine, pairs) == fine
    one = dict.fromkeys(plain, "x")
    assert quality(plain) > max(quality(one), quality({x: x for x in plain}))


def test_places_in_an_order(spark):
    df = spark.range(500).selectExpr("id % 7 as a", "cast(id as string) as b").repartition(6)
    got = [tuple(r) for r in graphs.numbered(df, "place", F.desc("a"), F.col("b")).collect()]
    want = sorted(((-(i % 7), str(i)) for i in range(500)))
    assert sorted((p, -a, b) for a, b, p in got) == [(i, *w) for i, w in enumerate(want)]
    assert graphs.numbered(df.limit(0), "place", "b").count() == 0


def test_diff_is_undirected_in_links(spark):
    a, b = graph(spark, [("a", "b"), ("b", "c")]), graph(spark, [("b", "a"), ("b", "d")])
    assert {tuple(r) for r in analytics.graph_diff(a, b).collect()} == {("node", "added", "d"), ("node", "removed", "c"), ("edge", "added", "b|d|calls"), ("edge", "removed", "b|c|calls")}


# Dedup


def test_entity_dedup(spark):
    rows = [
        ("x1", "Customer Account Manager", "f1"), ("x2", "customer-account-manager", "f1"), ("x3", "Custmer Account Manager", "f2"),
        ("x4", "Invoice Payment Handlers", "f2"),  # goes on where x7 ends
        ("x5", "util v1", "f4"), ("x6", "util v2", "f5"),  # variants of a stem
        ("x7", "Invoice Payment Handler", ""), ("x8", "Invoice Payment Handler", None), ("x9", "invoice payment handler", "f3"),  # no file that they share
        ("y1", None, "f1"), ("y2", "--", "f1"), ("y3", "--", "f1"),
    ]
    n = spark.createDataFrame(rows, "id string, label string, source_file string")
    want = {("x2", "x1"), ("x3", "x1")}
    assert {(r.old, r.new) for r in dedup.merge_map(n).collect()} == want
    typed = lambda kind: n.withColumn("file_type", F.lit(kind))
    assert dedup.merge_map(typed("code")).count() == 0 and {(r.old, r.new) for r in dedup.merge_map(typed("concept")).collect()} == want
    assert dedup.merge_map(n.withColumn("extra", F.lit('{"_node_type": "resource"}'))).count() == 0
    assert dedup.merge_map(n.withColumn("repo", F.when(F.col("id") < "x5", "a").otherwise("b"))).count() == 0
    assert dedup.merge_map(n.limit(0)).count() == 0
    b, r = dedup.bands()
    assert b * r <= 128


def test_text_functions(spark):
    assert text.build_id("Straße", "Foo.Bar") == "strasse_foo_bar"
    assert text.jaro_winkler("martha", "marhta") == pytest.approx(96.11, abs=0.01) and text.damerau("ca", "ac") == 1
    assert text.query_tokens("How does the parser handle errors?") == ["parser", "handle", "errors"] and text.query_tokens("foo.bar") == ["foo", "bar"]
    assert "query" in text.variants("queries") and "stop" in text.variants("stopped")
    df = spark.createDataFrame([("HTTPServer parseJson aé x",)], "t string")
    assert df.select(text.tokens("t")).first()[0] == ["httpserver", "parse", "json", "aé"]


def test_retrieval_finds_neighbours(spark):
    g = graph(spark, [("auth_login", "session_store"), ("session_store", "db_pool"), ("misc_one", "misc_two")])
    top = retrieval.search(g, "login session", most=3)
    assert {i for i, _ in top[:2]} == {"auth_login", "session_store"}
    assert retrieval.search(g, "zebra") == []


# Sets


def test_federated_union_and_incremental_equal_rebuild(spark):
    a, b = graph(spark, [("a", "b")]), graph(spark, [("a", "c")])
    ext = lambda g: g.with_(nodes=g.nodes.withColumn("source_file", F.when(F.col("id") == "a", "").otherwise(F.col("source_file"))))
    whole = setops.compose({"x": ext(a), "y": ext(b)})
    assert {r.id for r in whole.nodes.collect()} == {"x::a", "x::b", "y::c"}
    assert {(r.src, r.dst) for r in whole.edges.collect()} == {("x::a", "x::b"), ("x::a", "y::c")}
    old, new = graph(spark, [("a1", "b1"), ("b1", "a1"), ("b1", "b2")]), graph(spark, [("b1", "b2")])
    only_b1 = new.with_(nodes=new.nodes.where("id = 'b1'"))
    changed = spark.createDataFrame([("mb/b1.py",)], "source_file string")
    merged = setops.incremental_merge(old, only_b1, changed, changed.limit(0))
    assert setops.same_topology(merged, graph(spark, [("a1", "b1"), ("b1", "b2")])) and not setops.same_topology(old, merged)


def test_remap_keeps_most_overlapping_ids(spark):
    s = "id string, community int"
    old = spark.createDataFrame([("a", 5), ("b", 5), ("c", 7)], s)
    new = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], s)
    assert setops.overlap_communities(old, new) == [(0, 5), (1, 7), (2, 0)]


def test_prefix_resolution(spark):
    stubs = spark.createDataFrame([("s1", "org.acme.db.Pool"), ("s2", "org.acme"), ("s3", "zz.Lonely"), ("s4", "zz.Twice")], "id string, coordinate string")
    modules = spark.createDataFrame([("org.acme", "m1"), ("org.acme.db", "m2")], "coordinate string, id string")
    symbols = spark.createDataFrame([("Lonely", "q"), ("Twice", "q"), ("Twice", "p")], "label string, id string")
    got = {r.id: (r.target, r.confidence) for r in setops.cross_repo_resolve(stubs, modules, symbols).collect()}
    assert got == {"s1": ("m2", 0.75), "s2": ("m1", 1.0), "s3": ("q", 0.75)}
    al = setops.alias_resolve(spark.createDataFrame([("@/x/y",), ("lib",), ("none",)], "path string"), spark.createDataFrame([("@/", "src/"), ("@/x/", "ex/"), ("lib", "library")], "alias string, target string"))
    assert {r.path: r.resolved for r in al.collect()} == {"@/x/y": "ex/y", "lib": "library"}


# History, pulls, metrics


def test_history_is_as_of(spark):
    tx = spark.createDataFrame([("c1", 1, "a"), ("c1", 1, "b"), ("c2", 2, "a"), ("c2", 2, "b"), ("c3", 3, "a"), ("c3", 3, "c")], "commit string, idx int, file string")
    got = {(r.commit, r.seed, r.file): (r.support, r.hit) for r in metrics.history_samples(tx).collect()}
    assert got == {("c2", "a", "b"): (1, True), ("c2", "b", "a"): (1, True), ("c3", "a", "b"): (2, False)}


def test_module_paths(spark):
    df = spark.createDataFrame([("a/b/c/d.py",), ("a/d.py",), ("d.py",)], "p string")
    assert [r[0] for r in df.select(history.module_of("p")).collect()] == ["a/b", "a", "(root)"]


def test_pull_paths(spark):
    g = graph(spark, [("a1", "b1")])
    files = spark.createDataFrame([(1, "repo/ma/a1.py"), (1, "b1.py"), (2, "xa1.py"), (3, "ma/a1.py")], "number int, path string")
    assert {(r.number, r.source_file) for r in pulls.path_matches(files, g.nodes).collect()} == {(1, "ma/a1.py"), (1, "mb/b1.py"), (3, "ma/a1.py")}
    assert [(r.community, r.numbers) for r in pulls.conflicts(files, g).collect()] == [(0, [1, 3])]


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q1", "x", 1), ("q1", "y", 2), ("q2", "z", 2)], "case string, id string, rank int")
    relevant = spark.createDataFrame([("q1", "y"), ("q2", "z"), ("q3", "n")], "case string, id string")
    r = metrics.retrieval(ranked, relevant).first()
    assert (r.cases, r.recall_1, round(r.recall_5, 3), round(r.mrr, 3)) == (3, 0.0, 0.667, 0.333)


# Audits


def test_sql_rules_on_a_graph(spark):
    n = [("t", "accounts", "table", "{}"), ("c1", "accounts.tenant_id", "column", "{}"), ("c2", "accounts.id", "column", '{"pk": true}'), ("c3", "accounts.email", "column", "{}"), ("t2", "notes", "table", '{"rls_enabled": true}'), ("c4", "notes.owner_id", "column", '{"fk": true}'), ("i", "ix", "index", "{}"), ("v", "view_notes", "view", "{}"), ("p", "pol", "policy", '{"using": "x"}'), ("pub", "public", "role", "{}")]
    e = [("t", "c1", "has_column"), ("t", "c2", "has_column"), ("t", "c3", "has_column"), ("t2", "c4", "has_column"), ("t2", "i", "has_index"), ("i", "c4", "indexes"), ("v", "t2", "reads_from"), ("t", "pub", "grants")]
    g = Graph(spark.createDataFrame(n, "id string, label string, kind string, extra string"), spark.createDataFrame([(*x, None) for x in e], "src string, dst string, relation string, context string"))
    got = {(r.rule_id, r.node_ids[-1]) for r in sqlaudit.report(sqlaudit.audit(g)).collect()}
    assert got == {("SEC-RLS-001", "t"), ("SEC-RLS-002", "t2"), ("SEC-RLS-003", "p"), ("SEC-RLS-004", "t2"), ("SEC-GRANT-001", "pub"), ("SEC-PII-001", "c3"), ("PERF-IDX-001", "c1"), ("DES-FK-001", "c1"), ("DES-PK-001", "t2")}


def test_text_scan_and_placeholders(spark):
    files = spark.createDataFrame([("a.py", "foo = 1\nbar(foo, foo2)\n# TODO foo"), ("gen/b.py", "x # FIXME")], "path string, content string")
    assert [tuple(r) for r in readiness.text_scan(files, "foo").collect()] == [("a.py", 1, 1), ("a.py", 2, 5), ("a.py", 3, 8)]
    assert {(r.path, r.severity) for r in readiness.placeholders(files).collect()} == {("a.py", "high"), ("gen/b.py", "low")}


# Versions


def test_version_order_and_ranges():
    assert version.compare("1.2", "v1.2.0") == 0 and version.compare("1.0.0-rc1", "1.0.0") == -1 and version.compare("1.10.0", "1.9.9") == 1 and version.compare("1.2.3.4", "1.0") is None
    assert version.compare("1.0.0-alpha.2", "1.0.0-alpha.10") == -1 and version.compare("1.0.0-alpha.1", "1.0.0-alpha.beta") == -1
    events = [("introduced", "1.0.0"), ("fixed", "1.2.0"), ("introduced", "2.0.0"), ("last_affected", "2.1.0")]
    assert [version.in_range(v, events) for v in ("0.9", "1.1.9", "1.2.0", "2.1.0", "2.1.1", "x")] == ["unaffected", "affected", "unaffected", "affected", "unaffected", "undetermined"]


def test_vulnerability_scan(spark):
    packages = spark.createDataFrame([("npm", "left", "1.1.0", "runtime"), ("npm", "left", "1.3.0", "runtime"), ("npm", "left", "weird.x.y.z", "dev"), ("npm", "other", "1.0.0", "runtime")], "ecosystem string, name string, version string, scope string")
    adv = spark.createDataFrame(
        [("A1", False, [("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], [("npm", "left", ["1.3.0"], [("SEMVER", [("introduced", "1.0.0"), ("fixed", "1.2.0")])])]), ("A2", True, [], [("npm", "left", None, [])])],
        "id string, withdrawn boolean, severity array<struct<kind:string,score:string>>, affected array<struct<ecosystem:string,name:string,versions:array<string>,ranges:array<struct<kind:string,events:array<struct<type:string,bound:string>>>>>>",
    )
    got = {r.version: (r.verdict, r.priority) for r in vuln.scan(packages, adv).collect()}
    assert got == {"1.1.0": ("affected", "P0"), "1.3.0": ("affected", "P0"), "weird.x.y.z": ("undetermined", "P2")}
    assert {(r.finding.split("|")[-1], r.fix, r.risk) for r in vuln.fixes(vuln.scan(packages, adv)).collect()} == {("1.1.0", "1.2.0", "minor"), ("1.3.0", "1.2.0", "minor"), ("weird.x.y.z", "1.2.0", "unknown")}


# Contracts and exports


def test_contract_diff(spark):
    doc = lambda required, kind: '{"paths": {"/a/{id}": {"get": {"operationId": "getA", "parameters": [{"name": "q", "required": %s, "schema": {"type": "%s"}}], "responses": {"200": {}}}}, "/gone": {"get": {"operationId": "old"}}}}' % (required, kind)
    old = spark.createDataFrame(contracts.openapi(doc("false", "string"), "v"), contracts.OPERATIONS)
    new = spark.createDataFrame(contracts.openapi(doc("true", "string").replace('"old"', '"renamed"'), "v"), contracts.OPERATIONS)
    assert {(r.key, r.change, r.field) for r in contracts.diff(old, new).collect()} == {("getA", "request_required", "q"), ("old", "renamed", None)}
    assert {(r.key, r.change) for r in contracts.diff(old, new.limit(0)).collect()} == {("getA", "removed"), ("old", "removed")}


def test_json_round_trip(spark, tmp_path):
    from loomgraph.sources.store import prune_repo, read_json, read_store, write_store

    g = graph(spark, [("a", "b"), ("b", "c")])
    exports.write_json(g, f"{tmp_path}/g")
    back = read_json(spark, f"{tmp_path}/g")
    assert setops.same_topology(g, back)
    g = g.with_(nodes=g.nodes.withColumn("repo", F.when(F.col("id") == "c", "r2").otherwise("r1")))
    write_store(g, f"file://{tmp_path}/s")
    assert {r.id for r in read_store(spark, f"file://{tmp_path}/s", "r1").nodes.collect()} == {"a", "b"}
    assert read_store(spark, f"file://{tmp_path}/s").edges.count() == 1 and read_store(spark, f"file://{tmp_path}/s", bridge=True).edges.count() == 2
    prune_repo(spark, f"file://{tmp_path}/s", "r2")
    assert read_store(spark, f"file://{tmp_path}/s").nodes.count() == 2
    assert "<node id=\"a\">" in "".join(r.line for r in exports.graphml(g).collect()) and exports.report(g).startswith("# Graph report")
