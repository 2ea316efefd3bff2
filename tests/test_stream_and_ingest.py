import json

from loomgraph.graph import Graph
from loomgraph.operators.setops import same_topology
from loomgraph.sources import files, ingest
from loomgraph.streaming.watch import LiveGraph, members_changed, watch
from pyspark.sql import functions as F

N = "id string, label string, source_file string, seq long"
E = "src string, dst string, relation string, context string, confidence string, weight double"


def make(spark, names):
    nodes = spark.createDataFrame([(n, n, f"{n}.py", 1) for n in names], N)
    edges = spark.createDataFrame([(a, b, "calls", None, "EXTRACTED", 1.0) for a, b in zip(names, names[1:])], E)
    return Graph(nodes, edges)


def test_stream_ends_where_a_rebuild_does(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    rows = [("b.py", "removed", "2024-01-01T00:00:01Z"), ("c.py", "changed", "2024-01-01T00:00:02Z"), ("node_modules/x.py", "added", "2024-01-01T00:00:02Z"), ("c.py", "added", "2024-01-01T00:00:00Z")]
    (inbox / "1.json").write_text("\n".join(json.dumps({"path": p, "change": c, "at": t}) for p, c, t in rows))
    seen = []

    def extract(touched):
        seen.append(sorted(r.source_file for r in touched.collect()))
        one = make(spark, ["c"])
        return one.with_(edges=spark.createDataFrame([("c", "a", "calls", None, "EXTRACTED", 1.0)], E))

    def keep(g, number):
        return Graph(spark.createDataFrame(g.nodes.select("id", "label", "source_file", "seq").collect(), N), spark.createDataFrame(g.edges.select("src", "dst", "relation", "context", "confidence", "weight").collect(), E))

    live = LiveGraph(make(spark, ["a", "b", "c"]), extract, keep)
    watch(spark, str(inbox), live.apply, str(tmp_path / "check"), drain=True).awaitTermination(120)
    assert seen == [["c.py"]]
    want = Graph(spark.createDataFrame([("a", "a", "a.py", 1), ("c", "c", "c.py", 1)], N), spark.createDataFrame([("c", "a", "calls", None, "EXTRACTED", 1.0)], E))
    assert same_topology(live.graph, want)


def test_members(spark):
    paths = spark.createDataFrame([("a/b/x.py",), ("a/package.json",), ("z/q.py",)], "path string")
    members = spark.createDataFrame([("a", "m1"), ("a/b", "m2")], "root string, member string")
    assert {tuple(r) for r in members_changed(paths, members).collect()} == {("a/b/x.py", "m2", "source"), ("a/package.json", "m1", "manifest")}


def test_file_classes(spark):
    paths = ["a.py", "b.MD", "c.pdf", "d.PNG", "e.mp4", "f.xyz", "noext", "x/.env", "k/id_rsa", "conf/secrets.yaml", "node_modules/a.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.classify().alias("c"), files.sensitive().alias("s"), files.noise().alias("n"))
    got = {r.path: (r.c, r.s, r.n) for r in df.collect()}
    assert [got[p][0] for p in paths[:7]] == ["code", "document", "paper", "image", "video", None, None]
    assert [p for p in paths if got[p][1]] == paths[7:10] and [p for p in paths if got[p][2]] == paths[10:]


def test_addresses_and_subtitles(spark):
    urls = ["https://example.org/a", "http://localhost/x", "https://10.1.2.3/", "ftp://example.org", "https://user@example.org/", "http://172.20.0.1/", "https://[::1]/", "https://sub.example.co.uk:8080/p?q"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(ingest.url_admitted("u")).collect()]
    assert got == [True, False, False, False, False, False, False, True]
    vtt = "WEBVTT\n\n1\n00:00.000 --> 00:01.000\n<b>Hello</b>\nHello\n\n2\n00:01.000 --> 00:02.000\nworld"
    assert spark.createDataFrame([(vtt,)], "t string").select(ingest.subtitles("t")).first()[0] == "Hello world"


def test_lock_files_and_detectors(spark):
    rows = [("a/Cargo.lock", '[[package]]\nname = "x"\nversion = "1.0.0"\n'), ("package-lock.json", '{"packages": {"": {}, "node_modules/a/node_modules/b": {"version": "2.0.0"}}}'), ("go.sum", "m/x v1.2.3 h1:a\nm/x v1.2.3/go.mod h1:b\n"), ("requirements.txt", "Foo==1.0 # c\nbar>=2\n"), ("Cargo.lock", "not toml [")]
    got = {tuple(r) for r in ingest.lock_table(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("a/Cargo.lock", "crates.io", "x", "1.0.0"), ("package-lock.json", "npm", "b", "2.0.0"), ("go.sum", "Go", "m/x", "1.2.3"), ("requirements.txt", "PyPI", "foo", "1.0")}
    src = 'import x\n# requests.get("/commented")\nrequests.get("/api/users")\n@app.get("/api/users")\ncur.execute("SELECT a FROM users")\nsubprocess.run(["git", "log"])\n'
    links = {(r.dst, r.relation) for r in ingest.detect_links(spark.createDataFrame([("s.py", src)], "path string, content string")).collect()}
    assert links == {("route:/api/users", "calls_service"), ("route:/api/users", "handled_by"), ("table:users", "queries"), ("command:git", "invokes")}
    md = spark.createDataFrame([("r.md", "# One\ntext\n## Two ##\n")], "path string, content string")
    assert [(r.line, r.level, r.title) for r in ingest.headings(md).collect()] == [(1, 1, "One"), (3, 2, "Two")]


def test_index_ingest(spark):
    docs = spark.createDataFrame(
        [("a", [("s1", "A", [("s2", "calls"), ("gone", "calls")])]), ("b", [("s2", "B", [])])], "path string, symbols array<struct<symbol:string,name:string,relations:array<struct<symbol:string,kind:string>>>>"
    )
    nodes, links = ingest.scip(docs)
    assert {r.id for r in nodes.collect()} == {"a#s1", "b#s2", "external#gone"} and {(r.src, r.dst) for r in links.collect()} == {("a#s1", "b#s2"), ("a#s1", "external#gone")}
    t = spark.createDataFrame([("public", "users", "table"), ("public", "orders", "table")], "schema string, name string, kind string")
    k = spark.createDataFrame([("public.orders", "user_id", "public.users", "id")], "table string, column string, ref_table string, ref_column string")
    n, e = ingest.relational_schema(t, k, "shop")
    assert {(r.src, r.dst, r.relation) for r in e.where(F.col("relation") == "references").collect()} == {("db:shop.public.orders", "db:shop.public.users", "references")} and n.count() == 3
