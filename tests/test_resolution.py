from loomgraph.graph import Graph
from loomgraph.operators import resolution as R
from loomgraph.sources import ingest
from pyspark.sql import functions as F

E = "src string, dst string, relation string, context string"


def test_calls_resolve_by_pass(spark):
    n = [("f1", "helper()", "a.py", "function"), ("f2", "helper()", "b.py", "function"), ("f3", "only()", "c.py", "function"), ("T", "Thing", "d.py", "class"), ("m1", "run()", "d.py", "method"), ("m2", "run()", "e.py", "method"), ("s", "setup()", "lib.sh", "function"), ("j", "only()", "x.js", "function")]
    g = Graph(spark.createDataFrame(n, "id string, label string, source_file string, kind string"), spark.createDataFrame([("T", "m1", "method", None)], E))
    calls = spark.createDataFrame(
        [("c1", "x", "helper", "z.py", None), ("c2", "x", "helper", "y.py", None), ("c3", "x", "only", "z.py", None), ("c4", "x", "run", "z.py", "Thing"), ("c5", "x", "run", "z.py", None), ("c6", "x", "setup", "go.sh", None), ("c7", "x", "helper", "q.py", None)],
        "call string, src string, name string, file string, receiver string",
    )
    imports = spark.createDataFrame([("z.py", "a.py", "helper", False), ("y.py", "b.py", None, False), ("go.sh", "lib.sh", None, True)], "file string, target_file string, name string, sourced boolean")
    got = {r.call: (r.target, r.step) for r in R.resolve_calls(g, calls, imports).collect()}
    assert got == {"c1": ("f1", "import"), "c2": ("f2", "namespace"), "c3": ("f3", "unique"), "c4": ("m1", "member"), "c6": ("s", "sourced")}


def test_routes(spark):
    concrete = spark.createDataFrame([("r1", "/users/5"), ("r2", "/users/5/posts"), ("r3", "/files/a/b/c"), ("r4", "/other"), ("r5", "/both/1")], "id string, path string")
    templates = spark.createDataFrame([("t1", "/users/{id}"), ("t2", "/users/:id/posts"), ("t3", "/files/*"), ("t4", "/both/{x}"), ("t5", "/both/<y>")], "id string, path string")
    assert {(r.id, r.template) for r in R.match_routes(concrete, templates).collect()} == {("r1", "t1"), ("r2", "t2"), ("r3", "t3")}


def test_stubs_commands_dynamic_resources(spark):
    n = [("t1", "users", "", "table"), ("t2", "Users", "db.sql", "table"), ("cmd", "deploy.sh", "", "other"), ("f", "deploy", "ops/deploy.sh", "module"), ("fn", "handler()", "h.py", "function"), ("img", "logo", "res/logo.png", "other")]
    e = [("fn", "t1", "queries", None), ("fn", "cmd", "invokes", None)]
    g = Graph(spark.createDataFrame(n, "id string, label string, source_file string, kind string"), spark.createDataFrame(e, E))
    c = R.collapse_table_stubs(g)
    assert {r.id for r in c.nodes.collect()} == {"t2", "cmd", "f", "fn", "img"} and ("fn", "t2") in {(r.src, r.dst) for r in c.edges.collect()}
    assert [(r.old, r.new) for r in R.commands(g).collect()] == [("cmd", "f")]
    assert [(r.route, r.handler) for r in R.route_handlers(g, spark.createDataFrame([("rt", "handler")], "id string, handler_name string")).collect()] == [("rt", "fn")]
    sites = spark.createDataFrame([("f", "handler"), ("f", None)], "src string, key string")
    assert [(r.src, r.dst) for r in R.dynamic_links(g, sites).collect()] == [("f", "fn")]
    stubs = spark.createDataFrame([("s1", "res/logo.png", "x"), ("s2", "gone/q.png", "logo"), ("s3", "gone", "handler"), ("s4", "gone", "nothing")], "id string, path string, logical string")
    assert {(r.stub, r.target) for r in R.resource_links(g, stubs).collect()} == {("s1", "img"), ("s2", "img"), ("s3", "fn")}


def test_imports(spark):
    imports = spark.createDataFrame([("src/a/x.ts", "./y"), ("src/a/x.ts", "../b"), ("src/a/x.ts", "@/lib/z"), ("src/a/x.ts", "react")], "file string, spec string")
    files = spark.createDataFrame([("src/a/y.ts",), ("src/b/index.ts",), ("app/lib/z.js",)], "path string")
    aliases = spark.createDataFrame([("@/", "app/")], "alias string, target string")
    assert {(r.spec, r.target) for r in R.resolve_imports(imports, files, aliases).collect()} == {("./y", "src/a/y.ts"), ("../b", "src/b/index.ts"), ("@/lib/z", "app/lib/z.js")}


def test_service_detectors(spark):
    src = "stub = pb2_grpc.UserStub(ch)\nws = new WebSocket('wss://h/x')\nipcMain.handle('save', f)\napp.send_task('jobs.run')\nx = getattr(o, 'name')\ny = eval(code)\n"
    files = spark.createDataFrame([("s.py", src)], "path string, content string")
    assert {(r.dst, r.relation) for r in ingest.detect_services(files).collect()} == {("grpc:User", "calls_service"), ("socket:wss://h/x", "calls_service"), ("ipc:save", "handled_by"), ("queue:jobs.run", "calls_service")}
    assert [(r.line, r.kind, r.key) for r in ingest.dynamic_sites(files).orderBy(F.col("line")).collect()] == [(5, "getattr", "name"), (6, "eval", None)]
    assert ingest.cargo_workspace('[package]\nname = "a"\n[dependencies]\nb = "1"\nc = { package = "cc", version = "2" }\n') == [("a", "b"), ("a", "cc")]
