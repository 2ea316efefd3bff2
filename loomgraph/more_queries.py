"""More registered queries: named patterns, building, priors, forecasts, resolution, versions, contracts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, unique
from .operators import analytics, build, community, contracts, exports, history, metrics, primitives, pulls, readiness, resolution, retrieval, traversal, vuln
from .plans import builder, patterns
from .queries import _SURPRISE, _transactions, graph_query, table_query
from .sources import ingest, tables


def _typed(g: Graph) -> Graph:
    """The graph with the relations that patterns look for, as far as they are links: orders refer to their customer, parts implement suppliers."""
    e = g.edges.select("src", "dst", "relation")
    back = e.where("relation = 'method'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("references").alias("relation"), F.lit("return_type").alias("context"))
    implements = e.where("relation = 'depends_on'").withColumn("relation", F.lit("implements"))
    plain = lambda df: df.withColumn("context", F.lit(None).cast("string"))
    return g.with_(edges=plain(e).unionByName(back).unionByName(plain(implements)))


def _referring(g: Graph) -> tuple[patterns.Chain, ...]:
    """References of two steps: orders to the suppliers of their parts, customers to the suppliers of their nation."""
    e = g.edges.select("src", "dst", "relation")
    held = e.where("relation = 'contains'")
    parts = patterns.Chain("return_type", e.where("relation = 'uses'").select("src", F.col("dst").alias("mid")), e.where("relation = 'depends_on'").select(F.col("src").alias("mid"), "dst"))
    near = patterns.Chain("field", held.where("dst like 'customer:%'").select(F.col("dst").alias("src"), F.col("src").alias("mid")), held.where("dst like 'supplier:%'").select(F.col("src").alias("mid"), "dst"))
    return parts, near


@graph_query("SELECT 'customer:' || o_custkey AS id FROM orders GROUP BY o_custkey")
def pattern_singletons(g: Graph) -> DataFrame:
    return patterns.singletons(_typed(g), _referring(g))


_ABSTRACT = "(SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2)"


@graph_query(f"SELECT DISTINCT 'order:' || l.l_orderkey AS id FROM lineitem l JOIN lineitem k ON k.l_partkey = l.l_partkey WHERE k.l_suppkey IN {_ABSTRACT}")
def pattern_factories(g: Graph) -> DataFrame:
    return patterns.factories(_typed(g), _referring(g))


@graph_query(f"SELECT DISTINCT 'customer:' || c_custkey AS id FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_suppkey IN {_ABSTRACT}")
def pattern_observers(g: Graph) -> DataFrame:
    return patterns.observers(_typed(g), _referring(g))


@graph_query("SELECT 'supplier:' || l_suppkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def implementations(g: Graph) -> DataFrame:
    return patterns.implementations(_typed(g).edges)


@graph_query("WITH f AS (SELECT src, count(DISTINCT dst) AS n FROM edges WHERE src <> dst GROUP BY 1) SELECT id FROM nodes JOIN f ON f.src = id WHERE kind = 'struct' AND loc > 30 AND n > 20")
def pattern_god_classes(g: Graph) -> DataFrame:
    return patterns.god_classes(g, loc=30, out=20)


@graph_query("""WITH s AS (SELECT id, kind, regexp_replace(source_file, '/[^/]*/[^/]*$', '') AS f, seq % 50 + 1 AS a, seq % 50 + 1 + coalesce(loc, 0) AS b FROM nodes),
m AS (SELECT e.src AS id, min(y.a) AS a, max(y.b) AS b FROM (SELECT DISTINCT src, dst FROM edges WHERE relation IN ('contains', 'method')) e JOIN s x ON x.id = e.src JOIN s y ON y.id = e.dst WHERE x.f = y.f GROUP BY 1)
SELECT s.id, CAST(CASE WHEN kind IN ('class', 'interface', 'struct') THEN greatest(coalesce(greatest(s.b, m.b), s.b) - coalesce(least(s.a, m.a), s.a), 0) + 1 ELSE s.b - s.a + 1 END AS BIGINT) AS effective_loc FROM s LEFT JOIN m ON m.id = s.id""")
def effective_loc(g: Graph) -> DataFrame:
    start = F.col("seq") % 50 + 1
    n = g.nodes.withColumn("source_file", F.regexp_replace("source_file", "/[^/]*/[^/]*$", "")).withColumn("start_line", start).withColumn("end_line", start + F.coalesce("loc", F.lit(0)))
    return primitives.effective_loc(g.with_(nodes=n))


@graph_query("SELECT src, dst, relation, context, string_agg(seq, ',' ORDER BY seq) AS sites FROM (SELECT DISTINCT src, dst, relation, context, seq FROM links) GROUP BY 1, 2, 3, 4 HAVING count(*) > 1", of=tables.links)
def merged_sites(raw: DataFrame) -> DataFrame:
    marked = raw.withColumn("source_file", F.col("seq").cast("string")).withColumn("source_location", F.lit("L1"))
    out = build.merge_sites(marked)
    return out.where(F.size("sites") > 1).select("src", "dst", "relation", "context", F.array_join(F.transform("sites", lambda s: s.source_file), ",").alias("sites"))


@graph_query("SELECT id, CASE WHEN count(*) OVER (PARTITION BY lower(label)) <= 2 THEN 1.0 ELSE round(greatest(0.35, sqrt(2.0 / count(*) OVER (PARTITION BY lower(label)))), 9) END AS prior FROM nodes")
def repeated_labels(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.round(retrieval.repeated_label_prior(), 9).alias("prior"))


@graph_query("""WITH d AS (SELECT id, count(DISTINCT n) AS d FROM (SELECT src AS id, dst AS n FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst) GROUP BY 1), m AS (SELECT avg(d) AS m FROM d)
SELECT id, round(1 / (1 + ln(1 + d / greatest(m, 1.0))), 9) AS penalty FROM d, m""")
def hub_penalties(g: Graph) -> DataFrame:
    d = primitives.degree_map(g.edges)
    mean = d.agg(F.avg("neighbours")).first()[0]
    return d.select("id", F.round(retrieval.hub_penalty(F.col("neighbours"), mean), 9).alias("penalty"))


@graph_query("SELECT DISTINCT src AS id, relation, CASE WHEN confidence = 'EXTRACTED' THEN 'breaks' ELSE 'review' END AS verdict FROM edges WHERE dst = 'part:9'")
def delete_part(g: Graph) -> DataFrame:
    return history.edit_impact(g, "part:9", "delete")


@graph_query("SELECT src, source_file AS path, relation, confidence FROM edges JOIN nodes ON id = src WHERE dst = 'part:9' AND confidence = 'EXTRACTED' GROUP BY ALL")
def rename_part(g: Graph) -> DataFrame:
    return readiness.rename_plan(g, "part:9", "other")["edits"]


@graph_query("SELECT DISTINCT source_file AS path FROM edges JOIN nodes ON id = src WHERE dst = 'part:9'")
def relocate_part(g: Graph) -> DataFrame:
    return readiness.relocate_plan(g, "part:9", "elsewhere/part9")["updates"]


@graph_query("""WITH d AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 'part:3' AND relation IN ('uses')) SELECT d.id, 1 AS depth, visibility FROM d JOIN nodes USING (id) ORDER BY 1 LIMIT 200""")
def forecast_part(g: Graph) -> DataFrame:
    return history.forecast(g, ["part:3"], 1)["blast"].select("id", "depth", "visibility")


@graph_query("SELECT 'order:' || o_orderkey AS \"call\", 'supplier:' || s_suppkey AS target, 'unique' AS step FROM orders JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier) + 1")
def resolve_calls(g: Graph) -> DataFrame:
    n = g.nodes.where("kind = 'interface'")
    many = n.count()
    calls = g.nodes.where("kind = 'function'").select(F.col("id").alias("call"), F.col("id").alias("src"), (F.col("seq") % many + 1).alias("k"), F.col("source_file").alias("file"))
    calls = calls.join(n.select(F.col("seq").alias("k"), F.col("label").alias("name")), "k").select("call", "src", "name", F.lit("a/x.py").alias("file"), F.lit(None).cast("string").alias("receiver"))
    some = g.with_(nodes=n.withColumn("source_file", F.concat("source_file", F.lit(".py"))))
    imports = g.spark.createDataFrame([], "file string, target_file string, name string, sourced boolean")
    return resolution.resolve_calls(some, calls, imports).select("call", "target", "step")


@table_query("SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, 't' || (l_partkey % 3) AS template FROM lineitem GROUP BY ALL")
def match_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shape = F.element_at(F.array(F.lit("/part/"), F.lit("/orders/"), F.lit("/a/b/")), (F.col("l_partkey") % 3 + 1).cast("int"))
    concrete = item.select(F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))).alias("id"), F.concat(shape, F.col("l_partkey").cast("string")).alias("path")).distinct()
    templates = spark.createDataFrame([("t0", "/part/{id}"), ("t1", "/orders/:id"), ("t2", "/a/*"), ("t9", "/z/{x}/y")], "id string, path string")
    return resolution.match_routes(concrete, templates)


@table_query("""WITH p AS (SELECT DISTINCT p_brand AS name, p_partkey % 4 AS a, p_partkey % 7 AS b, p_partkey % 5 AS c, CASE WHEN p_size % 5 = 0 THEN 'dev' ELSE 'runtime' END AS scope FROM part)
SELECT name, a || '.' || b || '.' || c AS version, 'affected' AS verdict, CAST(min(CASE WHEN scope = 'dev' THEN 1 ELSE 0 END) AS INTEGER) AS level FROM p WHERE a * 100 + b >= 100 AND a * 100 + b < 203 GROUP BY 1, 2""")
def vulnerable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda m: (k % m).cast("string")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    packages = part.select(F.lit("p").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat_ws(".", text(4), text(7), text(5)).alias("version"), F.when(F.col("p_size") % 5 == 0, "dev").otherwise("runtime").alias("scope"))
    packages = packages.groupBy("ecosystem", "name", "version").agg(F.max("scope").alias("scope"))
    bound = lambda t, b: F.struct(F.lit(t).alias("type"), F.lit(b).alias("bound"))
    ranges = F.array(F.struct(F.lit("SEMVER").alias("kind"), F.array(bound("introduced", "1.0.0"), bound("fixed", "2.3.0")).alias("events")))
    affected = F.array(F.struct(F.lit("p").alias("ecosystem"), F.col("p_brand").alias("name"), F.expr("cast(null as array<string>)").alias("versions"), ranges.alias("ranges")))
    vector = F.array(F.struct(F.lit("CVSS_V3").alias("kind"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("score")))
    adv = part.select("p_brand").distinct().select(F.concat(F.lit("ADV-"), "p_brand").alias("id"), F.lit(False).alias("withdrawn"), vector.alias("severity"), affected.alias("affected"))
    return vuln.scan(packages, adv).select("name", "version", "verdict", F.substring("priority", 2, 1).cast("int").alias("level"))


@graph_query("""WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE relation IN ('contains', 'method')), r AS (SELECT 'region:1' AS id), l1 AS (SELECT DISTINCT dst AS id FROM e JOIN r ON r.id = src), l2 AS (SELECT DISTINCT dst AS id FROM e JOIN l1 ON l1.id = src),
l3 AS (SELECT DISTINCT dst AS id FROM e JOIN l2 ON l2.id = src) SELECT depth, count(*) AS n FROM (SELECT id, 0 AS depth FROM r UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) GROUP BY 1""")
def runtime_reach(g: Graph) -> DataFrame:
    links = g.edges.where("relation in ('contains', 'method')").select("src", "dst", F.lit("run").alias("scope"))
    return vuln.runtime_reachable(g.spark.createDataFrame([("region:1",)], "key string"), links).groupBy("depth").agg(F.count("*").alias("n"))


@table_query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*["'']?)[^\s"'']{6,}', '\1***', 'g'), '\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[A-Fa-f0-9]{40})\b', '***', 'g')) AS digest FROM documents""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(contracts.redact(F.col("text"))).alias("digest"))


@graph_query("""SELECT part, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT 1 AS part, '  "' || id || '" [label="' || label || '"];' AS line FROM nodes UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '" [label="' || relation || '"];' FROM edges) GROUP BY 1""")
def dot_lines(g: Graph) -> DataFrame:
    return exports.dot(g).where("part in (1, 2)").groupBy("part").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@graph_query("SELECT regexp_replace(source_file, '/?[^/]*$', '') AS folder, count(DISTINCT source_file) AS files, count(*) AS symbols FROM nodes GROUP BY 1")
def file_tree(g: Graph) -> DataFrame:
    return exports.file_tree(g).groupBy("folder").agg(F.count("*").alias("files"), F.sum(F.size("symbols")).alias("symbols"))


@graph_query("SELECT id, label FROM nodes WHERE contains(source_file, 'EUROPE/')")
def outline_europe(g: Graph) -> DataFrame:
    return builder.outline(g, "EUROPE/").select("id", "label")


@table_query("""WITH t AS (SELECT DISTINCT user_id || '|' || strftime(ts, '%Y-%m-%d') AS c, event_type AS file FROM events), i AS (SELECT c, min(ts) AS t0 FROM (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS c, ts FROM events) GROUP BY 1),
p AS (SELECT a.c, a.file AS seed, b.file AS file FROM t a JOIN t b USING (c) WHERE a.file <> b.file), f AS (SELECT DISTINCT seed, file FROM p),
g AS (SELECT t.c, t0, t.file AS seed, f.file, CASE WHEN p.c IS NULL THEN 0 ELSE 1 END AS hit FROM t JOIN i USING (c) JOIN f ON f.seed = t.file LEFT JOIN p ON p.c = t.c AND p.seed = t.file AND p.file = f.file),
s AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY seed, file ORDER BY t0, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS support, count(*) OVER (PARTITION BY seed, file ORDER BY t0, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g)
SELECT seed, file, count(*) AS n, CAST(sum(support) AS BIGINT) AS support, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(hit) AS BIGINT) AS hits FROM s WHERE support > 0 GROUP BY 1, 2""")
def as_of_co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = _transactions(spark, sf_dir)
    first = tx.groupBy("commit").agg(F.min("ts").alias("idx"))
    s = metrics.history_samples(tx.join(first, "commit"))
    return s.groupBy("seed", "file").agg(F.count("*").alias("n"), F.sum("support").alias("support"), F.sum("seen").alias("seen"), F.sum(F.col("hit").cast("long")).alias("hits"))


@graph_query("""WITH f AS (SELECT o_orderkey AS number, 'part/' || p_name AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey UNION SELECT o_orderkey, 'customer/' || c_name FROM orders JOIN customer ON c_custkey = o_custkey),
h AS (SELECT DISTINCT number, community FROM f JOIN nodes ON split_part(path, '/', 1) = split_part(id, ':', 1) AND label = split_part(path, '/', 2) WHERE community IS NOT NULL)
SELECT community, string_agg(number, ',' ORDER BY number) AS numbers FROM h GROUP BY 1 HAVING count(*) >= 2""")
def pull_conflicts(g: Graph) -> DataFrame:
    some = g.edges.where("relation in ('uses', 'method')")
    orders = some.where("relation = 'uses'").select(F.col("src").alias("o"), F.col("dst").alias("id")).unionAll(some.where("relation = 'method'").select(F.col("dst").alias("o"), F.col("src").alias("id")))
    number = F.expr("cast(substring(o, 7) as bigint)")
    files = orders.join(unique(g.nodes.select("id", "label")), "id").select(number.alias("number"), F.concat_ws("/", F.split_part("id", F.lit(":"), F.lit(1)), "label").alias("path"))
    return pulls.conflicts(files, g).select("community", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


#: The first customer, and of the customers that hang at the same root the last one.
_ENDS = """c AS (SELECT DISTINCT dst AS id, src AS up FROM edges WHERE relation = 'contains'),
k AS (SELECT a.id, b.up AS root FROM c a JOIN c b ON b.id = a.up WHERE a.id LIKE 'customer:%'),
ends AS (SELECT min(id) AS first, max(id) FILTER (root = (SELECT arg_min(root, id) FROM k)) AS last FROM k)"""


@graph_query(f"""WITH {_ENDS},
n AS (SELECT id AS a, up AS b FROM c UNION ALL SELECT up, id FROM c),
walk AS (WITH RECURSIVE w AS (SELECT first AS id, [first] AS path FROM ends UNION ALL SELECT n.b, list_append(path, n.b) FROM w JOIN n ON n.a = w.id WHERE NOT list_contains(path, n.b)) SELECT * FROM w)
SELECT CAST(unnest(range(len(path))) AS INTEGER) AS position, unnest(path) AS id FROM walk WHERE id = (SELECT last FROM ends)""")
def path_between_customers(g: Graph) -> DataFrame:
    tree = g.with_(edges=g.edges.where("relation = 'contains'"))
    up = tree.edges.select(F.col("dst").alias("id"), F.col("src").alias("up"))
    k = up.where("id like 'customer:%'").join(up.select(F.col("id").alias("up"), F.col("up").alias("root")), "up")
    first = k.agg(F.min("id"), F.min_by("root", "id")).first()
    last = k.where(F.col("root") == first[1]).agg(F.max("id")).first()[0]
    found = traversal.shortest_path(tree, first[0], last)
    return g.spark.createDataFrame(list(enumerate(found or [])), "position int, id string")


@graph_query()
def edge_betweenness(g: Graph) -> DataFrame:
    return community.betweenness(g, edges=True)


@graph_query(_SURPRISE + """, h AS (SELECT id, count(DISTINCT n) AS k FROM (SELECT src AS id, dst AS n FROM edges WHERE weight > 0 AND src <> dst UNION ALL SELECT dst, src FROM edges WHERE weight > 0 AND src <> dst) GROUP BY id)
SELECT 1 AS family, 'What depends on ' || label || '?' AS question, id FROM (SELECT nodes.* FROM nodes JOIN h USING (id) ORDER BY k DESC, id LIMIT 3)
UNION ALL SELECT 2, 'Why is ' || src_label || ' linked to ' || dst_label || '?', src FROM (SELECT * FROM s ORDER BY score DESC, src_label, dst_label, src, dst, relation, context LIMIT 3)
UNION ALL SELECT 3, 'Is ' || src || ' really linked to ' || dst || '?', src FROM (SELECT DISTINCT src, dst FROM edges WHERE confidence = 'AMBIGUOUS' ORDER BY 1, 2 LIMIT 3)
UNION ALL SELECT 4, 'What is ' || label || ' for?', id FROM (SELECT * FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges) ORDER BY id LIMIT 3)""")
def suggested_questions(g: Graph) -> DataFrame:
    return analytics.questions(g, 12)


@table_query(r"""SELECT 'file:documents/' || doc_id || '.py' AS src, count(*) AS n FROM (SELECT doc_id, unnest(range(doc_id % 3)) AS k FROM documents) GROUP BY 1""")
def detected_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    calls = F.transform(F.sequence(F.lit(1), F.greatest((F.col("doc_id") % 3).cast("int"), F.lit(1))), lambda k: F.concat(F.lit('requests.get("/api/'), k.cast("string"), F.lit('")\n')))
    content = F.when(F.col("doc_id") % 3 > 0, F.array_join(calls, "")).otherwise('# requests.get("/none")\n')
    files = d.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), content.alias("content"))
    return ingest.detect_links(files).groupBy("src").agg(F.count("*").alias("n"))
