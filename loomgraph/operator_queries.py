"""Registered queries of single operators over whole tables: properties, components, contracts, calibration, twins, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import analytics, contracts, dedup, metrics, primitives, sqlaudit
from .queries import _label_samples, graph_query, table_query


@graph_query("""SELECT id, kind, regexp_replace(label, '\\(\\)$', '') AS name, source_file AS file,
CASE WHEN position('.' IN string_split(source_file, '/')[-1]) > 0 THEN lower(string_split(source_file, '.')[-1]) END AS lang, visibility, CAST(loc AS DOUBLE) AS loc, CAST(community AS DOUBLE) AS community FROM nodes""")
def node_properties(g: Graph) -> DataFrame:
    return primitives.node_props(g).select("id", "kind", "name", "file", "lang", "visibility", "loc", "community")


@table_query("SELECT doc_id, doc_id % 8 IN (1, 2, 4, 6) AS is_test FROM documents")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file with one of eight forms of a path."""
    forms = ("src/main.py", "src/test_main.py", "Tests/a.txt", "tests", "pkg/main_test.go", "contest/a.py", "web\\app.spec.ts", "test_main.txt")
    path = F.element_at(F.array(*(F.lit(f) for f in forms)), (F.col("doc_id") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", primitives.is_test_path(path).alias("is_test"))


#: Nations that buy from nations, in large amounts: the groups that trade in a ring.
@table_query("""WITH RECURSIVE p AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 49.5 AND o_totalprice > 300000),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT x.a AS id, CAST(min(least(x.a, x.b)) AS BIGINT) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1""")
def trading_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sold = t("lineitem").where("l_quantity >= 49.5").join(t("orders").where("o_totalprice > 300000"), F.col("o_orderkey") == F.col("l_orderkey"))
    trade = sold.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return analytics.strong_components(trade.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))).select("id", F.col("component").cast("long").alias("component"))


# Contracts: every part is an operation; the new version drops, adds, renames and retypes some by their number.


def _operations(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    k = F.col("p_partkey")
    field = lambda kind, need: F.struct(kind.alias("type"), need.alias("required"), F.array().cast("array<string>").alias("enum_values"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where(k % 10 != (0 if new else 1))
    size = field(F.when((k % 7 == 0) & F.lit(new), "string").otherwise("integer"), (k % 5 == 0) & F.lit(new))
    return part.select(
        F.lit("shop").alias("vendor"), F.concat(F.when((k % 6 == 0) & F.lit(new), "n").otherwise("p"), k.cast("string")).alias("key"), F.lit("http").alias("protocol"), F.when((k % 8 == 0) & F.lit(new), "PUT").otherwise("POST").alias("method"),
        F.concat(F.lit("/parts/"), k.cast("string"), F.lit("/{}")).alias("canonical_path"), F.lit(False).alias("webhook"), F.when((k % 9 == 0) & F.lit(new), "token").otherwise("none").alias("security_digest"),
        F.create_map(F.lit("size"), size).alias("request_fields"), F.create_map(F.when((k % 4 == 0) & F.lit(new), "cost").otherwise("price"), field(F.lit("number"), F.lit(True))).alias("response_fields"),
    )


_OPERATIONS = """o AS (SELECT p_partkey AS k, 'p' || p_partkey AS key, 'POST' AS method FROM part WHERE p_partkey % 10 <> 1),
n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'n' ELSE 'p' END || p_partkey AS key, CASE WHEN p_partkey % 8 = 0 THEN 'PUT' ELSE 'POST' END AS method FROM part WHERE p_partkey % 10 <> 0),
m AS (SELECT o.k, o.key, n.key AS now, n.method FROM o JOIN n USING (k) WHERE o.key = n.key OR o.method = n.method)"""


@table_query(f"""WITH {_OPERATIONS}
SELECT key, 'removed' AS change, NULL AS field, NULL AS detail FROM o WHERE k NOT IN (SELECT k FROM m)
UNION ALL SELECT key, 'added', NULL, NULL FROM n WHERE k NOT IN (SELECT k FROM m)
UNION ALL SELECT key, 'renamed', NULL, now FROM m WHERE key <> now
UNION ALL SELECT key, 'moved', NULL, 'PUT /parts/' || k || '/{{}}' FROM m WHERE method = 'PUT'
UNION ALL SELECT key, 'security', NULL, NULL FROM m WHERE k % 9 = 0
UNION ALL SELECT key, CASE WHEN k % 5 = 0 THEN 'request_required' ELSE 'request_retyped' END, 'size', 'integer -> ' || CASE WHEN k % 7 = 0 THEN 'string' ELSE 'integer' END FROM m WHERE k % 5 = 0 OR k % 7 = 0
UNION ALL SELECT key, 'response_removed', 'price', 'number' FROM m WHERE k % 4 = 0""")
def contract_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.diff(_operations(spark, sf_dir, False), _operations(spark, sf_dir, True))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item calls the operation of its part, at a host that two suppliers in three share with no other vendor."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = F.concat(F.lit("/parts/"), F.col("l_partkey").cast("string"), F.lit("/:id/"))
    host = F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string"))
    return item.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), host.alias("host"), F.lit("POST").alias("method"), path.alias("path"), F.lit("a").alias("source_file"), F.lit("L1").alias("source_location"))


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.createDataFrame([("h0", "shop"), ("h1", "shop"), ("h1", "other"), ("h2", "shop")], "host string, vendor string")
    return contracts.bind_http(_calls(spark, sf_dir), hosts, _operations(spark, sf_dir, False))


@table_query("SELECT DISTINCT 'order:' || l_orderkey AS src, 'p' || l_partkey AS key FROM lineitem WHERE l_suppkey % 3 <> 1 AND l_partkey % 10 <> 1 AND l_partkey IN (SELECT p_partkey FROM part)")
def bound_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bindings(spark, sf_dir).select("src", "key")


@table_query(f"""WITH {_OPERATIONS}, b AS (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem WHERE l_suppkey % 3 <> 1), c AS (SELECT k, count(*) AS callers FROM b GROUP BY 1)
SELECT 'p' || k AS key, coalesce(callers, 0) AS callers, CASE WHEN callers > 0 THEN 'affected' ELSE 'no_usage' END AS verdict FROM (SELECT k FROM o WHERE k NOT IN (SELECT k FROM m)) LEFT JOIN c USING (k)""")
def removed_operations_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = contracts.diff(_operations(spark, sf_dir, False), _operations(spark, sf_dir, True)).where("change = 'removed'")
    return contracts.relevance(changes, _bindings(spark, sf_dir)).select("key", "callers", "verdict")


@table_query("""WITH b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey % 3 <> 1)
SELECT CASE WHEN p_partkey % 10 <> 1 AND p_partkey IN (SELECT k FROM b) THEN 'bound' WHEN p_partkey % 10 <> 1 THEN 'modelled' WHEN p_size % 2 = 0 THEN 'identified' ELSE 'observed' END AS state, count(*) AS n FROM part GROUP BY 1""")
def contract_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") % 2 == 0, "shop").alias("vendor"))
    return contracts.coverage(seen, _operations(spark, sf_dir, False), _bindings(spark, sf_dir))


# Scores


@table_query("""WITH s AS (SELECT least(1.0, n_chars / 8000.0) AS c, CAST(quality AS DOUBLE) AS h FROM documents JOIN labels USING (doc_id)),
b AS (SELECT count(*) AS n, abs(avg(c) - avg(h)) AS gap FROM s GROUP BY least(floor(c * 10), 9)), t AS (SELECT avg(pow(c - h, 2)) AS brier, avg(h) AS rate FROM s)
SELECT round((SELECT sum(gap * n) / sum(n) FROM b), 9) AS ece, round(brier, 9) AS brier, round(CASE WHEN rate * (1 - rate) > 0 THEN 1 - brier / (rate * (1 - rate)) ELSE 0 END, 9) AS skill FROM t""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(_label_samples(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("ece", "brier", "skill")))


@table_query("""WITH d AS (SELECT DISTINCT lang, doc_id, n_chars > 1000 AS p, quality = 1 AS r FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) FILTER (p) AS n_predicted, count(*) FILTER (r) AS n_relevant, count(*) FILTER (p AND r) AS hits FROM d)
SELECT n_predicted, n_relevant, hits, CAST(floor((hits * 200 + n_predicted) / (n_predicted * 2)) AS INTEGER) AS precision, CAST(floor((hits * 200 + n_relevant) / (n_relevant * 2)) AS INTEGER) AS recall,
CAST(floor((2 * hits * 200 + n_predicted + n_relevant) / ((n_predicted + n_relevant) * 2)) AS INTEGER) AS f1 FROM s""")
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return metrics.pooled(metrics.set_scores(d.where("n_chars > 1000"), d.where("quality = 1"), ["doc_id"], ["lang"]))


# Names and lines


@table_query("""WITH n AS (SELECT 'part:' || p_partkey AS id, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS words FROM part), g AS (SELECT words, min(id) AS head FROM n GROUP BY 1)
SELECT id, head FROM n JOIN g USING (words) WHERE id <> head""")
def word_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the same words; every other name has its words the other way round."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    turned = F.when(F.col("p_partkey") % 2 == 0, F.array_join(F.reverse(F.split("p_name", " ")), "_")).otherwise(F.upper("p_name"))
    return dedup.token_twins(part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), turned.alias("label")))


@table_query("""SELECT 'o' || l_orderkey AS path, l_linenumber * 10 AS line FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_linenumber * 10 - (o_orderkey % 40) BETWEEN 1 AND 15 AND o_orderkey % 3 = 0) GROUP BY 1, 2""")
def queries_in_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a file with one line of code, in every third a loop's head; every line item is a query there."""
    k = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(name("o_orderkey").alias("path"), (k % 40).cast("int").alias("line"), F.when(k % 3 == 0, "    for x in rows:").otherwise("x = 1").alias("text"))
    sites = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(name("l_orderkey").alias("path"), (F.col("l_linenumber") * 10).alias("line"))
    return sqlaudit.loop_queries(lines, sites)
