"""Audit rules over SQL-shaped graphs and query texts: each rule is a filter or an anti-join, the run is their union."""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, cut

# Rule ids with severity and category, and the words that they look for.
RULES = {
    "SEC-RLS-001": ("high", "security"), "SEC-RLS-002": ("medium", "security"), "SEC-RLS-003": ("medium", "security"), "SEC-RLS-004": ("high", "security"), "SEC-RLS-005": ("medium", "security"),
    "SEC-GRANT-001": ("high", "security"), "SEC-PII-001": ("low", "security"), "SEC-INJ-001": ("high", "security"), "PERF-IDX-001": ("medium", "performance"), "PERF-IDX-002": ("high", "performance"),
    "PERF-SEL-001": ("low", "performance"), "PERF-RAND-001": ("medium", "performance"), "PERF-DML-001": ("high", "performance"), "PERF-SARG-001": ("medium", "performance"), "PERF-JOIN-001": ("medium", "performance"),
    "PERF-OR-001": ("low", "performance"), "PERF-N1-001": ("medium", "performance"), "DES-PK-001": ("medium", "design"), "DES-FK-001": ("low", "design"), "DES-INS-001": ("low", "design"),
}
SEVERITY = ("critical", "high", "medium", "low", "info")
TENANT = ("tenant_id", "org_id", "organization_id", "account_id", "workspace_id")
PERSONAL = ("email", "phone", "ssn", "birth_date", "address", "passport", "iban")
SECRET = ("password", "secret", "token", "api_key", "ssn")


def prop(name: str) -> Column:
    return F.get_json_object("extra", f"$.{name}")


def flag(name: str) -> Column:
    return F.coalesce(F.lower(prop(name)) == "true", F.lit(False))


def finding(rows: DataFrame, rule: str, ids: Column, text: Column, location: Column | None = None, snippet: Column | None = None, confidence: float = 1.0) -> DataFrame:
    severity, category = RULES[rule]
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), text.alias("text"), ids.alias("node_ids"),
        (none if location is None else location).alias("location"), (none if snippet is None else snippet).alias("snippet"), F.lit(confidence).alias("confidence"),
    )


def _of(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("kind") == kind)


def columns_of(g: Graph) -> DataFrame:
    """(table, id, name, extra) of the columns of tables."""
    c = _of(g, "column").select(F.col("id").alias("dst"), F.lower(F.element_at(F.split("label", r"\."), -1)).alias("name"), "extra")
    return g.edges.where("relation = 'has_column'").select(F.col("src").alias("table"), "dst").distinct().join(c, "dst").withColumnRenamed("dst", "id")


def indexed_columns(g: Graph) -> DataFrame:
    """(table, name): columns that an index of the table covers."""
    owns = g.edges.where("relation = 'has_index'").select(F.col("src").alias("table"), F.col("dst").alias("src"))
    covers = g.edges.where("relation = 'indexes'").select("src", F.col("dst").alias("id"))
    names = _of(g, "column").select("id", F.lower(F.element_at(F.split("label", r"\."), -1)).alias("name"))
    return owns.join(covers, "src").join(names, "id").select("table", "name").distinct()


def _tables_with(g: Graph, names: tuple[str, ...]) -> DataFrame:
    has = columns_of(g).where(F.col("name").isin(*names)).select(F.col("table").alias("id"))
    return _of(g, "table").join(has, "id", "left_semi")


def rls_rules(g: Graph) -> DataFrame:
    tenant = _tables_with(g, TENANT).where(~flag("rls_enabled"))
    forced = _of(g, "table").where(flag("rls_enabled") & ~flag("rls_forced"))
    policy = _of(g, "policy").where(prop("using").isNotNull() & prop("with_check").isNull())
    guarded = _of(g, "table").where(flag("rls_enabled")).select(F.col("id").alias("dst"))
    views = _of(g, "view").where(~flag("security_invoker")).select(F.col("id").alias("src"), "label")
    through = g.edges.where("relation = 'reads_from'").select("src", "dst").join(guarded, "dst").join(views, "src").groupBy("src", "label").agg(F.min("dst").alias("dst"))
    secret = _tables_with(g, SECRET).where(F.lower(prop("dialect")) == "sqlserver")
    held = g.edges.where("relation = 'protected_by'").select(F.col("src").alias("id"))
    bare = secret.join(held, "id", "left_anti")
    one = F.array("id")
    return reduce(
        DataFrame.unionAll,
        [
            finding(tenant, "SEC-RLS-001", one, F.concat(F.lit("tenant table without row security: "), "label")),
            finding(forced, "SEC-RLS-002", one, F.concat(F.lit("row security is not forced: "), "label")),
            finding(policy, "SEC-RLS-003", one, F.concat(F.lit("policy without a check on writes: "), "label")),
            finding(through, "SEC-RLS-004", F.array("src", "dst"), F.concat(F.lit("view reads a guarded table as its owner: "), "label")),
            finding(bare, "SEC-RLS-005", one, F.concat(F.lit("secret columns without a policy: "), "label")),
        ],
    )


def grant_rules(g: Graph) -> DataFrame:
    e = g.edges.where("relation = 'grants'").select("src", "dst", F.upper(F.coalesce("context", F.lit(""))).alias("privilege")).join(g.nodes.select(F.col("id").alias("dst"), F.lower("label").alias("grantee")), "dst")
    wide = e.where("privilege like 'ALL%' or grantee = 'public'")
    return finding(wide, "SEC-GRANT-001", F.array("src", "dst"), F.concat(F.lit("wide grant of "), "privilege", F.lit(" to "), "grantee"))


def column_rules(g: Graph) -> DataFrame:
    c = columns_of(g)
    personal = c.where(reduce(lambda a, b: a | b, [(F.col("name") == w) | F.endswith("name", F.lit("_" + w)) for w in PERSONAL]))
    keys = c.where(F.col("name").like("%_id"))
    plain = keys.join(indexed_columns(g), ["table", "name"], "left_anti")
    loose = keys.where(~flag_of("pk") & ~flag_of("identity") & ~flag_of("fk"))
    lacking = c.groupBy("table").agg(F.max(flag_of("pk")).alias("pk")).where("not pk")
    both = F.array("table", "id")
    return reduce(
        DataFrame.unionAll,
        [
            finding(personal, "SEC-PII-001", both, F.concat(F.lit("personal data: "), "name")),
            finding(plain, "PERF-IDX-001", both, F.concat(F.lit("key column without an index: "), "name")),
            finding(loose, "DES-FK-001", both, F.concat(F.lit("key column without a foreign key: "), "name")),
            finding(lacking, "DES-PK-001", F.array("table"), F.concat(F.lit("no primary key: "), "table")),
        ],
    )


def flag_of(name: str) -> Column:
    return F.coalesce(F.lower(F.get_json_object("extra", f"$.{name}")) == "true", F.lit(False))


def sql_rules(sql: str = "sql") -> Column:
    """Array of rule ids that one SQL text breaks."""
    t = F.regexp_replace(F.col(sql), r"\s+", " ")
    where = F.regexp_extract(t, r"(?i)\bwhere\b(.*)", 1)
    checks = [
        (r"(?i)\bselect\s+(distinct\s+)?\*", "PERF-SEL-001"),
        (r"(?i)\border\s+by\s+(rand|random|newid)\s*\(", "PERF-RAND-001"),
        (r"(?i)\bfrom\s+\w+(\s+\w+)?\s*,\s*\w+(?!.*\bwhere\b)", "PERF-JOIN-001"),
        (r"(?i)^\s*insert\s+into\s+[\w.\"]+\s+(values|select)\b", "DES-INS-001"),
        (r"(\|\|\s*\w+\s*\|\||'\s*\+\s*\w+|%s|\$\{|\{\w+\})", "SEC-INJ-001"),
    ]
    out = [F.when(t.rlike(p), F.lit(r)) for p, r in checks]
    out.append(F.when(t.rlike(r"(?i)^\s*(update|delete)\b") & (F.trim(where) == ""), F.lit("PERF-DML-001")))
    out.append(F.when(where.rlike(r"(?i)\b(lower|upper|date|year|substring|cast|coalesce)\s*\(\s*\w+") | where.rlike(r"(?i)\blike\s+'%"), F.lit("PERF-SARG-001")))
    names = F.regexp_extract_all(where, F.lit(r"(?i)\b(\w+)\s*=\s*[^=\s]+(?=\s+or\b|\s*$|\s*\))"), F.lit(1))
    most = F.array_max(F.transform(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n))))
    out.append(F.when(where.rlike(r"(?i)\bor\b") & (F.coalesce(most, F.lit(0)) >= 3), F.lit("PERF-OR-001")))
    return F.array_compact(F.array(*out))


def query_rules(g: Graph) -> DataFrame:
    """Rules on the SQL texts that query links carry."""
    e = g.edges.where("relation in ('queries', 'writes_to')").select("src", "dst", "source_file", "source_location", F.get_json_object("extra", "$.sql").alias("sql")).where("sql is not null and length(sql) <= 2000")
    hits = e.withColumn("rule", F.explode(sql_rules()))
    parts = [finding(hits.where(F.col("rule") == r), r, F.array("src", "dst"), F.lit(f"query breaks {r}"), F.concat_ws(":", "source_file", "source_location"), F.col("sql"), 0.8) for r in RULES if r.split("-")[1] in ("SEL", "RAND", "JOIN", "INS", "INJ", "DML", "SARG", "OR")]
    return reduce(DataFrame.unionAll, parts)


def loop_queries(lines: DataFrame, sites: DataFrame, window: int = 15) -> DataFrame:
    """(path, line): query sites with a loop header in the lines above.  lines: path, line, text; sites: path, line."""
    heads = lines.where(F.col("text").rlike(r"^\s*(for|while|foreach)\b|\.(forEach|map|each)\s*\(")).select("path", F.col("line").alias("head"))
    return sites.join(heads, "path").where(f"head < line and head >= line - {window}").select("path", "line").distinct()


def audit(g: Graph, least: str = "info", extra: tuple = ()) -> DataFrame:
    """All findings of a severity or above.  ``extra`` rules are callables from a graph to findings."""
    parts = [rls_rules(g), grant_rules(g), column_rules(g), *(r(g) for r in extra)]
    if "extra" in g.edges.columns:
        parts.append(query_rules(g))
    some = SEVERITY[: SEVERITY.index(least) + 1]
    return reduce(DataFrame.unionAll, parts).where(F.col("severity").isin(*some))


def report(findings: DataFrame) -> DataFrame:
    """Distinct by rule, location and snippet (the first by nodes stays), by severity, confidence, rule and location."""
    first = Window.partitionBy("rule_id", "location", "snippet", F.when(F.col("location").isNull(), F.array_join("node_ids", ","))).orderBy(F.array_join("node_ids", ","))
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITY)), F.col("severity"))
    return findings.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").orderBy(rank, F.desc("confidence"), "rule_id", "location", F.array_join("node_ids", ","))


def explain_signal(plan: str) -> tuple[bool, float | None, int | None]:
    """Of an EXPLAIN text: whether it scans a table in sequence, its first cost and row estimate."""
    import re

    m = re.search(r"cost=(\d+(?:\.\d+)?)\.\.(\d+(?:\.\d+)?) rows=(\d+)", plan)
    return "Seq Scan" in plan, float(m[2]) if m else None, int(m[3]) if m else None


def parses(sql: str, spark) -> bool:
    """Whether a text of at most 2000 bytes parses once placeholders are values; the session's own parser decides."""
    import re

    text = re.sub(r"%\(\w+\)s|%s|\$\d+|:\w+|\?|@\w+|\{\w*\}", "1", sql).strip().rstrip(";")
    if not text or len(sql.encode()) > 2000:
        return False
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        return True
    except Exception:  # the parser's errors have no common type here
        return False


def advise(g: Graph, sql: str) -> DataFrame:
    """(rule_id, detail) for one query: its text's rules, unknown tables, tenant tables without row security, filters without an index."""
    spark = g.spark
    one = spark.createDataFrame([(sql,)], "sql string")
    rules = one.select(F.explode(sql_rules()).alias("rule_id"), F.lit("query text").alias("detail"))
    named = F.regexp_extract_all("sql", F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-z_][\w.]*)"), F.lit(1))
    used = one.select(F.explode(F.array_distinct(F.transform(named, lambda t: F.lower(F.element_at(F.split(t, r"\."), -1))))).alias("name"))
    tables = _of(g, "table").select("id", F.lower(F.element_at(F.split("label", r"\."), -1)).alias("name"), flag("rls_enabled").alias("rls"))
    unknown = used.join(tables, "name", "left_anti").select(F.lit("ADV-TABLE-404").alias("rule_id"), F.col("name").alias("detail"))
    mine = used.join(tables, "name")
    tenant = mine.where("not rls").join(columns_of(g).where(F.col("name").isin(*TENANT)).select(F.col("table").alias("id")), "id", "left_semi").select(F.lit("SEC-RLS-001").alias("rule_id"), F.col("name").alias("detail"))
    where = F.regexp_extract("sql", r"(?is)\bwhere\b(.*)", 1)
    cols = one.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(where, F.lit(r"(?i)\b(\w+)\s*(?:=|<|>|in\b|like\b)"), F.lit(1)), lambda c: F.lower(c)))).alias("col"))
    have = columns_of(g).select(F.col("table").alias("id"), F.col("name").alias("col")).join(mine.select("id"), "id", "left_semi").join(cols, "col")
    plain = have.join(indexed_columns(g).select(F.col("table").alias("id"), F.col("name").alias("col")), ["id", "col"], "left_anti").select(F.lit("PERF-IDX-001").alias("rule_id"), F.col("col").alias("detail"))
    return rules.unionAll(unknown).unionAll(tenant).unionAll(plain).distinct().orderBy("rule_id", "detail")


#: Query texts held by the driver at once.
PLANS = 1000


def audit_with_plans(g: Graph, plan, least: str = "info") -> DataFrame:
    """The audit, and a finding for each SELECT whose plan (a callable from SQL to an EXPLAIN text) scans in sequence.

    Plans are asked for on the driver, one a distinct query text, a block of texts at a time.
    """
    base = audit(g, least)
    sql = F.get_json_object("extra", "$.sql")
    texts = cut(g.edges.where("relation = 'queries'").select(sql.alias("sql")).where("lower(ltrim(sql)) like 'select%'").distinct(), "texts")
    slow = None
    for block in iter(lambda it=texts.toLocalIterator(): list(islice(it, PLANS)), []):
        found = [(r.sql,) for r in block if explain_signal(plan(r.sql))[0]]
        if found:
            part = cut(g.spark.createDataFrame(found, "sql string"), "slow")
            slow = part if slow is None else slow.unionAll(part)
    if slow is None:
        return base
    rows = g.edges.select("src", "dst", sql.alias("sql")).join(slow, "sql")
    return base.unionAll(
        rows.select(
            F.lit("PERF-PLAN-001").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("performance").alias("category"), F.lit("the plan scans a table in sequence").alias("text"),
            F.array("src", "dst").alias("node_ids"), F.lit(None).cast("string").alias("location"), F.col("sql").alias("snippet"), F.lit(1.0).alias("confidence"),
        )
    )
