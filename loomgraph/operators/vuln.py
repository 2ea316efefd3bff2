"""Vulnerability matching: packages against advisories, severity, priority, reach, remediation, policy."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.version import band, cvss3, range_verdict, version_key
from ..graph import cut, is_empty


def scan(packages: DataFrame, advisories: DataFrame, exceptions: DataFrame | None = None, today: str = "9999-12-31") -> DataFrame:
    """Findings: packages (ecosystem, name, version, scope) joined to affected ranges on the package; withdrawn advisories are left out.

    advisories: id, withdrawn, severity (array of kind and score), affected (array of ecosystem, name, versions, ranges
    of events).  exceptions: advisory, package, expires (ISO date).  A package of several scopes is a finding in each; of
    several affected entries that hit one version the surest counts.
    """
    a = advisories.where("not coalesce(withdrawn, false)").select("id", "severity", F.explode("affected").alias("x"))
    a = a.select("id", "severity", F.col("x.ecosystem").alias("ecosystem"), F.col("x.name").alias("name"), F.col("x.versions").alias("versions"), F.transform("x.ranges", lambda r: r.events).alias("ranges"))
    j = packages.join(a, ["ecosystem", "name"])
    j = j.withColumn("verdict", range_verdict("version", "versions", "ranges")).where("verdict <> 'unaffected'")
    score = cvss3(F.get(F.filter("severity", lambda s: s.kind == "CVSS_V3"), F.lit(0)).score)
    out = j.select(F.concat_ws("|", "id", "ecosystem", "name", "version").alias("finding"), F.col("id").alias("advisory"), "ecosystem", "name", "version", "scope", "verdict", score.alias("score"), "ranges")
    first = F.struct(F.col("verdict") != "affected", "verdict", F.to_json("ranges"))
    out = out.groupBy("finding", "scope").agg(F.min_by(F.struct(*(c for c in out.columns if c not in ("finding", "scope"))), first).alias("x")).select("finding", "scope", "x.*")
    if exceptions is not None:
        live = exceptions.where(F.col("expires") >= today).select("advisory", F.col("package").alias("name"))
        out = out.join(live, ["advisory", "name"], "left_anti")
    out = out.withColumn("band", band(F.col("score"))).withColumn("priority", priority())
    return out.orderBy("priority", "finding", "scope")


def priority() -> Column:
    """P0 to P3: from the band, one less for undetermined versions and for development scope."""
    base = F.when(F.col("band") == "critical", 0).when(F.col("band") == "high", 1).when(F.col("band").isin("medium", "unknown"), 2).otherwise(3)
    shift = F.when(F.col("verdict") == "undetermined", 1).otherwise(0) + F.when(F.col("scope") == "dev", 1).otherwise(0)
    return F.concat(F.lit("P"), F.least(base + shift, F.lit(3)).cast("string"))


def applicability(findings: DataFrame, usage: DataFrame) -> DataFrame:
    """(finding, verdict, evidence): used functions make it applicable, no use of the package at all not applicable, else unknown.

    usage: name, functions (array), sites.
    """
    j = findings.join(usage, "name", "left")
    verdict = F.when(F.col("sites").isNull(), "not_used").when(F.col("sites") > 0, "applicable").otherwise("unknown")
    evidence = F.array_compact(F.array(F.when(F.col("sites") > 0, F.concat(F.lit("call sites: "), F.col("sites").cast("string"))), F.when(F.col("verdict") == "undetermined", F.lit("version undetermined"))))
    return j.select("finding", verdict.alias("applicability"), evidence.alias("evidence"))


def runtime_reachable(roots: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(key, depth, parent): packages reached from the roots over non-development links; multi-source shortest paths.

    roots: key; links: src, dst, scope.  ``most`` bounds the depth where a caller wants that.
    """
    steps = cut(links.where("coalesce(scope, '') <> 'dev'").select("src", "dst").distinct(), "steps")
    front = cut(roots.select("key", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct(), "roots")
    found, seen = [front], front.select("key")
    for d in count(1) if most is None else range(1, most + 1):
        level = front.select(F.col("key").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("key")).agg(F.min("src").alias("parent"))
        front = cut(level.join(seen, "key", "left_anti").select("key", F.lit(d).alias("depth"), "parent"), "level")
        if is_empty(front):
            break
        found.append(front)
        seen = seen.unionAll(front.select("key"))
    return reduce(DataFrame.unionAll, found)


def fixes(findings: DataFrame) -> DataFrame:
    """(finding, fix, risk): the lowest fixed version above the installed one, else the lowest; and the size of the step."""
    each = findings.select("finding", "version", F.explode(F.flatten("ranges")).alias("e")).where("e.type = 'fixed'").select("finding", "version", F.col("e.bound").alias("fix")).distinct()
    each = each.withColumn("have", version_key("version")).withColumn("key", version_key("fix"))
    above = F.when(F.col("key") > F.col("have"), 0).otherwise(1)
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("finding").orderBy(above, "key.major", "key.minor", "key.patch", "key.final", "fix"))).where("r = 1")
    return best.select("finding", "fix", step_risk(F.col("have"), F.col("key")).alias("risk"))


def step_risk(a: Column, b: Column) -> Column:
    major, minor = a.getField("major"), a.getField("minor")
    out = F.when(major.isNull() | b.getField("major").isNull(), "unknown").when(major != b.getField("major"), "major")
    return out.when(minor != b.getField("minor"), F.when(major == 0, "major").otherwise("minor")).otherwise("patch")


def policy(packages: DataFrame, rules: DataFrame, today: str) -> DataFrame:
    """packages with decision: the first matching rule by its order; exceptions only up to their date.

    rules: ord, package, action (deny, pin, exception), version, expires.
    """
    r = rules.where((F.col("action") != "exception") | (F.col("expires") >= today)).select("ord", F.col("package").alias("name"), "action", F.col("version").alias("rule_version"))
    j = packages.join(r, "name", "left")
    best = j.groupBy(*packages.columns).agg(F.min_by("action", "ord").alias("action"), F.min_by("rule_version", "ord").alias("rule_version"))
    decision = F.when(F.col("action") == "deny", "denied").when((F.col("action") == "pin") & (F.col("version") != F.col("rule_version")), "pin").when(F.col("action") == "exception", "excepted").otherwise("allowed")
    return best.withColumn("decision", decision).drop("action", "rule_version")


def refresh_ledger(ledger: DataFrame, findings: DataFrame) -> DataFrame:
    """States and decisions stay; findings that are gone become resolved, new ones open.  ledger: finding, state, history."""
    j = ledger.join(findings.select("finding", F.lit(True).alias("here")), "finding", "full_outer")
    state = F.when(F.col("here").isNull(), "resolved").when(F.col("state").isNull(), "open").when(F.col("state") == "resolved", "open").otherwise(F.col("state"))
    changed = ~F.col("state").eqNullSafe(state)
    history = F.coalesce("history", F.array().cast("array<string>"))
    return j.select("finding", state.alias("state"), F.when(changed, F.array_append(history, state)).otherwise(history).alias("history"))


def closed_gates(optional: DataFrame, enabled: DataFrame) -> DataFrame:
    """Optional dependencies (package, feature) that no enabled feature turns on."""
    return optional.join(enabled, ["package", "feature"], "left_anti").orderBy("package", "feature")


def dependency_check(spark, ecosystem: str, name: str, version: str, advisories: DataFrame, rules: DataFrame, today: str) -> tuple[str, str | None]:
    """('blocked' | 'constrained' | 'allowed', least version): a deny rule first, then affected versions, whose floor is the highest of the lowest fixes and pins."""
    from ..functions.version import compare

    one = spark.createDataFrame([(ecosystem, name, version, "runtime")], "ecosystem string, name string, version string, scope string")
    mine = rules.where((F.col("package") == name) & ((F.col("action") != "exception") | (F.col("expires") >= today))).orderBy("ord").collect()
    if any(r.action == "deny" for r in mine):
        return "blocked", None
    hits = scan(one, advisories)
    floors = [r.fix for r in fixes(hits).collect()] + [r.version for r in mine if r.action == "pin"]
    floor = None
    for f in floors:
        if floor is None or (compare(f, floor) or 0) > 0:
            floor = f
    if not hits.limit(1).take(1):
        return ("constrained", floor) if floor and compare(version, floor) == -1 else ("allowed", floor)
    return ("constrained", floor) if floor else ("blocked", None)


def usage(g, packages: DataFrame) -> DataFrame:
    """(name, sites, functions): external stubs of a package (label `package` or `package/member`) that located sources reach."""
    stubs = g.nodes.where("coalesce(source_file, '') = ''").select(F.col("id").alias("dst"), F.split_part("label", F.lit("/"), F.lit(1)).alias("name"), F.split_part("label", F.lit("/"), F.lit(2)).alias("member"))
    located = g.nodes.where("source_file <> ''").select(F.col("id").alias("src"))
    e = g.edges.select("src", "dst").join(located, "src", "left_semi").join(stubs, "dst").join(packages.select("name").distinct(), "name", "left_semi")
    return e.groupBy("name").agg(F.count_distinct("src").alias("sites"), F.array_sort(F.collect_set(F.nullif("member", F.lit("")))).alias("functions"))


def remediation_scope(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """(advisory, files, symbols): what a fix touches.  sites: name, file, symbol."""
    return findings.join(sites, "name").groupBy("advisory").agg(F.count_distinct("file").alias("files"), F.count_distinct("symbol").alias("symbols"))
