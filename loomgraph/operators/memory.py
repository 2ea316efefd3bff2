"""Memory records: search with access rules, supersession, summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_tokens, tokens
from ..graph import Graph


@dataclass(frozen=True)
class Principal:
    id: str
    repositories: tuple[str, ...] = ()
    workspaces: tuple[str, ...] = ()
    allow_all_private: bool = False
    extra: dict = field(default_factory=dict)


def can_access(p: Principal) -> Column:
    """Private records to their owner, repository and workspace records to those named (or *)."""
    repo = F.lit(True) if "*" in p.repositories else F.col("repository").isin(*p.repositories) if p.repositories else F.lit(False)
    work = F.lit(True) if "*" in p.workspaces else F.col("workspace").isin(*p.workspaces) if p.workspaces else F.lit(False)
    return (
        F.when(F.col("access_scope") == "private", (F.col("owner") == p.id) | F.lit(p.allow_all_private))
        .when(F.col("access_scope") == "repository", repo)
        .when(F.col("access_scope") == "workspace", work)
        .otherwise(F.lit(False))
    )


def stable_id(repository: Column, key: Column) -> Column:
    """First 24 digits of SHA-256 over repository and key (the hash is ours to choose; it only has to be stable)."""
    return F.substring(F.sha2(F.concat(repository, F.lit("\0"), key), 256), 1, 24)


def insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Adds records whose id the store lacks; of new records that share an id the first by recorded_at counts."""
    first = new.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("recorded_at", "title"))).where("r = 1").drop("r")
    return store.unionByName(first.join(store.select("id"), "id", "left_anti").select(*store.columns))


def visible(records: DataFrame, p: Principal) -> DataFrame:
    """Accessible records that are neither superseded or retracted themselves nor the target of a visible supersession."""
    seen = records.where(F.coalesce(can_access(p), F.lit(False)))
    gone = seen.select(F.explode("links").alias("l")).where("lower(l.relation) = 'supersedes'").select(F.col("l.target").alias("id"))
    return seen.where("coalesce(lifecycle, 'active') not in ('superseded', 'retracted')").join(gone, "id", "left_anti")


def search(records: DataFrame, p: Principal, query: str = "", symbol: str | None = None, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """(id, score): +4 for a symbol, a token 2 in the title, 1 in the summary, 0.4 in a source; plus confidence and verification.

    By score, then the latest, then id; a limit of 0 means 20.
    """
    some = visible(records, p)
    if kinds:
        some = some.where(F.col("kind").isin(*kinds))
    score = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    score = score + F.when(F.col("verification") == "verified", 0.5).when(F.col("verification") == "observed", 0.25).otherwise(0.0)
    words = query_tokens(query) if query else []
    found = F.lit(False)
    if symbol:
        hit = F.exists("affected_symbols", lambda s: F.contains(F.lower(s.label), F.lit(symbol.lower())) | F.contains(F.lower(s.node_id), F.lit(symbol.lower())))
        score = score + F.when(hit, 4.0).otherwise(0.0)
        found = found | hit
    if words:
        title, summary = tokens("title"), tokens("summary")
        source = F.flatten(F.transform("sources", lambda s: tokens(s.uri)))
        for w in words:
            parts = [(F.array_contains(c, w), v) for c, v in ((title, 2.0), (summary, 1.0), (source, 0.4))]
            for hit, v in parts:
                score = score + F.when(hit, v).otherwise(0.0)
                found = found | F.coalesce(hit, F.lit(False))
    if not words and not symbol:
        score, found = score + 1.0, F.lit(True)
    return some.where(found).select("id", "occurred_at", score.alias("score")).orderBy(F.desc("score"), F.desc("occurred_at"), "id").limit(limit or 20)


def summaries(g: Graph) -> DataFrame:
    """One record a community of located nodes: counts, first labels, first files, and a digest of its members."""
    n = g.nodes.where("community is not null and source_file <> ''")
    first = lambda c, k: F.slice(F.array_sort(F.collect_set(c)), 1, k)
    out = n.groupBy("community").agg(
        F.count("*").alias("members"), first("label", 12).alias("labels"), first("source_file", 8).alias("files"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("digest")
    )
    return out.select("community", "members", "labels", "files", F.sha2(F.col("digest").cast("string"), 256).alias("key"))


def commit_records(commits: DataFrame) -> DataFrame:
    """Records of change from commits (repository, commit, message, time, files)."""
    return commits.select(
        stable_id(F.col("repository"), F.concat(F.lit("git:"), F.col("commit"))).alias("id"), F.lit("change").alias("kind"), F.substring_index("message", "\n", 1).alias("title"),
        F.col("message").alias("summary"), "repository", F.col("time").alias("occurred_at"), F.transform("files", lambda f: F.struct(F.lit("modified").alias("kind"), f.alias("new_path"))).alias("path_changes"),
    )


def export_bundle(records: DataFrame, p: Principal, path: str) -> str:
    """Writes the records that a principal may see as one JSON file set; returns the digest of their ids and contents."""
    some = records.where(F.coalesce(can_access(p), F.lit(False)))
    some.write.mode("overwrite").json(path)
    return bundle_digest(some)


def bundle_digest(records: DataFrame) -> str:
    """Does not depend on the order of rows."""
    row = records.select(F.xxhash64(F.to_json(F.struct(*sorted(records.columns)))).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    import hashlib

    return hashlib.sha256(f"{row.n}|{row.s}|{row.x}".encode()).hexdigest()


def import_bundle(store: DataFrame, path: str, digest: str) -> DataFrame:
    """The store with a bundle's new records; a bundle of another digest is refused, and importing twice changes nothing."""
    rows = store.sparkSession.read.schema(store.schema).json(path)
    if bundle_digest(rows) != digest:
        raise ValueError("the bundle does not have the digest that was given")
    return insert(store, rows)


def documents(files: DataFrame, repository: str) -> DataFrame:
    """Records of decisions, procedures and conventions from Markdown files (path, content, time)."""
    kind = F.when(F.col("path").rlike(r"(?i)(^|/)(adr|decisions?)/"), "decision").when(F.col("path").rlike(r"(?i)(runbook|procedure|how-?to)"), "procedure").otherwise("convention")
    title = F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^#\s+(.+?)\s*$", 1), F.lit("")), F.element_at(F.split("path", "/"), -1))
    return files.select(
        stable_id(F.lit(repository), F.concat(F.lit("doc:"), F.col("path"))).alias("id"), kind.alias("kind"), title.alias("title"), F.substring(F.trim(F.regexp_replace("content", r"(?m)^#.*$", "")), 1, 2000).alias("summary"),
        F.lit(repository).alias("repository"), F.col("time").alias("occurred_at"),
    )
