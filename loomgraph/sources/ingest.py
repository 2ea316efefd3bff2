"""Pure transforms of ingested texts: pages, addresses, subtitles, pointers, indexes, advisories, lock files, change lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def html_to_markdown(html: str | Column, most: int = 12_000) -> Column:
    """Scripts and styles out, tags to spaces, six entities in a fixed order, white space collapsed, the first so many characters."""
    c = F.col(html) if isinstance(html, str) else html
    out = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def url_kind(url: str | Column) -> Column:
    """tweet, arxiv, youtube, github, pdf, image or webpage."""
    c = F.lower(F.col(url) if isinstance(url, str) else url)
    path = F.regexp_replace(c, r"[?#].*$", "")
    return (
        F.when(c.rlike(r"twitter\.com|//x\.com"), "tweet")
        .when(F.contains(c, F.lit("arxiv.org")), "arxiv")
        .when(c.rlike(r"youtube\.com|youtu\.be"), "youtube")
        .when(F.contains(c, F.lit("github.com")), "github")
        .when(F.endswith(path, F.lit(".pdf")), "pdf")
        .when(path.rlike(r"\.(png|jpe?g|gif|svg|webp|bmp)$"), "image")
        .otherwise("webpage")
    )


def url_admitted(url: str | Column) -> Column:
    """Only http and https to public hosts: no user part, no local names, no private or reserved addresses."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.rlike(r"^(localhost|.*\.(local|localhost|internal))$|^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\.|^\[(::1?|f[cd]|fe[89ab])")
    return c.rlike(r"(?i)^https?://") & (host != "") & ~c.rlike(r"^[a-zA-Z]+://[^/?#]*@") & ~private & (host.rlike(r"\.") | host.rlike(r"^\["))


def subtitles(text: str | Column) -> Column:
    """Plain text of WebVTT or SubRip: without cues, times, notes and tags; repeated neighbouring lines once."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(F.regexp_replace(c, "\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE\b|STYLE\b|Kind:|Language:)|-->|^\d+$"))
    once = F.filter(F.transform(kept, lambda x, i: F.when((i > 0) & (x == F.get(kept, i - 1)), F.lit("")).otherwise(x)), lambda x: x != "")
    return F.array_join(once, " ")


def document_pointer(text: str | Column) -> Column:
    """Document id of a pointer file in JSON."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.get_json_object(c, "$.doc_id"), F.nullif(F.regexp_extract(F.get_json_object(c, "$.url"), r"/d/([A-Za-z0-9_-]+)", 1), F.lit("")))


def numstat(spark: SparkSession, path: str) -> DataFrame:
    """(added, deleted, path) of a change list; binary files count 0."""
    raw = spark.read.csv(path, sep="\t", schema="a string, d string, path string")
    return raw.select(F.try_to_number("a", F.lit("999999999")).cast("int").alias("added"), F.try_to_number("d", F.lit("999999999")).cast("int").alias("deleted"), "path").fillna(0, ["added", "deleted"])


def transactions(log: DataFrame) -> DataFrame:
    """(commit, idx, file) of a log (value lines: `commit <id>` followed by paths), oldest first."""
    from pyspark.sql import Window

    at = Window.orderBy("n")
    marked = log.withColumn("commit", F.last(F.when(F.col("value").startswith("commit "), F.substring("value", 8, 80)), ignorenulls=True).over(at))
    rows = marked.where("value <> '' and not startswith(value, 'commit ')").select("commit", F.col("value").alias("file"), "n")
    order = rows.groupBy("commit").agg(F.min("n").alias("n")).select("commit", (-F.col("n")).alias("idx"))
    return rows.select("commit", "file").distinct().join(order, "commit")


def mcp_config(text: str) -> list[tuple[str, str, str]]:
    """(server, kind, target) of a server configuration; values of environments and headers are left out."""
    import json

    doc = json.loads(text)
    out = []
    for name, s in sorted((doc.get("mcpServers") or doc.get("servers") or {}).items()):
        out.append((name, "runs" if "command" in s else "connects", str(s.get("command") or re.sub(r"[?#].*$", "", s.get("url", "")))))
        out += [(name, "env", k) for k in sorted(s.get("env", {}))]
    return out


def scip(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of an index: documents (path, symbols of (symbol, name, relations of (symbol, kind))).

    A relation goes to the symbol in the same document, else to the only one anywhere, else to an external stub.
    """
    s = documents.select("path", F.explode("symbols").alias("s")).select("path", F.col("s.symbol").alias("symbol"), F.col("s.name").alias("name"), F.col("s.relations").alias("relations"))
    node_id = F.concat_ws("#", "path", "symbol")
    nodes = s.select(node_id.alias("id"), F.col("name").alias("label"), F.col("path").alias("source_file")).distinct()
    r = s.select("path", node_id.alias("src"), F.explode("relations").alias("r")).select("path", "src", F.col("r.symbol").alias("symbol"), F.col("r.kind").alias("relation"))
    here = s.select("path", "symbol", node_id.alias("near")).distinct()
    lone = s.groupBy("symbol").agg(F.count_distinct("path").alias("n"), F.min(node_id).alias("far")).where("n = 1").drop("n")
    links = r.join(here, ["path", "symbol"], "left").join(lone, "symbol", "left")
    links = links.select("src", F.coalesce("near", "far", F.concat(F.lit("external#"), F.col("symbol"))).alias("dst"), "relation", "symbol")
    stubs = links.where("dst like 'external#%'").select(F.col("dst").alias("id"), F.col("symbol").alias("label"), F.lit("").alias("source_file")).distinct()
    return nodes.unionByName(stubs), links.drop("symbol").distinct()


def relational_schema(tables: DataFrame, keys: DataFrame, database: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a database: tables (schema, name, kind) and keys (table, column, ref_table, ref_column)."""
    root = tables.sparkSession.createDataFrame([(f"db:{database}", database, "module")], "id string, label string, kind string")
    t = tables.select(F.concat(F.lit("db:"), F.concat_ws(".", F.lit(database), "schema", "name")).alias("id"), F.col("name").alias("label"), F.col("kind"))
    holds = t.select(F.lit(f"db:{database}").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"), F.lit(None).cast("string").alias("context"))
    fk = keys.groupBy("table", "ref_table").agg(F.array_sort(F.collect_list(F.concat_ws(">", "column", "ref_column"))).alias("c"))
    full = lambda c: F.concat(F.lit(f"db:{database}."), F.col(c))
    refs = fk.select(full("table").alias("src"), full("ref_table").alias("dst"), F.lit("references").alias("relation"), F.array_join("c", ",").alias("context"))
    return root.unionByName(t), holds.unionByName(refs)


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisory rows of JSON documents, one a file; events are flattened to (type, bound) in order."""
    schema = (
        "id string, aliases array<string>, withdrawn string, severity array<struct<type:string,score:string>>, "
        "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    events = lambda es: F.flatten(F.transform(es, lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e.key.alias("type"), e.value.alias("bound")))))
    ranges = lambda rs: F.transform(rs, lambda r: F.struct(r.type.alias("kind"), events(r.events).alias("events")))
    affected = F.transform("affected", lambda a: F.struct(a.package.ecosystem.alias("ecosystem"), a.package.name.alias("name"), a.versions.alias("versions"), ranges(a.ranges).alias("ranges")))
    return raw.select("id", "aliases", F.col("withdrawn").isNotNull().alias("withdrawn"), F.transform("severity", lambda s: F.struct(s.type.alias("kind"), s.score.alias("score"))).alias("severity"), affected.alias("affected"))


def lock_packages(path: str, text: str) -> list[tuple[str, str, str]]:
    """(ecosystem, name, version) of a lock file by its name: cargo, npm, pip, go, poetry, composer, bundler."""
    import json
    import tomllib

    base = path.rsplit("/", 1)[-1]
    if base in ("Cargo.lock", "poetry.lock", "uv.lock"):
        eco = "crates.io" if base == "Cargo.lock" else "PyPI"
        return [(eco, p["name"], p["version"]) for p in tomllib.loads(text).get("package", []) if "version" in p]
    if base == "package-lock.json":
        doc = json.loads(text)
        return [("npm", k.rsplit("node_modules/", 1)[-1], v["version"]) for k, v in doc.get("packages", {}).items() if k and "version" in v]
    if base == "composer.lock":
        return [("Packagist", p["name"], p["version"].lstrip("v")) for p in json.loads(text).get("packages", [])]
    if base == "go.sum":
        return sorted({("Go", m[1], m[2]) for m in re.finditer(r"^(\S+) v([^\s/]+) ", text, re.M)})
    if base == "Gemfile.lock":
        return [("RubyGems", m[1], m[2]) for m in re.finditer(r"^    ([A-Za-z0-9_.-]+) \(([^)]+)\)$", text, re.M)]
    if re.fullmatch(r"requirements.*\.txt", base):
        return [("PyPI", m[1].lower(), m[2]) for m in re.finditer(r"^([A-Za-z0-9_.-]+)\s*==\s*([^\s;#]+)", text, re.M)]
    return []


def lock_table(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version) of lock files (path, content), parsed in batches."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, text in zip(frame.path, frame.content):
                try:
                    rows += [(path, *r) for r in lock_packages(path, text)]
                except ValueError:
                    continue  # not a lock file of its kind; it has no packages
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "version"])

    return files.select("path", "content").mapInPandas(run, "path string, ecosystem string, name string, version string")


# Detectors over source text: relation, pattern of the target, target node prefix.  Fixed values.
DETECTORS = (
    ("binds_native", r"\b(?:CDLL|LoadLibrary|DllImport|System\.loadLibrary)\s*\(\s*[\"']([^\"']+)[\"']", "native:"),
    ("invokes", r"\b(?:subprocess\.(?:run|call|Popen|check_output)|os\.system|exec(?:Sync)?|spawn(?:Sync)?)\s*\(\s*\[?\s*[\"']([\w./-]+)", "command:"),
    ("calls_service", r"\b(?:requests|axios|http|httpx|client)\.(?:get|post|put|delete|patch)\s*\(\s*[\"']([^\"'?]+)", "route:"),
    ("handled_by", r"@(?:app|router|api)\.(?:get|post|put|delete|patch|route)\s*\(\s*[\"']([^\"']+)", "route:"),
    ("queries", r"(?i)\bselect\b[^;\"']{1,400}?\bfrom\s+([a-z_][\w.]*)", "table:"),
    ("writes_to", r"(?i)\b(?:insert\s+into|update|delete\s+from)\s+([a-z_][\w.]*)", "table:"),
    ("reads_from", r"\{\{\s*ref\s*\(\s*[\"']([^\"']+)[\"']\s*\)\s*\}\}", "model:"),
    ("publishes", r"\.(?:emit|publish|produce|send)\s*\(\s*[\"']([\w.:/-]+)[\"']", "topic:"),
    ("subscribes", r"\.(?:on|subscribe|consume)\s*\(\s*[\"']([\w.:/-]+)[\"']", "topic:"),
    ("dynamic_ref", r"\b(?:getattr|importlib\.import_module|__import__|require|Class\.forName)\s*\(\s*(?:\w+\s*,\s*)?[\"']([^\"']+)[\"']", "name:"),
)


def mask_comments(text: str | Column) -> Column:
    """Line and block comments replaced by nothing but their line feeds; addresses with two slashes stay."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(c, r"(?m)(^|[^:\"'])//[^\n]*", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)(^|\s)#[^\n]*", "$1"), r"(?s)/\*.*?\*/", "")


def detect_links(files: DataFrame) -> DataFrame:
    """(src, dst, relation) of boundaries between languages and services in sources (path, content)."""
    masked = files.select("path", mask_comments("content").alias("t"))

    def found(relation: str, pattern: str, prefix: str) -> Column:
        return F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(relation).alias("relation"), F.concat(F.lit(prefix), m).alias("dst")))

    each = F.explode(F.flatten(F.array(*(found(*d) for d in DETECTORS))))
    return masked.select("path", each.alias("x")).select(F.concat(F.lit("file:"), "path").alias("src"), "x.dst", "x.relation").distinct()


def headings(files: DataFrame) -> DataFrame:
    """(path, line, level, title) of Markdown headings outside fenced code."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("content", r"(?s)```.*?```", ""), "\n")).alias("n", "text"))
    return lines.where(F.col("text").rlike(r"^#{1,6}\s+\S")).select("path", (F.col("n") + 1).alias("line"), F.length(F.regexp_extract("text", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("text", r"^#+\s+|\s+#*\s*$", "")).alias("title"))


# More detectors of boundaries: remote calls, sockets, queues, processes, events.  Fixed values.
SERVICES = (
    ("calls_service", r"\b(\w+)(?:Stub|ServiceClient|_pb2_grpc\.\w+Stub)\s*\(", "grpc:"),
    ("handled_by", r"\badd_(\w+)Servicer_to_server\s*\(|\bRegister(\w+)Server\s*\(", "grpc:"),
    ("calls_service", r"\bnew\s+WebSocket\s*\(\s*[\"'](wss?://[^\"']+)[\"']", "socket:"),
    ("handled_by", r"@(?:sock|socketio|ws)\.(?:on|route)\s*\(\s*[\"']([^\"']+)[\"']", "socket:"),
    ("calls_service", r"\bsend_task\s*\(\s*[\"']([^\"']+)[\"']|\bbasic_publish\s*\([^)]*routing_key\s*=\s*[\"']([^\"']+)[\"']", "queue:"),
    ("handled_by", r"@(?:app|celery)\.task\s*\(\s*name\s*=\s*[\"']([^\"']+)[\"']|\bbasic_consume\s*\([^)]*queue\s*=\s*[\"']([^\"']+)[\"']", "queue:"),
    ("calls_service", r"\bipcRenderer\.(?:invoke|send)\s*\(\s*[\"']([^\"']+)[\"']", "ipc:"),
    ("handled_by", r"\bipcMain\.(?:handle|on)\s*\(\s*[\"']([^\"']+)[\"']", "ipc:"),
    ("binds_native", r"\[DllImport\s*\(\s*\"([^\"]+)\"|#\[pymodule\]\s*(?:pub\s+)?fn\s+(\w+)|\bNODE_MODULE\s*\(\s*(\w+)", "native:"),
    ("calls_proc", r"(?i)\b(?:exec(?:ute)?|call)\s+([a-z_][\w.]*)\s*\(", "procedure:"),
)


def detect_services(files: DataFrame) -> DataFrame:
    """(src, dst, relation): a pattern may name its target in any of its groups."""
    masked = files.select("path", mask_comments("content").alias("t"))
    out = None
    for relation, pattern, prefix in SERVICES:
        groups = re.compile(pattern).groups
        names = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all("t", F.lit(pattern), F.lit(g + 1)) for g in range(groups)))))
        part = masked.select("path", F.explode(names).alias("m")).where("m <> ''").select(F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit(prefix), "m").alias("dst"), F.lit(relation).alias("relation"))
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def dynamic_sites(files: DataFrame) -> DataFrame:
    """(path, line, kind, key): reflection, dynamic imports and evaluation; key is null where no literal names the target."""
    pattern = r"\b(getattr|setattr|importlib\.import_module|__import__|require|import|eval|exec|Class\.forName|Activator\.CreateInstance)\s*\("
    lines = files.select("path", F.posexplode(F.split(mask_comments("content"), "\n")).alias("n", "text"))
    hit = lines.where(F.col("text").rlike(pattern))
    key = F.regexp_extract("text", r"\(\s*(?:\w+\s*,\s*)?[\"']([^\"']+)[\"']", 1)
    return hit.select("path", (F.col("n") + 1).alias("line"), F.regexp_extract("text", pattern, 1).alias("kind"), F.nullif(key, F.lit("")).alias("key"))


def cargo_workspace(text: str) -> list[tuple[str, str]]:
    """(package, dependency) of a manifest; workspace-inherited ones too."""
    import tomllib

    doc = tomllib.loads(text)
    name = doc.get("package", {}).get("name")
    if name is None:
        return []
    return [(name, v.get("package", k) if isinstance(v, dict) else k) for group in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in sorted(doc.get(group, {}).items())]
