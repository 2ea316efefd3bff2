"""Interface contracts: operations with field maps, diffs, relevance to callers, coverage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import cut

OPERATIONS = (
    "vendor string, key string, protocol string, method string, canonical_path string, webhook boolean, security_digest string, "
    "request_fields map<string,struct<type:string,required:boolean,enum_values:array<string>>>, response_fields map<string,struct<type:string,required:boolean,enum_values:array<string>>>"
)


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\{[^}]*\}|:[A-Za-z_]\w*", "{}"), r"/+$", "")


def openapi(text: str, vendor: str) -> list[tuple]:
    """Rows of operations of an OpenAPI document in JSON."""
    doc = json.loads(text)
    out = []

    def fields(schema: dict | None) -> dict:
        schema = schema or {}
        if "$ref" in schema:
            at = doc
            for part in schema["$ref"].lstrip("#/").split("/"):
                at = at.get(part, {})
            schema = at
        need = set(schema.get("required", ()))
        return {k: (str(v.get("type", "object")), k in need, [str(e) for e in v.get("enum", [])]) for k, v in schema.get("properties", {}).items()}

    for group, hook in (("paths", False), ("webhooks", True)):
        for path, item in doc.get(group, {}).items():
            for method, op in item.items():
                if method not in ("get", "put", "post", "delete", "patch", "head", "options"):
                    continue
                body = next(iter(op.get("requestBody", {}).get("content", {}).values()), {}).get("schema")
                good = next((r for code, r in sorted(op.get("responses", {}).items()) if code.startswith("2")), {})
                answer = next(iter(good.get("content", {}).values()), {}).get("schema")
                request = fields(body) | {p["name"]: (str(p.get("schema", {}).get("type", "string")), bool(p.get("required")), [str(e) for e in p.get("schema", {}).get("enum", [])]) for p in op.get("parameters", ())}
                import re

                out.append((vendor, op.get("operationId") or f"{method} {path}", "http", method.upper(), re.sub(r"\{[^}]*\}", "{}", path.rstrip("/")), hook, json.dumps(op.get("security", doc.get("security")), sort_keys=True), request, fields(answer)))
    return out


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change, field, detail): removed, added, renamed and moved operations, changed security, and changes of fields.

    Operations match by key, else by (protocol, method, path) where that is unique on both sides.
    """
    a, b = old.select(*(F.col(c).alias(f"a_{c}") for c in old.columns)), new.select(*(F.col(c).alias(f"b_{c}") for c in new.columns))
    same = a.join(b, F.col("a_key") == F.col("b_key"))
    rest_a = a.join(new.select(F.col("key").alias("a_key")), "a_key", "left_anti").select(*a.columns)
    rest_b = b.join(old.select(F.col("key").alias("b_key")), "b_key", "left_anti").select(*b.columns)
    lone = lambda df, p: df.withColumn("n", F.count("*").over(Window.partitionBy(f"{p}_protocol", f"{p}_method", f"{p}_canonical_path"))).where("n = 1").drop("n")
    moved = lone(rest_a, "a").join(lone(rest_b, "b"), (F.col("a_protocol") == F.col("b_protocol")) & (F.col("a_method") == F.col("b_method")) & (F.col("a_canonical_path") == F.col("b_canonical_path")))
    none = F.lit(None).cast("string")
    removed = rest_a.join(moved.select("a_key"), "a_key", "left_anti").select(F.col("a_key").alias("key"), F.lit("removed").alias("change"), none.alias("field"), none.alias("detail"))
    added = rest_b.join(moved.select("b_key"), "b_key", "left_anti").select(F.col("b_key").alias("key"), F.lit("added").alias("change"), none.alias("field"), none.alias("detail"))
    renamed = moved.select(F.col("a_key").alias("key"), F.lit("renamed").alias("change"), none.alias("field"), F.col("b_key").alias("detail"))
    both = same.unionByName(moved)
    shifted = same.where("a_canonical_path <> b_canonical_path or a_method <> b_method").select(F.col("a_key").alias("key"), F.lit("moved").alias("change"), none.alias("field"), F.concat_ws(" ", "b_method", "b_canonical_path").alias("detail"))
    auth = both.where("not (a_security_digest <=> b_security_digest)").select(F.col("a_key").alias("key"), F.lit("security").alias("change"), none.alias("field"), none.alias("detail"))
    out = removed.unionAll(added).unionAll(renamed).unionAll(shifted).unionAll(auth)
    for side in ("request", "response"):
        out = out.unionAll(field_changes(both, side))
    return out


def field_changes(both: DataFrame, side: str) -> DataFrame:
    """Breaking changes of the fields of matched operations."""
    a, b = F.col(f"a_{side}_fields"), F.col(f"b_{side}_fields")
    names = F.array_union(F.coalesce(F.map_keys(a), F.array().cast("array<string>")), F.coalesce(F.map_keys(b), F.array().cast("array<string>")))
    each = both.select(F.col("a_key").alias("key"), a.alias("a"), b.alias("b"), F.explode(names).alias("field"))
    each = each.select("key", "field", F.try_element_at("a", F.col("field")).alias("x"), F.try_element_at("b", F.col("field")).alias("y"))
    gone = F.col("y").isNull()
    retyped = F.col("x.type") != F.col("y.type")
    lost = F.size(F.array_except(F.coalesce("x.enum_values", F.array().cast("array<string>")), F.coalesce("y.enum_values", F.array().cast("array<string>")))) > 0
    change = F.when(gone, f"{side}_removed").when(F.col("x").isNotNull() & retyped, f"{side}_retyped")
    if side == "request":
        change = F.when(F.col("y.required") & ~F.coalesce(F.col("x.required"), F.lit(False)), "request_required").otherwise(change)
        change = F.coalesce(change, F.when(F.col("x").isNotNull() & lost & (F.size("y.enum_values") > 0), "request_enum"))
    else:
        differ = F.array_sort(F.coalesce("x.enum_values", F.array().cast("array<string>"))) != F.array_sort(F.coalesce("y.enum_values", F.array().cast("array<string>")))
        change = F.coalesce(change, F.when(F.col("x").isNotNull() & differ, "response_enum"))
    return each.select("key", change.alias("change"), "field", F.concat_ws(" -> ", "x.type", "y.type").alias("detail")).where("change is not null")


def bind_http(calls: DataFrame, hosts: DataFrame, operations: DataFrame) -> DataFrame:
    """(src, vendor, key, source_file, source_location): calls by host to one vendor and by method and path to an operation; ambiguous hosts are skipped.

    calls: src, host, method, path, source_file, source_location; hosts: host, vendor.
    """
    # As a table its size is known: few hosts meet the calls by broadcast, never all calls of a host in one task.
    lone = hosts.groupBy("host").agg(F.count_distinct("vendor").alias("n"), F.min("vendor").alias("vendor")).where("n = 1").drop("n")
    lone = cut(lone, "hosts")
    j = calls.join(lone, "host").withColumn("canonical_path", canonical_path(F.col("path")))
    ops = operations.select("vendor", "method", "canonical_path", "key")
    return j.join(ops, ["vendor", "method", "canonical_path"]).select("src", "vendor", "key", "source_file", "source_location").distinct()


def relevance(changes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Changes with callers and verdict: affected if a binding names the operation, else no_usage."""
    used = bindings.groupBy("key").agg(F.count("*").alias("callers"))
    j = changes.join(used, "key", "left").fillna(0, ["callers"])
    return j.withColumn("verdict", F.when(F.col("callers") > 0, "affected").otherwise("no_usage"))


def coverage(observed: DataFrame, operations: DataFrame, bindings: DataFrame) -> DataFrame:
    """(state, n): observed calls that are identified (vendor known), modelled (operation known) and bound (caller known)."""
    j = observed.join(operations.select("key", F.lit(True).alias("m")).distinct(), "key", "left").join(bindings.select("key", F.lit(True).alias("b")).distinct(), "key", "left")
    state = F.when(F.col("b"), "bound").when(F.col("m"), "modelled").when(F.col("vendor").isNotNull(), "identified").otherwise("observed")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def redact(text: Column) -> Column:
    """Secrets in text lines masked: keys of common forms and values after secret names."""
    out = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*[\"']?)[^\s\"']{6,}", "$1***")
    return F.regexp_replace(out, r"\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[A-Fa-f0-9]{40})\b", "***")
