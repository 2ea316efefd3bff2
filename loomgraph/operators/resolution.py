"""Resolution of facts that parsers leave open: calls, commands, routes, stubs, dynamic names, resources, imports.

Each pass is an equi-join that keeps a call only if exactly one candidate is
left; later passes see only what earlier ones did not settle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut
from .build import rewire
from .primitives import bare_name, language

# Languages that may call each other by name.
FAMILIES = {"javascript": "js", "typescript": "js", "c": "native", "cpp": "native", "kotlin": "jvm", "java": "jvm", "scala": "jvm", "groovy": "jvm"}
CALLABLE = ("function", "method", "constructor", "macro", "procedure")


def family(path: str | Column = "source_file") -> Column:
    lang = language(path)
    out = F.when(F.lit(False), "")
    for k, v in FAMILIES.items():
        out = out.when(lang == k, v)
    return out.otherwise(lang)


def definitions(g: Graph) -> DataFrame:
    """(id, name, file, family, kind, parent): located symbols by bare name, with the type that owns them."""
    held = g.edges.where("relation in ('method', 'contains')").join(g.nodes.where("source_file <> ''").select(F.col("id").alias("dst")), "dst", "left_semi")
    owner = held.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    n = g.nodes.where("source_file <> ''").select("id", bare_name().alias("name"), F.col("source_file").alias("file"), family().alias("family"), "kind")
    return n.join(owner, "id", "left")


def _lone(candidates: DataFrame, step: str, confidence: str, score: float) -> DataFrame:
    """Calls with one candidate; of several, callables are preferred to other kinds.  candidates: call, and first and last of ``_ends``."""
    one = candidates.groupBy("call").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first.id = last.id").withColumn("target", F.col("first.id"))
    return one.select("call", "target", F.lit(step).alias("step"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"))


def _ends(symbols: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the least and the greatest id of the preferred kind, which tell whether it is the only one; calls never meet all symbols of a name."""
    rank = F.when(F.col("kind").isin(*CALLABLE), 0).otherwise(1)
    return symbols.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "id")).alias("first"), F.max(F.struct((-rank).alias("rank"), "id")).alias("last"))


def resolve_calls(g: Graph, calls: DataFrame, imports: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(call, target, step, confidence, score).

    calls: call (id), src, name, file, receiver (type name or null); imports: file, target_file, name (null: the whole
    module), sourced (shell source); types: id, name of type nodes.  Steps: sourced files, members of the receiver's
    type, namespace imports, named imports, the only symbol of that name in the family of languages.
    """
    d = cut(definitions(g), "definitions")
    c = cut(calls.withColumn("family", family("file")), "calls")
    by_file = imports.select("file", F.col("target_file"), F.col("name").alias("imported"), F.coalesce("sourced", F.lit(False)).alias("sourced"))
    own = _ends(d.select("id", "name", F.col("file").alias("target_file"), "kind"), "target_file", "name")
    via = lambda rows, cond: rows.join(by_file.where(cond), "file").join(own, ["target_file", "name"])
    type_nodes = g.nodes.where("kind in ('class', 'interface', 'trait', 'struct', 'enum', 'record', 'type')").select(F.col("id").alias("parent"), F.col("label").alias("receiver")) if types is None else types.select(F.col("id").alias("parent"), F.col("name").alias("receiver"))
    passes = [
        ("sourced", lambda rows: via(rows, F.col("sourced")), "EXTRACTED", 1.0),
        ("member", lambda rows: rows.where("receiver is not null").join(type_nodes, "receiver").join(_ends(d, "parent", "name"), ["parent", "name"]), "EXTRACTED", 1.0),
        ("namespace", lambda rows: via(rows, ~F.col("sourced") & F.col("imported").isNull()), "EXTRACTED", 1.0),
        ("import", lambda rows: via(rows, ~F.col("sourced") & F.col("imported").isNotNull()).where("imported = name"), "EXTRACTED", 1.0),
        ("unique", lambda rows: rows.where("receiver is null").join(_ends(d, "name", "family"), ["name", "family"]), "INFERRED", 0.8),
    ]
    found: list[DataFrame] = []
    left = c
    for step, find, confidence, score in passes:
        hit = cut(_lone(find(left), step, confidence, score), "resolved")
        found.append(hit)
        left = left.join(hit.select("call"), "call", "left_anti")
    return reduce(DataFrame.unionAll, found)


def commands(g: Graph) -> DataFrame:
    """(old, new): stubs that `invokes` links point to, and the one file with that base name or stem."""
    stubs = g.edges.where("relation = 'invokes'").select(F.col("dst").alias("id")).distinct().join(g.nodes.where("coalesce(source_file, '') = ''").select("id", F.element_at(F.split("label", "/"), -1).alias("base")), "id")
    base = F.element_at(F.split("source_file", "/"), -1)
    f = g.nodes.where("source_file <> '' and kind = 'module'").select(F.col("id").alias("file"), base.alias("a"), F.regexp_replace(base, r"\.[^.]*$", "").alias("b"))
    names = f.select("file", F.explode(F.array_distinct(F.array("a", "b"))).alias("base"))
    lone = names.groupBy("base").agg(F.count_distinct("file").alias("n"), F.min("file").alias("new")).where("n = 1")
    return stubs.join(lone, "base").select(F.col("id").alias("old"), "new")


def match_routes(concrete: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, template): concrete paths (id, path) that exactly one template (id, path) fits.

    Joined on the number of segments (a catch-all: on each of its possible numbers) and the first fixed segment where
    there is one; {x}, :x and <x> stand for any segment, a last * for any rest.
    """
    seg = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    free = lambda s: s.rlike(r"^(\{.*\}|:.+|<.*>|\*)$")
    a = concrete.select("id", seg("path").alias("p")).withColumn("n", F.size("p"))
    t = templates.select(F.col("id").alias("template"), seg("path").alias("q")).withColumn("rest", F.coalesce(F.get("q", F.size("q") - 1).rlike(r"^(\*.*|\{\*.*\}|\{.*:\s*path\})$"), F.lit(False)))
    exact = a.join(t.where("not rest").withColumn("n", F.size("q")), "n").where(F.forall(F.zip_with("p", "q", lambda x, y: (x == y) | free(y)), lambda ok: ok))
    head = lambda: F.slice("q", F.lit(1), F.greatest(F.size("q") - 1, F.lit(0)))
    opens = t.where("rest").withColumn("first", F.when(F.size("q") > 1, F.get("q", F.lit(0))))
    starts = a.withColumn("first", F.get("p", F.lit(0))).join(opens.where("first is not null"), "first").where(F.size("p") >= F.size("q") - 1)
    starts = starts.where(F.forall(F.zip_with(F.slice("p", F.lit(1), F.size("q") - 1), head(), lambda x, y: (x == y) | free(y)), lambda ok: ok))
    both = exact.select("id", "template").unionAll(starts.select("id", "template")).distinct()
    return both.groupBy("id").agg(F.count("*").alias("n"), F.min("template").alias("template")).where("n = 1").drop("n")


def route_handlers(g: Graph, routes: DataFrame) -> DataFrame:
    """(route, handler): routes (id, handler name) to the one function of that name."""
    lone = definitions(g).where(F.col("kind").isin(*CALLABLE)).groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("handler")).where("n = 1")
    return routes.join(lone, routes["handler_name"] == lone["name"]).select(F.col("id").alias("route"), "handler")


def collapse_table_stubs(g: Graph) -> Graph:
    """Table stubs without a file give way to the located table of that name, if there is one."""
    t = g.nodes.where("kind = 'table'").select("id", F.lower("label").alias("name"), (F.coalesce("source_file", F.lit("")) != "").alias("located"))
    kept = t.where("located").groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("new")).where("n = 1")
    renames = t.where("not located").join(kept, "name").select(F.col("id").alias("old"), "new")
    nodes = g.nodes.join(renames.select(F.col("old").alias("id")), "id", "left_anti")
    return g.with_(nodes=nodes, edges=rewire(g.edges, renames, "old", "new", drop_loops=True))


def native_exports(g: Graph, exports: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst, relation): importers of a native module (src, module, name) to the boundary that registers the name (module, name, id)."""
    hit = uses.join(exports.groupBy("module", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1").drop("n"), ["module", "name"])
    return hit.select("src", "dst", F.lit("binds_native").alias("relation"))


def dynamic_links(g: Graph, sites: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): keyed dynamic sites (src, key) to the one definition of that name."""
    lone = definitions(g).groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1")
    hit = sites.where("key is not null").join(lone, sites["key"] == lone["name"]).where("src <> dst")
    return hit.select("src", "dst", F.lit("dynamic_ref").alias("relation"), F.lit("INFERRED").alias("confidence")).distinct()


def resource_links(g: Graph, stubs: DataFrame) -> DataFrame:
    """(stub, target): a resource stub (id, path, logical) to the existing path, else the one logical id, else the one symbol."""
    by_path = g.nodes.where("source_file <> ''").groupBy(F.col("source_file").alias("path")).agg(F.min("id").alias("a"))
    logical = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    by_logical = g.nodes.where("source_file <> ''").groupBy(logical.alias("logical")).agg(F.count_distinct("source_file").alias("nl"), F.min("id").alias("b"))
    by_name = definitions(g).groupBy(F.col("name").alias("logical")).agg(F.count_distinct("id").alias("nn"), F.min("id").alias("c"))
    j = stubs.join(by_path, "path", "left").join(by_logical.where("nl = 1"), "logical", "left").join(by_name.where("nn = 1"), "logical", "left")
    return j.select(F.col("id").alias("stub"), F.coalesce("a", "b", "c").alias("target")).where("target is not null")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(file, spec, target): relative and aliased imports to an existing file, tried with the usual endings.

    imports: file, spec; files: path; aliases: alias (prefix ending at a slash), target.
    """
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    joined = F.when(F.col("spec").startswith("."), F.concat_ws("/", folder, "spec")).otherwise(F.col("spec"))
    rows = imports.select("file", "spec", joined.alias("path"))
    if aliases is not None:
        from .setops import alias_resolve

        rows = rows.join(alias_resolve(rows.select("path").distinct(), aliases), "path", "left").select("file", "spec", F.coalesce("resolved", "path").alias("path"))
    # "." and ".." are folded from the left.
    parts = F.split("path", "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == ".") | (p == ""), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, p)))
    rows = rows.withColumn("base", F.array_join(folded, "/"))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", "/index.ts", "/index.js", "/__init__.py", "/mod.rs"]
    tries = F.array(*(F.struct(F.lit(i).alias("i"), F.concat("base", F.lit(e)).alias("target")) for i, e in enumerate(ends)))
    each = rows.select("file", "spec", F.explode(tries).alias("t")).select("file", "spec", "t.i", "t.target")
    hit = each.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("file", "spec").agg(F.min_by("target", "i").alias("target"))
