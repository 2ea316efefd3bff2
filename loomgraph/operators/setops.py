"""Unions, federation, repo scopes, incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, unique
from .build import edge_key, rewire


def union(a: Graph, b: Graph) -> Graph:
    """b wins on equal ids; links of equal identity become one (a's come first)."""
    n = a.nodes.withColumn("side", F.lit(0)).unionByName(b.nodes.withColumn("side", F.lit(1)), allowMissingColumns=True)
    best = Window.partitionBy("id").orderBy(F.desc("side"), F.desc("seq"))
    nodes = n.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "side")
    e = a.edges.withColumn("side", F.lit(0)).unionByName(b.edges.withColumn("side", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy("src", "dst", "relation", "context").orderBy("side")
    edges = e.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "side")
    return Graph(nodes, edges)


def prefix(g: Graph, tag: str) -> Graph:
    """Ids as tag::id, the repo set, paths under the tag; the old id is kept as local_id."""
    p = F.lit(f"{tag}::")
    file = F.when(F.coalesce(F.col("source_file"), F.lit("")) != "", F.concat(F.lit(f"{tag}/"), "source_file")).otherwise(F.col("source_file"))
    nodes = g.nodes.withColumn("local_id", F.col("id")).withColumn("id", F.concat(p, "id")).withColumn("repo", F.lit(tag)).withColumn("source_file", file)
    edges = g.edges.withColumn("src", F.concat(p, "src")).withColumn("dst", F.concat(p, "dst"))
    return g.with_(nodes=nodes, edges=edges)


def collapse_externals(g: Graph) -> Graph:
    """Nodes without a file become one by label without case; loops that this makes are dropped, others stay."""
    outer = g.nodes.where("coalesce(source_file, '') = ''").select("id", F.lower("label").alias("name"), "seq")
    keep = outer.groupBy("name").agg(F.min_by("id", F.struct("seq", "id")).alias("to"))
    renames = outer.join(keep, "name").where("id <> to").select(F.col("id").alias("old"), F.col("to").alias("new"))
    nodes = g.nodes.join(renames.select(F.col("old").alias("id")), "id", "left_anti")
    edges = rewire(g.edges, renames, "old", "new", drop_loops=True)
    first = Window.partitionBy("src", "dst", "relation", "context").orderBy("confidence", "weight")
    return g.with_(nodes=nodes, edges=edges.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r"))


def compose(parts: dict[str, Graph], dedup: bool = True) -> Graph:
    """Federation of tagged graphs."""
    out = None
    for tag in sorted(parts):
        g = prefix(parts[tag], tag)
        out = g if out is None else Graph(out.nodes.unionByName(g.nodes, allowMissingColumns=True), out.edges.unionByName(g.edges, allowMissingColumns=True))
    return collapse_externals(out) if dedup else out


def mark_cross_repo(g: Graph) -> DataFrame:
    """Links with whether their ends lie in different repos."""
    r = g.nodes.select("id", "repo")
    e = g.edges.join(r.select(F.col("id").alias("src"), F.col("repo").alias("ra")), "src", "left").join(r.select(F.col("id").alias("dst"), F.col("repo").alias("rb")), "dst", "left")
    return e.withColumn("cross_repo", F.coalesce(F.col("ra") != F.col("rb"), F.lit(False))).drop("ra", "rb")


def list_repos(g: Graph) -> DataFrame:
    """(repo, nodes, edges): links count at their source."""
    nodes = g.nodes.groupBy("repo").agg(F.count("*").alias("nodes"))
    edges = g.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("repo").alias("r")), "src").groupBy("r").agg(F.count("*").alias("edges"))
    return nodes.join(edges, nodes.repo.eqNullSafe(edges.r), "left").select("repo", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def filter_repo(g: Graph, repo: str) -> Graph:
    """The induced subgraph; hyperedges stay if all their members do."""
    nodes = g.nodes.where(F.col("repo") == repo)
    ids = nodes.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*g.edges.columns)
    hyper = g.hyperedges
    if hyper is not None:
        member = hyper.select("id", F.explode("nodes").alias("node")).join(ids.select(F.col("id").alias("node")), "node", "left_anti").select("id")
        hyper = hyper.join(member, "id", "left_anti")
    return g.with_(nodes=nodes, edges=edges, hyperedges=hyper)


def split_shards(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(links inside a repo with it, links across): nodes without a repo belong to `local`."""
    r = g.nodes.select("id", F.coalesce("repo", F.lit("local")).alias("repo"))
    e = g.edges.join(r.select(F.col("id").alias("src"), F.col("repo").alias("ra")), "src").join(r.select(F.col("id").alias("dst"), F.col("repo").alias("rb")), "dst")
    inside = e.where("ra = rb").drop("rb").withColumnRenamed("ra", "shard")
    return inside, e.where("ra <> rb").drop("ra", "rb")


def shard_sizes(g: Graph) -> DataFrame:
    """(shard, relation, n): links of each repo, and of `(bridge)` those across, in one pass."""
    r = unique(g.nodes.select("id", F.coalesce("repo", F.lit("local")).alias("repo")))
    e = g.edges.select("src", "dst", "relation").join(r.select(F.col("id").alias("src"), F.col("repo").alias("ra")), "src").join(r.select(F.col("id").alias("dst"), F.col("repo").alias("rb")), "dst")
    return e.groupBy(F.when(F.col("ra") == F.col("rb"), F.col("ra")).otherwise("(bridge)").alias("shard"), "relation").agg(F.count("*").alias("n"))


def shard_digest(g: Graph) -> DataFrame:
    """(shard, digest): a digest of ids and link keys that does not depend on order, by repo."""
    inside, _ = split_shards(g)
    keys = g.nodes.select(F.coalesce("repo", F.lit("local")).alias("shard"), F.col("id").alias("key"))
    keys = keys.unionAll(inside.select("shard", F.concat("src", F.lit(">"), "dst", F.lit(":"), "relation")))
    sums = keys.groupBy("shard").agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)")).alias("b"), F.count("*").alias("n"))
    return sums.select("shard", F.sha2(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string")), 256).alias("digest"))


def export_surface(g: Graph) -> DataFrame:
    """Distinct (label, id) of located code nodes."""
    return g.nodes.where("file_type = 'code' and source_file <> ''").select("label", "id").distinct()


def dominant_namespace(labels: DataFrame) -> DataFrame:
    """The longest dotted prefix that at least half of the labels share."""
    parts = F.split("label", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    total = labels.count()
    counted = labels.where(F.contains("label", F.lit("."))).select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") * 2 >= total).orderBy(F.desc(F.length("prefix")), "prefix").limit(1)


def cross_repo_resolve(stubs: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(stub, target, confidence): the module of the longest coordinate prefix, exact 1.0; else the one owner of the symbol, 0.75.

    stubs: id, coordinate (dotted); modules: coordinate, id; symbols: label, id.  Prefixes are
    expanded, so the prefix join is an equi-join.
    """
    parts = F.split("coordinate", r"\.")
    pre = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("prefix")))
    each = stubs.select("id", "coordinate", F.size(parts).alias("size"), F.explode(pre).alias("p")).select("id", "coordinate", "size", "p.n", "p.prefix")
    hits = each.join(modules.select(F.col("coordinate").alias("prefix"), F.col("id").alias("module")), "prefix")
    best = hits.groupBy("id").agg(F.max(F.struct("n", "module", "size")).alias("b")).select("id", F.col("b.module").alias("target"), F.when(F.col("b.n") == F.col("b.size"), 1.0).otherwise(0.75).alias("confidence"))
    lone = symbols.groupBy("label").agg(F.count_distinct("id").alias("owners"), F.min("id").alias("owner")).where("owners = 1")
    rest = stubs.join(best, "id", "left_anti").withColumn("label", F.element_at(parts, -1)).join(lone, "label").select("id", F.col("owner").alias("target"), F.lit(0.75).alias("confidence"))
    return best.unionAll(rest)


def alias_resolve(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, resolved): an exact alias first, else the longest that ends with a slash and starts the path.  aliases: alias, target."""
    cut_ = F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))
    starts = F.array_append(F.filter(cut_, lambda p: F.endswith(p, F.lit("/"))), F.col("path"))
    each = paths.select("path", F.explode(F.array_distinct(starts)).alias("alias")).join(F.broadcast(aliases), "alias")
    best = each.groupBy("path").agg(F.max(F.struct(F.length("alias").alias("n"), "alias", "target")).alias("b"))
    return best.select("path", F.concat("b.target", F.substring("path", F.col("b.n") + 1, F.length("path"))).alias("resolved"))


def incremental_merge(old: Graph, new: Graph, changed_files: DataFrame, removed_files: DataFrame) -> Graph:
    """Nodes of changed or removed files give way to the new ones; links go with the node that they start from."""
    gone = changed_files.select("source_file").unionByName(removed_files.select("source_file")).distinct()
    kept = old.nodes.join(gone, "source_file", "left_anti").select(*old.nodes.columns).join(new.nodes.select("id"), "id", "left_anti").select(*old.nodes.columns)
    nodes = kept.unionByName(new.nodes, allowMissingColumns=True)
    evicted = old.nodes.join(gone, "source_file", "left_semi").select(F.col("id").alias("src"))
    edges = old.edges.join(evicted, "src", "left_anti").select(*old.edges.columns)
    both = edges.withColumn("side", F.lit(1)).unionByName(new.edges.withColumn("side", F.lit(0)), allowMissingColumns=True)
    first = Window.partitionBy("src", "dst", "relation", "context").orderBy("side")
    merged = both.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "side")
    ids = nodes.select("id")
    held = merged.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes, held.select(*merged.columns))


def same_topology(a: Graph, b: Graph) -> bool:
    """Equal sets of ids and of (src, dst, relation, context)."""
    for x, y in ((a.nodes.select("id"), b.nodes.select("id")), (a.edges.select(*edge_key()), b.edges.select(*edge_key()))):
        if x.subtract(y).limit(1).take(1) or y.subtract(x).limit(1).take(1):
            return False
    return True


def fingerprint(g: Graph) -> DataFrame:
    """Sorted distinct ids and link triples as one digest column set: (nodes, edges, digest)."""
    keys = g.nodes.select(F.col("id").alias("k")).distinct().withColumn("e", F.lit(0)).unionAll(g.edges.select(F.concat_ws("\0", "src", "dst", "relation").alias("k")).distinct().withColumn("e", F.lit(1)))
    s = keys.agg(F.count_if(F.col("e") == 0).alias("nodes"), F.count_if(F.col("e") == 1).alias("edges"), F.sum(F.xxhash64("k", "e").cast("decimal(38,0)")).alias("s"))
    return s.select("nodes", "edges", F.sha2(F.col("s").cast("string"), 256).alias("digest"))


def overlap_communities(old: DataFrame, new: DataFrame) -> list[tuple[int, int]]:
    """(new, kept id): communities take the id of the old one that they overlap most, greedily; others get fresh ids.

    The overlap table has a row a pair of communities that share nodes; only it comes to the driver.
    """
    pairs = new.select("id", F.col("community").alias("n")).join(old.select("id", F.col("community").alias("o")), "id").groupBy("n", "o").agg(F.count("*").alias("c"))
    given: dict[int, int] = {}
    used: set[int] = set()
    for r in sorted(pairs.collect(), key=lambda r: (-r.c, r.o, r.n)):
        if r.n not in given and r.o not in used:
            given[r.n] = r.o
            used.add(r.o)
    fresh = iter(i for i in range(1 << 30) if i not in used)
    for r in sorted(new.select(F.col("community").alias("n")).distinct().collect(), key=lambda r: r.n):
        if r.n not in given:
            given[r.n] = next(fresh)
    return sorted(given.items())

