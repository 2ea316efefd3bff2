"""Entity dedup: exact names in a file, an entropy gate, MinHash bands, name similarity, connected groups.

Hashes are ours to choose (xxhash64 of character triples under affine maps), so
signatures differ from other implementations; the candidates they find do not
depend on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import damerau_udf, entropy, jaro_winkler_udf, normal_label
from ..graph import Graph
from .analytics import components
from .build import rewire

PERMUTATIONS, THRESHOLD = 128, 0.7
# Thresholds of the rules, fixed values.
ENTROPY, SIMILAR, BONUS, SHORT, TYPO = 2.5, 92.0, 5.0, 12, 97.0
# Endings that tell variants of one stem apart, a fixed pattern.
VARIANT = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"


def bands(permutations: int = PERMUTATIONS, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bands and rows with the least sum of false positives below and false negatives above the threshold."""
    best = None
    steps = [i / 200 for i in range(201)]
    for b in range(1, permutations + 1):
        r = permutations // b
        hit = [1 - (1 - s**r) ** b for s in steps]
        cost = sum(h for s, h in zip(steps, hit) if s < threshold) + sum(1 - h for s, h in zip(steps, hit) if s >= threshold)
        if best is None or cost < best[0]:
            best = (cost, b, r)
    return best[1], best[2]


def minhash(text: Column, permutations: int = PERMUTATIONS) -> Column:
    """Signature over the character triples of a string without its spaces."""
    solid = F.regexp_replace(text, r"\s+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(solid) - 2, F.lit(1))), lambda i: F.xxhash64(F.substring(solid, i, F.lit(3))))
    base = F.array_distinct(grams)
    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda p: F.array_min(F.transform(base, lambda h: F.xxhash64(h, p))))


def variant_pair(a: Column, b: Column) -> Column:
    """Short names with one stem and different endings (v1 and v2) are different things."""
    part = lambda c, i: F.regexp_extract(c, VARIANT, i)
    return (F.greatest(F.length(a), F.length(b)) < SHORT) & (part(a, 1) != "") & (part(a, 1) == part(b, 1)) & (part(a, 2) != part(b, 2))


def entities(nodes: DataFrame) -> DataFrame:
    """(id, name, file, community) of the nodes that may merge by name: not code, which its parser owns, nor resources, which their path names.

    Nothing if the nodes span several repositories: equal names there are different things, so each is deduplicated by itself.
    """
    kept = lambda name, other, read=F.col: F.coalesce(read(name), F.lit("")) != other if name in nodes.columns else F.lit(True)
    n = nodes.where(kept("file_type", "code") & kept("origin", "ast") & kept("extra", "resource", lambda c: F.get_json_object(c, "$._node_type")))
    if "repo" in nodes.columns and len(nodes.where("repo is not null").select("repo").distinct().take(2)) > 1:
        n = n.limit(0)
    community = F.col("community") if "community" in nodes.columns else F.lit(None).cast("int")
    out = n.select("id", normal_label("label").alias("name"), F.coalesce("source_file", F.lit("")).alias("file"), community.alias("community"))
    return out.where("name <> ''")


def pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes that are taken for one entity."""
    n = entities(nodes)
    # Equal names in one file meet at the smallest id: a link a node, not a pair of nodes.
    first = n.where("file <> ''").groupBy("name", "file").agg(F.min("id").alias("b"))
    same = n.join(first, ["name", "file"]).where("id <> b").select(F.col("id").alias("a"), "b")
    # One node stands for its name; a name's community is that of the node.
    heads = n.groupBy("name").agg(F.min(F.struct("id", "community")).alias("h")).select("name", "h.id", "h.community").where(entropy("name") >= ENTROPY)
    b, r = bands()
    signed = heads.withColumn("sig", minhash(F.col("name")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * r + 1, F.lit(r))))
    dealt = signed.select("id", "name", "community", F.explode(keys).alias("band"))
    left, right = dealt, dealt.select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("community").alias("community2"), "band")
    met = left.join(right, "band").where("name < name2").select("id", "name", "community", "id2", "name2", "community2").distinct()
    low, high = F.least(F.length("name"), F.length("name2")), F.greatest(F.length("name"), F.length("name2"))
    # A name that goes on where another ends is another thing; below this ratio of lengths no score suffices.
    met = met.where(~F.startswith("name2", "name") & (low >= 0.35 * high)).where(~variant_pair(F.col("name"), F.col("name2")))
    close = F.when((F.col("community") == F.col("community2")) & (low >= SHORT), BONUS).otherwise(0.0)
    scored = met.withColumn("alike", jaro_winkler_udf("name", "name2")).where(F.col("alike") + close >= SIMILAR)
    typo = (F.col("alike") >= TYPO) & (low == high) & (damerau_udf("name", "name2") <= 1)
    return same.unionAll(scored.where((high >= SHORT) | typo).select(F.col("id").alias("a"), F.col("id2").alias("b")))


def merge_map(nodes: DataFrame) -> DataFrame:
    """(old, new): each duplicate and the winner of its group: without a number suffix, then the shortest id, then the smallest."""
    comp = components(pairs(nodes))
    order = F.struct(F.col("id").rlike(r"_c\d+$").alias("numbered"), F.length("id").alias("n"), "id")
    best = comp.groupBy("component").agg(F.min(order).alias("o"))
    return comp.join(best, "component").select(F.col("id").alias("old"), F.col("o.id").alias("new")).where("old <> new")


def apply_merges(g: Graph, merges: DataFrame) -> Graph:
    nodes = g.nodes.join(merges.select(F.col("old").alias("id")), "id", "left_anti").select(*g.nodes.columns)
    edges = rewire(g.edges, merges, "old", "new", drop_loops=True)
    first = Window.partitionBy("src", "dst", "relation", "context").orderBy("confidence")
    return g.with_(nodes=nodes, edges=edges.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r"))


def token_twins(nodes: DataFrame) -> DataFrame:
    """(id, head): nodes whose labels have the same multiset of words; the head is the smallest id."""
    key = F.array_join(F.array_sort(F.split(normal_label("label"), " ")), " ")
    n = nodes.select("id", key.alias("key")).where("key <> ''")
    return n.withColumn("head", F.min("id").over(Window.partitionBy("key"))).where("id <> head").select("id", "head")
