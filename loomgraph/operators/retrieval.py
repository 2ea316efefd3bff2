"""Ranked text retrieval: token index, IDF relevance, seeds, best-first expansion."""

from __future__ import annotations

import heapq
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_tokens, symbol_shaped, tokens, variants
from ..graph import Graph, cut
from .primitives import is_test_path

# Weights of the channels, of inflected forms and of aliases of intents.
CHANNELS = {"label": 1.0, "path": 0.35, "alias": 0.55}
INFLECTED, ALIASED = 0.65, 0.45
INTENTS = {"choose": "resolve", "decide": "resolve", "determine": "resolve"}
DECAY = 0.5
SEEDS = 8
PRIORS = {"document": 0.75, "rationale": 0.75, "concept": 0.7, "paper": 0.7, "image": 0.8}


def index(g: Graph) -> DataFrame:
    """(token, id, channel, n_tokens): distinct tokens of labels and paths."""
    each = None
    for channel, column in (("label", "label"), ("path", "source_file")):
        t = F.array_distinct(tokens(F.coalesce(F.col(column), F.lit(""))))
        part = g.nodes.select("id", F.lit(channel).alias("channel"), t.alias("t")).select("id", "channel", F.size("t").alias("n_tokens"), F.explode("t").alias("token"))
        each = part if each is None else each.unionByName(part)
    return each


def document_frequency(idx: DataFrame) -> DataFrame:
    return idx.groupBy("token").agg(F.countDistinct("id").alias("df"))


def idf(df: Column, n: int) -> Column:
    return F.log((F.lit(n) + 1) / (df + 1)) + 1


def prior() -> Column:
    """Stubs and tests and text count less than code."""
    out = F.when(F.coalesce(F.col("source_file"), F.lit("")) == "", 0.6).when(is_test_path(), 0.85)
    for kind, value in PRIORS.items():
        out = out.when(F.col("file_type") == kind, value)
    return out.otherwise(1.0)


def repeated_label_prior() -> Column:
    n = F.count("*").over(Window.partitionBy(F.lower("label")))
    return F.when(n <= 2, 1.0).otherwise(F.greatest(F.lit(0.35), F.sqrt(F.lit(2.0) / n)))


def hub_penalty(degree: Column, mean: float) -> Column:
    return 1 / (1 + F.log(1 + degree / max(mean, 1.0)))


def forms(query: str) -> dict[str, tuple[str, float]]:
    """token -> (concept, weight): the words of a query, their other forms and aliases."""
    words = query_tokens(query)
    wanted: dict[str, tuple[str, float]] = {}
    for w in words:
        wanted[w] = (w, 1.0)
    for w in words:
        for v in variants(w):
            wanted.setdefault(v, (w, INFLECTED))
        if not symbol_shaped(query) and " " in query and w in INTENTS:
            wanted.setdefault(INTENTS[w], (w, ALIASED))
    return wanted


def relevance(g: Graph, query: str, idx: DataFrame | None = None) -> DataFrame:
    """(id, score, concepts): sum of idf and weight by channel over the root of the channel's tokens, scaled by coverage and prior."""
    wanted, n = forms(query), g.nodes.count()
    # One pass over the index keeps the entries of the query's words; counts and scores come from those.
    found = (index(g) if idx is None else idx).where(F.col("token").isin(list(wanted)))
    found = cut(found, "entries")
    known = {r.token: r.df for r in document_frequency(found).collect()}
    if not known:
        return g.spark.createDataFrame([], "id string, score double, concepts array<string>")
    rows = [(t, *wanted[t], df) for t, df in known.items()]
    terms = g.spark.createDataFrame(rows, "token string, concept string, weight double, df long").withColumn("idf", idf(F.col("df"), n))
    discriminating = max(1, len({c for _, c, _, df in rows if df <= n / 2}))
    share = F.create_map(*(F.lit(x) for kv in CHANNELS.items() for x in kv))
    # As many terms as the query has words and forms.
    hits = found.join(F.broadcast(terms), "token")
    # Of several forms of a concept the best one counts in a channel.
    best = hits.groupBy("id", "channel", "concept").agg(F.max(F.col("idf") * F.col("weight")).alias("v"), F.first("n_tokens").alias("n_tokens"))
    per = best.groupBy("id").agg(F.sum(F.col("v") * F.try_element_at(share, F.col("channel")) / F.sqrt("n_tokens")).alias("raw"), F.array_sort(F.collect_set("concept")).alias("concepts"))
    coverage = F.least(F.size("concepts") / F.lit(discriminating), F.lit(1.0))
    scaled = F.col("raw") * (0.25 + 0.75 * coverage) if discriminating > 1 else F.col("raw")
    return per.join(g.nodes.select("id", prior().alias("prior")), "id").select("id", (scaled * F.col("prior")).alias("score"), "concepts")


def seeds(scored: DataFrame, k: int = SEEDS) -> DataFrame:
    """Best k by score, then id; at most two of one concept alone and three of one set of concepts."""
    sig = F.array_join("concepts", "|")
    order = Window.partitionBy(sig).orderBy(F.desc("score"), "id")
    allowed = F.when(F.size("concepts") == 1, 2).otherwise(3)
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= allowed).orderBy(F.desc("score"), "id").limit(k).drop("nth")


def search(g: Graph, query: str, most: int = 50, idx: DataFrame | None = None, recent: dict[str, float] | None = None, boost: float = 0.0) -> list[tuple[str, float]]:
    """Ranked (id, score) around the seeds: a best-first walk by relevance, halved a hop and weighed down at hubs.

    The walk looks only at neighbours of settled nodes, a bounded number, which are fetched frontier by frontier.
    """
    scored = relevance(g, query, idx).cache()
    start = seeds(scored).collect()
    recent = recent or {}
    if not start:
        scored.unpersist()
        return []
    e = g.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.repartition("a").distinct().sortWithinPartitions("a"), "both")
    deg = cut(both.groupBy("a").agg(F.count("*").alias("degree")), "degrees")
    mean = deg.agg(F.avg("degree")).first()[0] or 1.0
    heap = [(0, -(r.score + boost * recent.get(r.id, 0.0)), r.id, 0) for r in start]
    heapq.heapify(heap)
    settled: dict[str, float] = {}
    fetched: dict[str, list[tuple[str, float, int]]] = {}
    while heap and len(settled) < most:
        _, key, node, hop = heapq.heappop(heap)
        if node in settled:
            continue
        settled[node] = -key
        if node not in fetched:
            ask = [node, *(h[2] for h in heapq.nsmallest(16, heap) if h[2] not in fetched)]
            near = both.where(F.col("a").isin(ask)).join(scored.select(F.col("id").alias("b"), "score"), "b", "left").join(deg.select(F.col("a").alias("b"), "degree"), "b", "left")
            top = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("score"), "b"))).where(F.col("r") <= most)
            for a in ask:
                fetched[a] = []
            for r in top.collect():
                fetched[r.a].append((r.b, r.score or 0.0, r.degree or 0))
        for b, score, d in fetched[node]:
            if b not in settled:
                value = max(score, settled[node] * 0.25) * DECAY ** (hop + 1) + boost * recent.get(b, 0.0)
                heapq.heappush(heap, (1, -value / (1 + log(1 + d / max(mean, 1.0))), b, hop + 1))
    scored.unpersist()
    return sorted(settled.items(), key=lambda x: (-x[1], x[0]))


def result_links(g: Graph, ranked: DataFrame) -> DataFrame:
    """Links inside a result (id, score), by the smaller score of their ends."""
    a, b = ranked.select(F.col("id").alias("src"), F.col("score").alias("sa")), ranked.select(F.col("id").alias("dst"), F.col("score").alias("sb"))
    e = g.edges.select("src", "dst", "relation").join(F.broadcast(a), "src").join(F.broadcast(b), "dst")
    return e.select("src", "dst", "relation", F.least("sa", "sb").alias("score")).orderBy(F.desc("score"), "src", "dst", "relation")


def content_search(files: DataFrame, pattern: str, literal: bool = False, glob: str | None = None, most: int = 200) -> tuple[DataFrame, bool]:
    """(path, line, col, text) of matching lines, and whether there were more.  files: path, content.

    Without capitals in the pattern, case does not matter.
    """
    import re

    want = re.escape(pattern) if literal else pattern
    re.compile(want)
    expr = want if any(ch.isupper() for ch in pattern) else f"(?i){want}"
    some = files
    if glob:
        some = some.where(F.col("path").rlike("^" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"))
    lines = some.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    hits = lines.where(F.col("text").rlike(expr)).select("path", (F.col("n") + 1).alias("line"), F.regexp_instr("text", F.lit(expr)).alias("col"), "text")
    top = hits.orderBy("path", "line", "col").limit(most + 1)
    more = top.count() > most
    return top.limit(most), more
