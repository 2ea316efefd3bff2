"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Grouped aggregation only.  The evidence of a document is the log-likelihood
ratio of a naive Bayes model over binned features of its whole text, counted on
all labelled documents.  Its prior is the posterior share of good documents of
its path (a section of a host; here the language), which shrinks to the
posterior of the host, which shrinks to the global share; how strongly is
estimated from the spread between hosts.  Hosts and paths count every document:
labelled ones by their label, others by the probability that their evidence
gives them.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: Bin edges of the shares per thousand, fixed values.
EDGES = [1, 5, 20, 50, 100, 200, 400]
SYMBOLS = "*$#%&|!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("f_symbols", "f_capitals", "f_distinct", "f_word", "f_repeat")
#: Most distinct bins a feature has; the bound on what reaches the driver is len(FEATURES) times this.
MOST_BINS = 32
#: Documents below this probability are rejected: throwing a good one away counts nine times as much as keeping a bad one.
LEAST = 0.1
#: Added to each count of a bin.
PSEUDO = 0.25
#: Limits of the estimated strength of a prior, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0


def _binned(value: Column) -> Column:
    return reduce(lambda out, k: out + F.when(value >= k, 1).otherwise(0), EDGES, F.lit(0))


def features(text: str) -> list[Column]:
    """Five small integers of a whole text (null: empty): symbols and capitals per thousand characters, share of distinct words, length of words, words per thousand that repeat the one before."""
    t = text_or_empty(text)
    n = F.length(t)

    def share(chars: str) -> Column:
        found = F.regexp_count(t, F.lit(f"[{chars}]"))
        return F.when(n > 0, F.floor(found * 1000 / n)).otherwise(0)

    words = F.split(t, " ")
    return [
        _binned(share(SYMBOLS)).alias(FEATURES[0]),
        _binned(share(CAPITALS)).alias(FEATURES[1]),
        F.floor(F.size(F.array_distinct(words)) * 20 / F.size(words)).cast("int").alias(FEATURES[2]),
        F.least(F.floor(n / F.size(words)), F.lit(15)).cast("int").alias(FEATURES[3]),
        _binned(F.floor(F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: a == b), lambda same: same)) * 1000 / F.size(words))).alias(FEATURES[4]),
    ]


class Model:
    """The fitted model: a weight for each bin (bounded), and the tables of priors."""

    def __init__(self, weights: dict[str, dict[int, float]], share: float, priors: DataFrame):
        self.weights, self.share, self.priors = weights, share, priors

    def evidence(self) -> Column:
        """Sum of the weights of a row's bins; a bin that no label has weighs 0."""
        parts = []
        for f in FEATURES:
            pairs = [F.lit(x) for b, w in sorted(self.weights[f].items()) for x in (b, w)]
            parts.append(F.coalesce(F.element_at(F.create_map(*pairs), F.col(f)), F.lit(0.0)) if pairs else F.lit(0.0))
        return reduce(lambda a, b: a + b, parts)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(marked: DataFrame, labels: DataFrame, work: Workspace, id_col: str = "doc_id", label: str = "quality") -> Model:
    """marked: id, host, path and features of all documents.  labels: id and 0/1 (null labels and ids are left out).

    Without labels of both classes every document has the probability 0.5.
    """
    known = labels.select(F.col(id_col).alias("lid"), F.col(label).cast("int").alias("good")).where("good in (0, 1) and lid is not null")
    known = known.groupBy("lid").agg(F.max("good").alias("good"))
    joined = work.save(marked.join(known, marked["id"] == known["lid"], "left").drop("lid"), "marked")
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).alias("bin")) for i, f in enumerate(FEATURES))))
    counts = joined.where("good is not null").select(bins.alias("x"), "good").groupBy("x.f", "x.bin").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    per = [{r.bin: (r.good, r.n - r.good) for r in counts if r.f == i} for i in range(len(FEATURES))]
    good = sum(g for g, _ in per[0].values())
    bad = sum(b for _, b in per[0].values())
    ready = good > 0 and bad > 0
    weights = {
        f: {b: log((g + PSEUDO) / (good + PSEUDO * len(per[i]))) - log((x + PSEUDO) / (bad + PSEUDO * len(per[i]))) for b, (g, x) in per[i].items()} if ready else {} for i, f in enumerate(FEATURES)
    }
    share = (good + 1) / (good + bad + 2)
    model = Model(weights, share, joined)
    # Good documents in thousandths, so that sums are exact in any order.
    soft = F.round(_sigmoid(F.lit(log(share / (1 - share))) + model.evidence()) * 1000).cast("long")
    mass = joined.select("host", "path", F.coalesce(F.col("good") * 1000, soft).alias("m"))
    paths = mass.groupBy("host", "path").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    paths = work.save(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("hm"), F.sum("hn"), F.count("*")).first()
    if total[2]:
        mean = (total[0] / 1000 + 1) / (total[1] + 2)
        spread = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hm") / 1000 / F.col("hn") - mean, 2))).first()[0] / total[1]
        chance = mean * (1 - mean) * total[2] / total[1]
        strength = min(STRONGEST, max(WEAKEST, mean * (1 - mean) / max(spread - chance, 1e-9) - 1))
    else:
        mean, strength = 0.5, 1.0
    above = hosts.select(F.col("host").alias("h"), ((F.col("hm") / 1000 + strength * mean) / (F.col("hn") + strength)).alias("host_prior"))
    model.priors = work.save(
        paths.join(above, paths.host.eqNullSafe(above.h)).select("host", "path", ((F.col("m") / 1000 + strength * F.col("host_prior")) / (F.col("n") + strength)).alias("prior")),
        "priors",
    )
    model.marked = joined
    return model


def mark(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), *features(text_col))


def judged(rows: DataFrame, model: Model) -> DataFrame:
    """rows (host, path, features) with evidence, prior and probability.

    The table of priors has a row a path; the planner broadcasts it only below
    its own size limit, and deals by path beyond it.
    """
    p = model.priors.select(F.col("host").alias("prior_host"), F.col("path").alias("prior_path"), "prior")
    out = rows.join(p, rows.host.eqNullSafe(p.prior_host) & rows.path.eqNullSafe(p.prior_path), "left")
    prior = F.coalesce("prior", F.lit(model.share))
    out = out.withColumn("evidence", model.evidence()).withColumn("prior", prior)
    return out.withColumn("probability", _sigmoid(_logit(F.col("prior")) + F.col("evidence"))).drop("prior_host", "prior_path")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label: str = "quality") -> DataFrame:
    """(id, host, path, evidence, prior, probability): a row a document; kept if the probability is LEAST or more.

    Null hosts and paths are groups of their own.  A document that several
    labels name counts as good if one says so.  Null texts count as empty,
    repeated rows each for itself; a very long text is looked at as a whole.
    Equal evidence gives equal results, so ties need no rule.  Columns of docs
    are read by name only, so others may have any name.
    """
    work = Workspace(docs.sparkSession, "quality")
    model = fit(mark(docs, id_col, text_col, host_col, path_col), labels, work, id_col, label)
    return judged(model.marked, model).select("id", "host", "path", "evidence", "prior", "probability")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label: str = "quality", least: float = LEAST) -> DataFrame:
    """The documents with a probability of ``least`` or more; columns unchanged, no shuffle of texts."""
    work = Workspace(docs.sparkSession, "quality")
    model = fit(mark(docs, id_col, text_col, host_col, path_col), labels, work, id_col, label)
    whole = F.struct(*docs.columns)
    rows = docs.select(whole.alias("whole"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), *features(text_col))
    return judged(rows, model).where(F.col("probability") >= least).select("whole.*")
