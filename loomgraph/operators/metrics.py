"""Evaluation: set scores, calibration, retrieval quality, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 of nothing is 0."""
    return F.when(whole > 0, F.floor((part * 200 + whole) / (whole * 2))).otherwise(0).cast("int")


def scores(predicted: Column, relevant: Column, hits: Column) -> list[Column]:
    """precision, recall and F1 in whole percent."""
    return [percent(hits, predicted).alias("precision"), percent(hits, relevant).alias("recall"), percent(2 * hits, predicted + relevant).alias("f1")]


def set_scores(predicted: DataFrame, relevant: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Scores of a predicted against a relevant set of keys, by group; distinct keys count."""
    p = predicted.select(*by, *keys).distinct().withColumn("p", F.lit(1))
    r = relevant.select(*by, *keys).distinct().withColumn("r", F.lit(1))
    j = p.join(r, [*by, *keys], "full_outer")
    counts = j.groupBy(*by).agg(F.count("p").alias("n_predicted"), F.count("r").alias("n_relevant"), F.count(F.col("p") + F.col("r")).alias("hits"))
    return counts.select(*by, "n_predicted", "n_relevant", "hits", *scores(F.col("n_predicted"), F.col("n_relevant"), F.col("hits")))


def pooled(per_group: DataFrame) -> DataFrame:
    s = per_group.agg(F.sum("n_predicted").alias("n_predicted"), F.sum("n_relevant").alias("n_relevant"), F.sum("hits").alias("hits"))
    return s.select("*", *scores(F.col("n_predicted"), F.col("n_relevant"), F.col("hits")))


def brier(samples: DataFrame) -> DataFrame:
    """Mean squared error of (confidence, hit)."""
    return samples.agg(F.avg(F.pow(F.col("confidence") - F.col("hit").cast("double"), 2)).alias("brier"))


def reliability(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, hit_rate, gap) over equal widths; the last bin holds 1.0 too."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    out = samples.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    return out.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("hit_rate"))).orderBy("bin")


def calibration_error(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error, and the Brier skill against always saying the base rate."""
    r = reliability(samples, bins)
    ece = r.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))
    base = samples.agg(F.avg(F.col("hit").cast("double")).alias("rate"))
    return ece.join(brier(samples), F.lit(True)).join(base, F.lit(True)).select("ece", "brier", F.when(F.col("rate") * (1 - F.col("rate")) > 0, 1 - F.col("brier") / (F.col("rate") * (1 - F.col("rate")))).otherwise(0.0).alias("skill"))


def retrieval(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """recall@k and mean reciprocal rank.  ranked: case, id, rank; relevant: case, id."""
    best = relevant.join(ranked, ["case", "id"], "left").groupBy("case").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("cases"), *(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def history_samples(transactions: DataFrame, seed_share: int = 1) -> DataFrame:
    """(commit, seed, file, support, seen, hit): co-change learned strictly before each commit.

    transactions: commit, idx, file.  For each commit and seed file in it, every file that earlier commits
    changed together with the seed.  An as-of join: pairs are counted up to idx by a window, so no pair of commits is compared.
    """
    tx = transactions.select("commit", "idx", "file").distinct()
    other = tx.select("commit", F.col("file").alias("seed"))
    pairs = tx.join(other, "commit").where("file <> seed").select("commit", "idx", "seed", "file")
    files = pairs.select("seed", "file").distinct()
    seeds = tx.select("commit", "idx", F.col("file").alias("seed"))
    grid = seeds.join(files, "seed").join(pairs.select("commit", "seed", "file", F.lit(1).alias("together")), ["commit", "seed", "file"], "left")
    before = Window.partitionBy("seed", "file").orderBy("idx", "commit").rowsBetween(Window.unboundedPreceding, -1)
    out = grid.select("commit", "idx", "seed", "file", F.coalesce(F.sum("together").over(before), F.lit(0)).alias("support"), F.count("*").over(before).alias("seen"), F.col("together").isNotNull().alias("hit"))
    return out.where("support > 0")


def baseline_check(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """Measured values (repo, metric, value) outside their bounds (repo, metric, low, high); a missing value counts as outside."""
    j = bounds.join(measured, ["repo", "metric"], "left")
    return j.where("value is null or value < low or value > high").orderBy("repo", "metric")


def ratchet(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds that only get tighter."""
    j = bounds.join(measured, ["repo", "metric"], "left")
    return j.select("repo", "metric", F.greatest("low", F.least("value", "high")).alias("low"), "high")
