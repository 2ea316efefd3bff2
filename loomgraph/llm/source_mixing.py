"""Mixing sources to target weights by iterative proportional fitting.

DataFrame operations only.  Token weights form a table by source, language and
topic.  Raking multiplies its cells until the sums by source, by language and by
topic meet their targets; a document is then sampled with a probability that is
proportional to the factor of its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: Targets are the token shares to these powers (below 1: large groups give way), scaled to sum 1.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SWEEPS = 20
#: Share of all tokens that the sample holds in expectation.
BUDGET = 0.75
SEED = "mix-1"
#: Steps of the factor's logarithm in which the cells are ordered to spend the budget.
STEPS = 32


def token_count(text: str | Column) -> Column:
    """Parts between spaces and line feeds; 0 for empty or null text."""
    t = text_or_empty(text)
    gaps = F.length(t) - F.length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.length(t) > 0, gaps + 1).otherwise(0).cast("long")


def form_topic(text: str | Column) -> Column:
    """A topic by the form of the whole text, where a table has none: tables, shouting, lists, notes, essays, articles."""
    t = text_or_empty(text)
    n = F.length(t)
    tokens = token_count(t)
    feeds = n - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    bars = n - F.length(F.replace(t, F.lit("|"), F.lit("")))
    bangs = n - F.length(F.replace(t, F.lit("!"), F.lit("")))
    return (
        F.when(bars * 10 > tokens, "table")
        .when(bangs * 10 > tokens, "shout")
        .when(tokens < 60, "note")
        .when(feeds * 30 > tokens, "list")
        .when(tokens > 1500, "essay")
        .otherwise("article")
    )


def draw_key(id_col: str, text_col: str) -> Column:
    """What the sample goes by: the id, without one a hash of the text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text_or_empty(text_col))))


def unit_hash(key: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None, exponent: float) -> DataFrame:
    """cells with a column of the margin's target share."""
    whole = Window.partitionBy(margin)
    if given is not None:
        pairs = [F.lit(x) for k, v in given.items() for x in (k, float(v))]
        goal = F.coalesce(F.element_at(F.create_map(*pairs), F.col(margin)), F.lit(0.0))
    else:
        goal = F.pow(F.sum("share").over(whole), exponent)
    marked = cells.withColumn(f"goal_{margin}", goal)
    scale = marked.groupBy(margin).agg(F.max(f"goal_{margin}").alias("goal")).agg(F.sum("goal")).first()[0]
    return marked.withColumn(f"goal_{margin}", F.col(f"goal_{margin}") / F.lit(scale or 1.0))


def rake(counts: DataFrame, work: Workspace, targets: dict[str, dict[str, float]] | None = None, exponents: dict[str, float] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """counts: source, lang, topic, tokens -> the same with ``factor``, raked share over present share.

    The table has a row a cell, however many documents there are.  Null values
    are groups of their own (targets given by name leave them out).  A group
    with no tokens cannot be raised; margins whose targets cannot all be met
    are met in turn, the topics last.
    """
    targets, exponents = targets or {}, EXPONENTS | (exponents or {})
    total = counts.agg(F.sum("tokens")).first()[0] or 1
    cells = counts.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(total))
    for margin in ("source", "lang", "topic"):
        cells = _targets(cells, margin, targets.get(margin), exponents[margin])
    cells = work.save(cells.withColumn("w", F.col("share")), "cells")
    for i in range(sweeps):
        for margin in ("source", "lang", "topic"):
            now = F.sum("w").over(Window.partitionBy(margin))
            cells = cells.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"goal_{margin}") / now).otherwise(F.lit(0.0)))
        if i % 4 == 3 or i == sweeps - 1:
            cells = work.save(cells, "raked")
    return cells.select("source", "lang", "topic", "tokens", (F.col("w") / F.col("share")).alias("factor"))


def probabilities(raked: DataFrame, work: Workspace, budget: float = BUDGET) -> DataFrame:
    """raked with ``probability``: min(1, c * factor), c such that the sample holds about ``budget`` of the tokens.

    Cells are ordered by the logarithm of their factor in steps, so that one
    small table (a row a step) is summed up, not the cells.
    """
    step = F.floor(F.log("factor") * STEPS)
    live = raked.where("factor > 0").select(step.alias("step"), "tokens", "factor")
    steps = live.groupBy("step").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("factor")).alias("r"), F.max("factor").alias("top"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("full", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("spent", F.coalesce(F.sum("r").over(above), F.lit(0.0)))
    total, rest = live.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("factor"))).first()
    tried = steps.withColumn("c", F.try_divide(F.lit((total or 0) * budget) - F.col("full"), F.lit(rest or 0.0) - F.col("spent")))
    # All steps before this one are full; the first step whose top stays below 1 settles c.
    c = tried.where("c > 0 and c * top <= 1").agg(F.max_by("c", "step")).first()[0]
    return raked.withColumn("probability", F.least(F.lit(1.0), F.lit(1e18 if c is None else c) * F.col("factor")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    tokens: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(marks, cells): a row a document with its cell, n_tokens, factor, probability and sampled; and the table of cells.

    ``topic`` and ``tokens`` are columns of docs where there are such, as a
    tokenizer's counts; else topics go by the form of a text and tokens are the
    parts between spaces and line feeds, both in the plan itself.  Documents
    without tokens (null or empty text) keep the probability 1, as they weigh
    nothing in any mix.  Rows that share an id are sampled together, rows
    without one by their text; the cells do not depend on the rows' order.  A
    very long text weighs by its tokens.  Columns of docs are read by name
    only, so others may have any name.
    """
    work = Workspace(docs.sparkSession, "mix")
    topic = form_topic(text_col) if topic is None else topic
    tokens = token_count(text_col) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    marks = docs.select(
        F.col(id_col).alias("id"), draw_key(id_col, text_col).alias("draw"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), topic.alias("topic"), tokens.alias("n_tokens")
    )
    marks = work.save(marks, "marks")
    counts = work.save(marks.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), "counts")
    cells = work.save(probabilities(rake(counts, work, targets), work, budget), "probabilities")
    return with_probability(marks, cells, "draw", seed).drop("draw"), cells


def with_probability(rows: DataFrame, cells: DataFrame, id_col: str, seed: str = SEED) -> DataFrame:
    """rows (source, lang, topic) with factor, probability and sampled; the planner broadcasts the cells only below its size limit."""
    c = cells.select(F.col("source").alias("cs"), F.col("lang").alias("cl"), F.col("topic").alias("ct"), "factor", "probability")
    on = rows.source.eqNullSafe(c.cs) & rows.lang.eqNullSafe(c.cl) & rows.topic.eqNullSafe(c.ct)
    out = rows.join(c, on, "left").drop("cs", "cl", "ct")
    out = out.withColumn("factor", F.coalesce("factor", F.lit(1.0))).withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("sampled", unit_hash(id_col, seed) < F.col("probability"))


def sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    tokens: Column | None = None,
    budget: float = BUDGET,
    seed: str = SEED,
) -> DataFrame:
    """The sampled documents; columns unchanged, no shuffle of texts.  See ``mix`` for odd rows."""
    _, cells = mix(docs, id_col, text_col, source_col, lang_col, topic, tokens, budget=budget, seed=seed)
    own = form_topic(text_col) if topic is None else topic
    rows = docs.select(F.struct(*docs.columns).alias("whole"), draw_key(id_col, text_col).alias("draw"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), own.alias("topic"))
    return with_probability(rows, cells, "draw", seed).where("sampled").select("whole.*")
