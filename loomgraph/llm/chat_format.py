"""Chat formatting: root-to-leaf paths of reply trees as templated conversations.

DataFrame operations only.  Ancestors are found by joining the reply table with
itself: after round k every message knows the one 2^k replies above it, so a
tree of depth d takes log2(d) joins upward to score each branch, and as many
downward to list the messages of the branches that are chosen.  Joins run on
(tree, message), so a large tree is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: The template.  Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>\n"
TAIL = END.rstrip("\n")


def escape(text: Column) -> Column:
    """Reversible: between < and | one backslash more than the text has, so no control string is left in it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Reversible: a role keeps to one line and holds no control string."""
    out = F.replace(role, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def branches(base: DataFrame, work: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """base: tree, node, up, score, a row a message -> (tree, leaf, depth, score) of every root-to-leaf path, and the tables of ancestors 2^k above.

    Messages on a cycle reach no root and are in no path.  A parent that the
    tree does not hold counts as none.
    """
    # All these tables grow with the messages: joined by sort-merge, never broadcast.
    known = base.select(F.col("tree").alias("t"), F.col("node").alias("n")).hint("merge")
    found = base.join(known, base.tree.eqNullSafe(known.t) & (base.up == known.n), "left")
    level = work.save(found.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), "score"), "up")
    done, waiting = level.where("up is null"), level.where("up is not null")
    levels, before = [], None
    while True:
        # Only messages that have not reached a root go another round.
        still = waiting.count()
        if not still or still == before:
            break
        before = still
        levels.append(waiting)
        every = done.unionByName(waiting)
        above = every.select(*(F.col(c).alias(f"{c}2") for c in every.columns)).hint("merge")
        joined = waiting.join(above, waiting.tree.eqNullSafe(above.tree2) & (waiting.up == above.node2))
        level = work.save(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score")), "up")
        done, waiting = done.unionByName(level.where("up is null")), level.where("up is not null")
    if not levels:
        levels = [waiting]
    parents = levels[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct().hint("merge")
    leaves = done.join(parents, done.tree.eqNullSafe(parents.t) & (done.node == parents.n), "left_anti")
    return leaves.select("tree", F.col("node").alias("leaf"), "depth", "score"), levels


def format_conversations(
    messages: DataFrame,
    tree: str = "conv_id",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    best: int | None = None,
    learn: str = "assistant",
) -> DataFrame:
    """One row for each chosen branch: tree, leaf, branch_rank, branch_score, n_turns, formatted, spans.

    Branches of a tree are ranked by the sum of their messages' scores (null: 0),
    then by leaf; ``best`` keeps the first so many of a tree, None keeps all.
    ``formatted`` joins the turns from the root, each as start mark, role, line
    feed, escaped text, end mark.  ``spans`` holds for each turn the first and
    past-the-end code point of its text in ``formatted``, and whether the loss
    falls on it (its role is ``learn``).  Null role or text counts as empty; a
    null tree is a tree of its own.  Of messages that share tree and id the
    first by (role, text, parent, score) counts, with all that it says.
    Messages without an id are left out.  A very long text is one row of one
    task; more columns are ignored.
    """
    work = Workspace(messages.sparkSession, "chat")
    own = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    whole = F.struct(text_or_empty(role).alias("role"), text_or_empty(text).alias("text"), F.col(parent).alias("up"), own.alias("score"))
    base = messages.where(F.col(node).isNotNull()).select(F.col(tree).alias("tree"), F.col(node).alias("node"), whole.alias("m"))
    base = work.save(base.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"), "replies")
    ends, levels = branches(base.select("tree", "node", "up", "score"), work)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = ends.withColumn("branch_rank", rank)
    chosen = work.save(ranked if best is None else ranked.where(F.col("branch_rank") <= best), "branches")
    about = ["tree", "leaf", "branch_rank", "branch_score"]
    path = chosen.select("tree", "leaf", "branch_rank", F.col("score").alias("branch_score"), F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(levels))):
        step = levels[k].where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up").hint("merge")
        higher = path.join(step, path.tree.eqNullSafe(step.t) & (path.node == step.n))
        path = work.save(path.unionByName(higher.select(*about, F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))), "path")
    said = base.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.struct("role", "text").alias("said")).hint("merge")
    turns = path.join(said, path.tree.eqNullSafe(said.t) & (path.node == said.n))
    head = F.concat(F.lit(START), escape_role(F.col("said.role")), F.lit("\n"))
    turns = turns.select(*about, "above", head.alias("head"), escape(F.col("said.text")).alias("body"), (F.col("said.role") == learn).alias("loss"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("stop", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    turns = turns.withColumn("start", F.col("stop") - F.length("body"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("branch_rank").alias("branch_rank"),
        F.first("branch_score").alias("branch_score"),
        F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(END)).alias("block"), "start", "stop", "loss"))).alias("turns"),
    )
    return whole.select(
        F.col("tree").alias(tree),
        "leaf",
        "branch_rank",
        "branch_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t.block), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t.start.alias("start"), t.stop.alias("stop"), t.loss.alias("loss"))).alias("spans"),
    )


def blocks(formatted: Column) -> Column:
    """The turns of a formatted conversation without their end marks."""
    parts = F.split(formatted, r"\Q" + TAIL + r"\E\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def turn_role(block: Column) -> Column:
    return unescape_role(F.substring_index(F.substring(block, len(START) + 1, 1 << 30), "\n", 1))


def turn_text(block: Column) -> Column:
    return unescape(F.substring(block, F.locate("\n", block) + F.lit(1), F.length(block)))


def masked_text(formatted_blocks: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: each span is cut from its own turn, so the work grows with the length only."""

    def cut(block: Column, i: Column) -> Column:
        span = F.get(spans, i)
        begins = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1).stop + len(END))
        inner = F.substring(block, (span.start - begins + 1).cast("int"), (span.stop - span.start).cast("int"))
        return F.when(span.loss, unescape(inner)).otherwise(F.lit(""))

    return F.array_join(F.transform(formatted_blocks, cut), "")


def turns_as_replies(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a chain of replies: conv_id, node, parent, role, text.

    Turns of a conversation are numbered by (turn, role, text), so a repeated
    turn is a turn of its own.
    """
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = conversations.select("conv_id", at.alias("node"), "role", "text")
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def turns_as_tree(conversations: DataFrame, width: int = 2) -> DataFrame:
    """Rows by turn as a tree: conv_id, node, parent, role, text, score.

    Turn n answers turn n // ``width``, as if each turn had been answered
    ``width`` times; a reply's score is the length of its text.  A stand-in for
    tables that hold trees.
    """
    rows = turns_as_replies(conversations).drop("parent")
    parent = F.floor(F.col("node") / width).cast("long")
    return rows.select("conv_id", "node", F.when(parent > 0, parent).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))
