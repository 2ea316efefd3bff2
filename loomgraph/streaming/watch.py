"""Change streams: batches of changed paths that keep a graph up to date.

A file source and `foreachBatch` stand for the watcher: the trigger is the
debounce window, a single query is the exclusive writer, and its checkpoint is
the queue of changes not yet applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.setops import incremental_merge
from ..sources.files import classify, noise

DEBOUNCE = "3 seconds"
CHANGE = "path string, change string, at timestamp"


def rebuildable(path: str = "path") -> Column:
    """Changes worth a rebuild: code and Markdown outside noise folders."""
    return ~noise(path) & ((classify(path) == "code") | F.lower(F.col(path)).rlike(r"\.(md|markdown)$"))


def settle(batch: DataFrame) -> DataFrame:
    """(path, change): the last change of each path of a batch, sorted."""
    return batch.where(rebuildable()).groupBy("path").agg(F.max_by("change", "at").alias("change")).orderBy("path")


def watch(spark: SparkSession, folder: str, apply: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = False):
    """Starts the query over JSON change records in a folder; `drain` takes what is there and stops."""
    changes = spark.readStream.schema(CHANGE).json(folder)

    def batch(rows: DataFrame, number: int) -> None:
        settled = settle(rows)
        if settled.limit(1).take(1):
            apply(settled, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=DEBOUNCE)).start()


class LiveGraph:
    """A graph that change batches are merged into; ``extract`` turns paths into nodes and links."""

    def __init__(self, graph: Graph, extract: Callable[[DataFrame], Graph], keep: Callable[[Graph, int], Graph]):
        self.graph, self.extract, self.keep = graph, extract, keep

    def apply(self, changes: DataFrame, number: int) -> None:
        removed = changes.where("change = 'removed'").select(F.col("path").alias("source_file"))
        touched = changes.where("change <> 'removed'").select(F.col("path").alias("source_file"))
        merged = incremental_merge(self.graph, self.extract(touched), touched, removed)
        self.graph = self.keep(merged, number)


def backoff(attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Seconds before the next try, doubling up to a bound."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def members_changed(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(path, member, kind): changed paths by the workspace member whose root is the longest prefix; manifests are told apart."""
    parts = F.split("path", "/")
    roots = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = paths.select("path", F.explode(roots).alias("root")).join(F.broadcast(members.select("root", "member")), "root")
    best = each.groupBy("path").agg(F.max_by("member", F.length("root")).alias("member"))
    base = F.element_at(F.split("path", "/"), -1)
    return best.select("path", "member", F.when(base.isin("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml"), "manifest").otherwise("source").alias("kind"))
