"""Document fingerprints: threshold-scaled sketches of word shingles.

DataFrame operations only.  A sketch holds every shingle hash that lies below a
fixed fraction of the hash range, so it grows with its document, the sketch of a
union comes from the sketches, and the share of one sketch that another holds
estimates containment however unequal the documents are.

The fraction is FRACTION for long texts.  A text of few shingles keeps a larger
one, the least power of two that leaves about LEAST_KEPT hashes (all of them for
the shortest); it holds the smaller fraction's sketch within it.  Two sketches
are compared at the smaller of their fractions.  Where the smaller sketch has no
hash there, the estimate is null: it says nothing rather than 0.

What FRACTION costs (16 hex digits a hash; standard error of a containment of
one half, 1,000 and 10,000 shingles): 1/4 four digits a word, 0.03 and 0.01;
1/16 one digit a word, 0.06 and 0.02; 1/64 a quarter, 0.13 and 0.04; 1/256 a
sixteenth, 0.25 and 0.08.  A quarter is nearly as large as the text; 1/16 keeps a
sixth of it and errs by no more than a text of LEAST_KEPT hashes does anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, is_empty, text_or_empty, unused_name

SHINGLE = 5
#: Shingle hashes below this share of the hash range are kept, of short texts below a larger power of two.
FRACTION = 1 / 16
LEAST_KEPT = 64


def _below(fraction: Column) -> Column:
    """The first hash that does not lie below a fraction (a power of two); hashes are signed."""
    return (F.lit(-(2.0**63)) + fraction * 2.0**64).cast("long")


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, fraction: float = FRACTION, least: int = LEAST_KEPT) -> DataFrame:
    """df with a struct of ``fraction`` and ``hashes``, a sorted array of distinct hashes (long).

    Words are split at white space; a text of fewer words than the shingle is
    one shingle, one without words (or null) has an empty sketch.  Each step is
    a column of its own, so that no array is worked out twice.
    """
    words, hashes, share = (unused_name(df, x) for x in ("sketch_words", "sketch_hashes", "sketch_share"))
    split = F.transform(F.filter(F.split(text_or_empty(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    out = df.withColumn(words, split)
    each = ", ".join(f"get(`{words}`, i + {k})" for k in range(shingle))
    count = f"greatest(size(`{words}`) - {shingle}, 0)"
    out = out.withColumn(hashes, F.expr(f"if(size(`{words}`) = 0, cast(array() as array<bigint>), array_distinct(transform(sequence(0, {count}), i -> xxhash64({each}))))"))
    # The largest power of two that keeps `least` hashes or more, so halves down to the fraction.
    halves = F.floor(F.log2(F.greatest(F.size(hashes), F.lit(1)) / F.lit(float(least))))
    out = out.withColumn(share, F.greatest(F.lit(float(fraction)), F.least(F.lit(1.0), F.pow(F.lit(2.0), -halves))))
    kept = F.array_sort(F.filter(F.col(hashes), lambda h: (F.col(share) == 1.0) | (h < _below(F.col(share)))))
    out = out.withColumn(name, F.struct(F.col(share).alias("fraction"), kept.alias("hashes")))
    return out.drop(words, hashes, share)


def at_fraction(sketch: Column, fraction: Column) -> Column:
    """The hashes of a sketch that lie below a fraction no larger than its own."""
    return F.when(sketch.fraction == fraction, sketch.hashes).otherwise(F.filter(sketch.hashes, lambda h: h < _below(fraction)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts taken together (as sets of shingles)."""
    fraction = F.least(a.fraction, b.fraction)
    return F.struct(fraction.alias("fraction"), F.array_sort(F.array_union(at_fraction(a, fraction), at_fraction(b, fraction))).alias("hashes"))


def contained(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null if a has no hash at the common fraction, 1 or 0 if a has no shingle at all (b: none, some)."""
    fraction = F.least(a.fraction, b.fraction)
    mine = at_fraction(a, fraction)
    estimate = F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, at_fraction(b, fraction))) / F.size(mine))
    return F.when(F.size(a.hashes) == 0, F.when(F.size(b.hashes) == 0, 1.0).otherwise(0.0)).otherwise(estimate)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller of two texts (by estimated shingles) that the other one holds, 0 to 1 or null; two empty ones are alike."""
    smaller = F.size(a.hashes) / a.fraction <= F.size(b.hashes) / b.fraction
    return F.when(smaller, contained(a, b)).otherwise(contained(b, a))


def as_string(sketch: Column) -> Column:
    """16 lowercase hex digits a hash, in order; the fraction follows from the text alone, so equal texts have equal strings."""
    return F.lower(F.array_join(F.transform(sketch.hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _followers(narrow: DataFrame, work: Workspace) -> DataFrame:
    """(id, hash, before_id, before_hash, asked): for each document the one before it by (id, hash), and how many characters that one asks for.

    Ids and hashes alone are sorted by ranges; each range is numbered by itself,
    and only its last document is handed to the next range.  The first document
    follows the last one of all.
    """
    spark = narrow.sparkSession
    keys = narrow.where("id is not null").groupBy("id", "hash").agg(F.floor(F.first(F.length("text")) / 4).cast("int").alias("tail"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(parts, "id", "hash").withColumn("range", F.spark_partition_id())
    dealt = work.save(dealt, "ranges")
    own = F.struct("id", "hash", "tail")
    lasts = dealt.groupBy("range").agg(F.max(own).alias("last"))
    # One row a range, no more than there are partitions.
    order = Window.orderBy("range")
    lasts = lasts.select("range", F.coalesce(F.lag("last").over(order), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("handed"))
    rows = dealt.join(lasts, "range").select("*", F.coalesce(F.lag(own).over(Window.partitionBy("range").orderBy("id", "hash")), "handed").alias("before"))
    return rows.select("id", "hash", F.col("before.id").alias("before_id"), F.col("before.hash").alias("before_hash"), F.col("before.tail").alias("asked"))


def with_next(docs: DataFrame, id_col: str, text_col: str, work: Workspace, shingle: int, fraction: float) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): the start of the next document by ascending id, as much of it as the edit asks for, and its sketch.

    After the last document comes the first.  Documents that share an id are
    ordered by a hash of their texts; rows with equal id and text are one
    document.  A document without an id has no place in the order; the first
    document counts as its next.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    followers = work.save(_followers(narrow, work), "followers")
    # Texts are dealt by (id, hash) once; what the document before asks for is sent to that document's place.
    placed = narrow.where("id is not null").join(followers.hint("merge"), ["id", "hash"])
    handed = with_sketch(placed, "text", "next_sketch", shingle, fraction)
    handed = handed.select(F.col("before_id").alias("id"), F.col("before_hash").alias("hash"), F.substring("text", F.lit(1), F.col("asked")).alias("next_text"), "next_sketch")
    ids = docs.where(F.col(id_col).isNotNull())
    if ids.count() > followers.count():  # repeated rows hand on the same
        handed = handed.dropDuplicates(["id", "hash"])
    rows = with_sketch(narrow.where("id is not null").join(handed.hint("merge"), ["id", "hash"]), "text", "sketch", shingle, fraction)
    rows = rows.select("id", "text", "sketch", "next_text", "next_sketch")
    if is_empty(docs.where(F.col(id_col).isNull()).select(id_col)):
        return rows
    head = followers.agg(F.min(F.struct("id", "hash")).alias("h")).select("h.*").where("id is not null")
    first = with_sketch(narrow.join(head, ["id", "hash"], "left_semi").limit(1), "text", "next_sketch", shingle, fraction)
    first = work.save(first.select(F.lit(0).alias("one"), F.col("text").alias("next_text"), "next_sketch"), "first")
    lost = with_sketch(narrow.where("id is null").withColumn("one", F.lit(0)), "text", "sketch", shingle, fraction).join(first, "one", "left")
    # Without any document that has an id, a text is followed by itself.
    return rows.unionByName(lost.select("id", "text", "sketch", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("next_sketch", "sketch").alias("next_sketch")))


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """One row a document: id, n_chars, edited (text), sketch, edited_sketch, near_edited, near_next (null where the sketches cannot tell).

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document.  Null text counts as empty.
    Equal texts have equal sketches.  A very long text is one row of one task.
    """
    work = Workspace(docs.sparkSession, "sketch")
    rows = with_next(docs, id_col, text_col, work, shingle, fraction)
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sketch", edited.alias("edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
    rows = with_sketch(rows, "edited", "edited_sketch", shingle, fraction)
    return rows.withColumn("near_edited", containment(F.col("sketch"), F.col("edited_sketch")))
