"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target size in words.  A document's expected number of copies is
its weight times a level of its source, at most MAX_COPIES, and the level is such that the
expected words of the source are its target; the whole part of that is allocated for certain,
the rest is an inclusion probability ``p``.  The documents of a source are ranked by the Pareto
ratio of random odds to inclusion odds

    Q = (U / (1 - U)) / (p / (1 - p)),    U a uniform number hashed from id, size and text,

and the smallest are taken until their words fill what the certain copies leave of
the target.  The running total that decides this is never taken over a whole
source: ``Q`` is cut into buckets, which are even in ``U`` where the weights are equal,
the (source, bucket) totals are summed map-side, the running total over buckets gives
each bucket's base, and only the documents of one (source, bucket) meet in one window.
Documents with ``p`` = 0 take no part in that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import SPACE_CLASS, whole_rows, written

#: a document is taken this many times at most
MAX_COPIES = 3
#: weights dealt to the sources in code point order, repeating
WEIGHTS = (5, 2, 1)
#: parts into which a source's order is cut
BUCKETS = 4096
#: an expected number of copies so near a whole one is that one: the rest is what divisions round off
NEAR_WHOLE = 1e-9


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null has none."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), f"{SPACE_CLASS}+")
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", 0).otherwise(F.coalesce(F.size(words), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets follow the weights until a source reaches ``max_copies`` times its size;
    what it can't take is shared again by weight.  The level that this settles at is
    found in closed form: with sources ordered by size over weight, it is the first
    ``(total - caps before) / weights from here on`` that stays below its own cap.
    One row per source crosses these windows, never a document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    at = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
        .withColumn("_fits", F.col("_level") * F.col("_weight") <= F.col("_cap"))
        .withColumn("_settled", F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level")))).over(everything)["_level"])
    )
    target = F.when(F.col("_settled").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_settled") * F.col("_weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def levels(classes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, target, weight, size) of each source's weights to (source, weight, expected): the copies
    expected of a document of that weight.

    With the weights from high to low, the first k are held at ``max_copies``; what that leaves of the
    target is shared by weight.  The k that this settles at is the first whose highest free weight
    stays below the limit.  A row for each source and weight crosses these windows, never a document."""
    from_high = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before = F.coalesce(F.sum("size").over(from_high.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("size") * F.col("weight")).over(from_high.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    most = F.lit(float(max_copies))
    ranked = classes.withColumn("_level", F.when(onward > 0, (F.col("target") - most * before) / onward))
    settled = F.max(F.when(F.col("_level") * F.col("weight") <= most, F.struct("weight", "_level"))).over(Window.partitionBy("source"))["_level"]
    expected = F.when(F.col("_level").isNull(), F.lit(0.0)).otherwise(F.least(most, F.coalesce(settled * F.col("weight"), most)))
    return ranked.withColumn("_e", expected).select("source", "weight", F.when(F.abs(F.col("_e") - F.round("_e")) < NEAR_WHOLE, F.round("_e")).otherwise(F.col("_e")).alias("expected"))


def uniform(seed: int, *of: Column) -> Column:
    """A number above 0 and below 1 from the md5 of the values: the same in every run."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("?")) for c in of])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES, seed: int = 7,
        weight: Column | Callable[[Column], Column] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source and any others): doc_id, source,
    size, source_size, target, copies, taken = size * copies, and ``tie``, a hash of the text.

    ``weight`` (positive, of few distinct values; default 1), an expression of the documents' columns or
    a function of the size, makes documents of one source differ in their inclusion
    probability.  A null source is a source of its own, the last; a null or empty text has size 0 and is
    taken 0 times, a text of any length is counted whole.  Each row is drawn by its id, size and text: rows
    that repeat an id or have none are drawn apart if their texts differ, and rows that are equal
    throughout are interchangeable.  Ties in Q go by id, size and text hash.  Columns of other
    names may be called anything.  An empty table gives an empty one."""
    own = F.lit(1.0) if weight is None or not isinstance(weight, Column) else weight.cast("double")
    narrow = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"),
                         F.md5(F.coalesce("text", F.lit(""))).alias("_text"), own.alias("_w"))
    if weight is not None and not isinstance(weight, Column):
        narrow = narrow.withColumn("_w", weight(F.col("size")).cast("double"))
    narrow = written(narrow.withColumn("_u", uniform(seed, F.col("doc_id"), F.col("size"), F.col("_text"))).drop("_text"), "sizes")
    classes = written(narrow.groupBy("source", "_w").agg(F.sum("size").alias("size")), "classes")
    per_source = classes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(per_source, weights, share, max_copies).withColumnRenamed("source", "_s")
    of_class = classes.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("source", "target", "source_size", F.col("_w").alias("weight"), "size")
    share_of = levels(of_class, max_copies)
    # one row per source and weight, written so that Spark knows its size: it is broadcast where it is small,
    # and a hot source's partition of the join is split where it is not
    plan = written(of_class.select(F.col("source").alias("_s"), F.col("weight").alias("_c"), "source_size", "target").join(
        share_of.select(F.col("source").alias("_s2"), F.col("weight").alias("_c2"), "expected"),
        F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_c") == F.col("_c2"))).drop("_s2", "_c2"), "plan")
    sized = narrow.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_w") == F.col("_c"))).drop("_s", "_c")
    expected, u, p = F.col("expected"), F.col("_u"), F.col("_rest")
    odds = (u / (1 - u)) / (p / (1 - p))
    # the same for all of a source: p of its mean weight, by which Q is even again
    mean = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    mean = mean - F.floor(mean)
    even = F.col("_q") * F.when(mean > 0, mean / (1 - mean)).otherwise(1.0)
    ranked = (
        sized.withColumn("_certain", F.floor(expected))
        .withColumn("_rest", expected - F.col("_certain"))
        .withColumn("_q", F.when(p > 0, odds))
        .withColumn("_bucket", F.when(p > 0, F.least(F.floor(even / (1 + even) * buckets), F.lit(buckets - 1))))
    )
    # what is left of each source's target after the certain copies, then its running fill by bucket
    fill = ranked.groupBy("source", "_bucket").agg(
        F.sum(F.when(F.col("_bucket").isNotNull(), F.col("size")).otherwise(0)).alias("_here"),
        F.sum(F.col("size") * F.col("_certain")).alias("_sure"))
    in_source = Window.partitionBy("source")
    fill = fill.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_here").over(in_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sure").over(in_source).alias("_sure"))
    together = Window.partitionBy("source", "_bucket").orderBy("_q", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = ranked.filter("_bucket is not null").join(fill, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    filled = F.col("_base") + F.sum("size").over(together)
    # taken while the middle of the document lies within the target: the total ends as near it as whole documents allow
    pick = F.when(filled - F.col("size") / 2 <= F.col("target") - F.col("_sure"), 1).otherwise(0)

    def taken(rows: DataFrame, pick: Column) -> DataFrame:
        copies = F.when(F.col("size") > 0, F.col("_certain") + pick).otherwise(0)
        return rows.withColumn("copies", copies.cast("long")).select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "tie")

    return taken(drawn, pick).unionByName(taken(ranked.filter("_bucket is null"), F.lit(0)))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as ``mix`` takes it."""
    drawn = written(mix(docs, **options).groupBy(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"), "drawn")
    joined = whole_rows(docs).join(
        drawn, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc.text") == F.col("_tie")) & F.col("doc.source").eqNullSafe(F.col("_source")))
    # rows equal in id, source and text share their copies: the first of them by number get the odd ones
    shared = joined.withColumn("_mine", F.col("_copies"))
    if drawn.filter("_rows > 1").head(1):
        same = Window.partitionBy("_id", "_tie", "_source").orderBy(F.lit(0))
        repeated = joined.filter("_rows > 1").withColumn("_n", F.row_number().over(same)).withColumn(
            "_mine", F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_n") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)).drop("_n")
        shared = shared.filter("_rows = 1").unionByName(repeated)
    return shared.filter("_mine > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_mine").cast("int")))).select("doc.*")
