"""Dense row ids.

``seq.int(nrow(x))`` numbers the rows of a frame.  A window without a partition would take the whole
table through one task; here the rows are range-sorted, each partition counts its own, and the
counts before it give its first number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.sources.staging import staged

#: monotonically_increasing_id holds the partition above these bits and the row within it below
_ROW_BITS = 33


def dense_row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "id", first: int = 1) -> DataFrame:
    """``df`` with ``name`` = first, first + 1, ... in the order of ``order``, which should tell all
    rows apart: rows that tie in it are numbered one way or the other.  Nulls come first.

    The sorted rows are written once, as their partitions must not change between counting and
    numbering; a row for each partition, of two numbers, is broadcast.  A key that many rows
    share is spread over partitions by the rest of the order."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    rows = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "row-ids")
    part = F.shiftright("_at", _ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    within = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_base") + within + F.lit(first)).drop("_part", "_at", "_base")


def attach_by_row_id(df: DataFrame, others: DataFrame, order: Sequence[str], name: str = "id", how: str = "left") -> DataFrame:
    """``df`` and ``others`` numbered each by its own ``order`` and joined on the number, as a frame and the
    coordinates taken from it are: the n-th row of one with the n-th of the other."""
    clash = (set(df.columns) & set(others.columns)) - set(order)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    right = dense_row_ids(others, order, "_right").drop(*order)
    return dense_row_ids(df, order, name).join(right, F.col(name) == F.col("_right"), how).drop("_right")
