"""Ordering, stacking and reshaping."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.functions.scalars import level_order


def stack(dfs: Sequence[DataFrame], tags: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``rbind`` by column name (H1).  ``tags`` adds one literal column per
    input (e.g. ``{"population": ["under 5", "all"]}``) so the halves stay
    distinguishable, which the reference's plain ``rbind`` loses."""
    parts = list(dfs)
    if tags:
        for name, values in tags.items():
            parts = [d.withColumn(name, F.lit(v)) for d, v in zip(parts, values)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def order_by_measure(df: DataFrame, column: str, tie: Sequence[str] = ()) -> DataFrame:
    """Descending by a measure with explicit tie-breakers (G1)."""
    return df.orderBy(F.col(column).desc_nulls_last(), *[F.col(t).asc() for t in tie])


def order_by_labels(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Order rows by a factor level list."""
    return df.orderBy(level_order(column, levels), F.col(column))


def pivot_wide(df: DataFrame, keys: Sequence[str], column: str, value: str,
               levels: Sequence[str]) -> DataFrame:
    """``spread(column, value)`` with explicit levels (H3).  Giving the
    levels avoids the extra job Spark runs to discover them."""
    return df.groupBy(*keys).pivot(column, list(levels)).agg(F.first(F.col(value)))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    """Wide columns -> rows (H4)."""
    return df.unpivot(list(ids), list(values), name, value)


def pair_measures(long: DataFrame, ids: Sequence[str], name: str, value: str,
                  prefixes: Sequence[str] = ("num", "pct")) -> DataFrame:
    """Pair ``num_<stem>`` with ``pct_<stem>`` rows by their stem.

    The reference pairs the two halves by row position (``cbind``); here the
    pairing key is the stem left after removing the prefix, so the result
    does not depend on row order.
    """
    rx = "^(" + "|".join(prefixes) + ")_(.*)$"
    tagged = long.withColumns({"_measure": F.regexp_extract(F.col(name), rx, 1),
                               "stem": F.regexp_extract(F.col(name), rx, 2)})
    tagged = tagged.filter(F.col("_measure") != "")
    return tagged.groupBy(*ids, "stem").pivot("_measure", list(prefixes)).agg(F.first(F.col(value)))
