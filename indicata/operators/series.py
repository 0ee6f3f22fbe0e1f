"""Yearly / daily series helpers.

The series are keyed by (area, period); every operation is a window
partitioned by area, so areas are independent tasks and no single task sees
the whole series table.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_periods(frames: dict, tag: str = "year") -> DataFrame:
    """One pull per period, stacked with a period tag."""
    parts = [df.withColumn(tag, F.lit(str(k))) for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def impute_gap(df: DataFrame, keys: Sequence[str], t: str, value: str, moe: str | None = None,
               step: Column | None = None, start=None, end=None, adjacent: bool = False) -> DataFrame:
    """Fill missing periods with the mean of the neighbouring values.

    A period spine per key runs from the key's first to last period
    (``sequence`` + ``explode``); a missing period takes
    (previous + next) / 2, its MOE is set to 0 and ``imputed`` marks it.  A gap
    at the edge (no neighbour on one side) stays as it is, without an MOE or a
    mark, and so does a period that is there with a null value.  ``t`` must be an
    integer or a date column; ``step`` is the spacing (1 or ``interval 1 day``).
    ``start``/``end`` fix the expected range instead (e.g. the years a series
    should have), so a missing first or last period shows up as a gap.

    ``adjacent`` takes the periods right before and after, as the published series does:
    where one of them is missing or null, the gap stays.  Without it a null or missing
    neighbour is passed over for the nearest known one.
    """
    bounds = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    if start is not None:
        bounds = bounds.withColumn("_lo", F.lit(start).cast(df.schema[t].dataType))
    if end is not None:
        bounds = bounds.withColumn("_hi", F.lit(end).cast(df.schema[t].dataType))
    seq = F.sequence(F.col("_lo"), F.col("_hi"), step) if step is not None \
        else F.sequence(F.col("_lo"), F.col("_hi"))
    spine = bounds.select(*keys, F.explode(seq).alias(t))
    full = spine.join(df.withColumn("_present", F.lit(True)), [*keys, t], "left")
    w = Window.partitionBy(*keys).orderBy(t)
    prev_v = F.last(F.col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_v = F.first(F.col(value), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    if adjacent:
        prev_v, next_v = F.lag(value).over(w), F.lead(value).over(w)
    mean = (prev_v + next_v) / F.lit(2.0)
    out = full.withColumn("_mean", F.when(F.col("_present").isNull(), mean)).drop("_present")
    out = out.withColumn("imputed", F.col("_mean").isNotNull()).withColumn(value, F.coalesce("_mean", value)).drop("_mean")
    if moe is not None:
        out = out.withColumn(moe, F.when(F.col("imputed"), F.lit(0.0)).otherwise(F.col(moe)))
    return out
