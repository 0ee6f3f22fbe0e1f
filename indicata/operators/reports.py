"""Per-area report frames over indicator tables.

The reference builds one chart frame per area and post in a driver-side
loop; here each operator handles every area at once with windows
partitioned by area, so areas are spread over tasks and nothing is
collected.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.operators.recode import clean_labels


def total_of(value: str, geo: Sequence[str], dimension: str = "dimension", total: str = "total") -> Column:
    """The Total row's value broadcast to every row of its area (F3): the row of the
    total dimension, not whatever category may be called so."""
    return F.max(F.when(F.col(dimension) == total, F.col(value))).over(Window.partitionBy(*geo))


def indicator_frame(df: DataFrame, geo: Sequence[str], measure: str = "num", subgroup: str = "subgroup",
                    group_label: str | None = None) -> DataFrame:
    """Chart frame for all areas (K1): drop the Total, clean labels, the measure
    as ``population``, the area total and the share of it (F4)."""
    out = df.select(*geo, "dimension", clean_labels(subgroup).alias(subgroup), F.col(measure).alias("population"),
                    total_of(measure, geo).alias("total")).filter("dimension <> 'total'")
    out = out.withColumn("pct", F.try_divide(F.col("population"), F.col("total")) * F.lit(100.0))
    if group_label is not None:
        out = out.withColumn("group", F.lit(group_label))
    return out


def rate_frame(df: DataFrame, geo: Sequence[str], subgroup: str = "subgroup", group_label: str | None = None,
               ordered: bool = True) -> DataFrame:
    """Chart frame of rates for all areas (K1): drop the Total, clean labels, the
    count as ``population``, the rate and the area's Total rate, highest rate first where
    ``ordered``."""
    out = df.select(*geo, "dimension", clean_labels(subgroup).alias(subgroup), F.col("num").alias("population"), "rate",
                    total_of("rate", geo).alias("total_rate")).filter("dimension <> 'total'")
    if group_label is not None:
        out = out.withColumn("group", F.lit(group_label))
    return out.orderBy(*geo, F.col("rate").desc_nulls_last(), "subgroup") if ordered else out


def top_by(df: DataFrame, geo: Sequence[str], value: str, tie: str = "subgroup") -> DataFrame:
    """Row with the largest value per area; ties go to the first ``tie``
    label, the deterministic stand-in for ``which.max`` (F2, T13)."""
    w = Window.partitionBy(*geo).orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def stability_gate(df: DataFrame, geo: Sequence[str], stable: Column, min_groups: int = 2) -> DataFrame:
    """Count the stable subgroups per area and flag areas that can be
    charted (F7)."""
    n = F.sum(F.when(stable, 1).otherwise(0)).over(Window.partitionBy(*geo))
    return df.withColumn("n_subgroups", n).withColumn("chartable", F.col("n_subgroups") >= min_groups)


def sentence(*parts) -> Column:
    """Concatenate literal text and columns into one sentence (K2, K3)."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(*cols)


def pct_text(c) -> Column:
    """``round(x, 1)`` (half-even) printed as text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.bround(col, 1).cast("string")
