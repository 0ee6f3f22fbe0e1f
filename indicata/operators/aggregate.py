"""Register and series aggregation.

Plain hash aggregates with map-side partial aggregation; a hot group (one
county holding a third of a register) is combined inside each task before
the shuffle, so no task ever sees all of its rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.functions.scalars import col_of, strict_sum


def group_sum(df: DataFrame, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``group_by(by) %>% summarise(out = sum(col))``."""
    return df.groupBy(*by).agg(*[F.sum(F.col(c)).alias(o) for o, c in sums.items()])


def count_and_sum(df: DataFrame, by: Sequence[str], value: str, count_name: str, sum_name: str,
                  strict: bool = True) -> DataFrame:
    """``n()`` and ``sum(value)`` per area (E9).  ``strict`` mirrors R's
    ``sum`` without ``na.rm``: one unparsable value makes the total null."""
    s = strict_sum(value) if strict else F.sum(F.col(value))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(count_name), s.alias(sum_name))


def whole_and_part(df: DataFrame, part: Column, whole_label: str, part_label: str,
                   out: str = "geography") -> DataFrame:
    """Tag each row with the whole and, when ``part`` holds, the part.

    One scan feeds both aggregates: a row counts for the whole and once more
    for the part, instead of reading the register twice.
    """
    tags = F.array(F.lit(whole_label), F.when(part, F.lit(part_label)))
    return df.withColumn(out, F.explode(tags)).filter(F.col(out).isNotNull())


def by_period(df: DataFrame, date_col: str, period: str, by: Sequence[str],
              sums: dict[str, str], only: Column | None = None, strict: bool = True) -> DataFrame:
    """Totals per calendar month or day (E10, E11).  ``strict`` mirrors R's ``sum``
    without ``na.rm``: one null makes its period's total null.

    ``only`` is the row filter of the caller: the monthly closure series
    keeps closed facilities only, the daily series in the reference has no
    such filter.
    """
    d = df if only is None else df.filter(only)
    d = d.filter(F.col(date_col).isNotNull())
    if period == "month":
        keys = [F.date_format(F.col(date_col), "yyyy").alias("year"),
                F.date_format(F.col(date_col), "MM").alias("month")]
    elif period == "day":
        keys = [F.col(date_col).cast("date").alias("day")]
    elif period == "year":
        keys = [F.date_format(F.col(date_col), "yyyy").alias("year")]
    else:
        raise ValueError(period)
    total = strict_sum if strict else (lambda c: F.sum(F.col(c)))
    return d.groupBy(*by, *keys).agg(*[total(c).alias(o) for o, c in sums.items()])


def whole_and_part_by_period(df: DataFrame, part: Column, whole_label: str, part_label: str, date_col: str, period: str,
                             by: Sequence[str], sums: dict[str, str], only: Column | None = None) -> DataFrame:
    """``by_period`` for the whole and for a part of it, as ``geography`` (E10-E12).  Rows are summed
    once, to cells that lie inside or outside the part; only the cells are counted twice."""
    marked = df.withColumn("_in_part", F.coalesce(part, F.lit(False)))
    cells = by_period(marked, date_col, period, [*by, "_in_part"], sums, only)
    tagged = whole_and_part(cells, F.col("_in_part"), whole_label, part_label)
    keys = [c for c in cells.columns if c not in (*by, "_in_part", *sums)]
    return tagged.groupBy(*by, "geography", *keys).agg(*[strict_sum(o).alias(o) for o in sums])


def mean_of_sums(df: DataFrame, by: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    """Average of per-period totals within ``by``."""
    return df.groupBy(*by).agg(F.avg(F.col(value)).alias(out))


def moe_sum(moe, estimate=None, na_rm: bool = False) -> Column:
    """Root-sum-square MOE of a sum of estimates.

    With estimates, only the largest MOE among zero estimates is counted,
    as the census guidance for aggregating zero estimates prescribes.
    Without ``na_rm`` one missing MOE or estimate makes the result missing,
    as in the published call.
    """
    m = col_of(moe).cast("double")
    if estimate is None:
        out = F.sqrt(F.sum(m * m))
    else:
        e = col_of(estimate)
        nonzero = F.sum(F.when(e != 0, m * m).otherwise(F.lit(0.0)))
        zero_max = F.coalesce(F.max(F.when(e == 0, m * m)), F.lit(0.0))
        out = F.sqrt(nonzero + zero_max)
    if na_rm:
        return out
    absent = m.isNull() if estimate is None else m.isNull() | col_of(estimate).isNull()
    return F.when(F.count_if(absent) > 0, F.lit(None).cast("double")).otherwise(out)


def rate_per(num, den, base: float = 1.0) -> Column:
    """``num / den * base``; a zero denominator gives null."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double")) * F.lit(float(base))


def count_from_percent(rate, pop) -> Column:
    """``(rate / 100) * pop``: a percentage back to a count."""
    return col_of(rate).cast("double") / F.lit(100.0) * col_of(pop).cast("double")


def share_within(value: str, by: Sequence[str], scale: float = 100.0) -> Column:
    """value / total of its group x scale as a window."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(value).cast("double"), F.sum(F.col(value)).over(w).cast("double")) \
        * F.lit(float(scale))
