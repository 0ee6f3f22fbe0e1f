"""Replicate-weight survey estimation.

A design is one full-sample weight plus R replicate weights.  Every estimate
is a function of weighted totals, and weighted totals are sums, so the whole
estimator is two ordinary aggregations:

1. ``replicate_totals``: one ``groupBy`` with R+1 ``sum`` aggregates.  Spark
   runs it as a partial (map-side) aggregate, so what crosses the shuffle is
   one row per cell per map task, never the microdata rows, and a hot cell
   is combined before it is shuffled.
2. parent totals for proportions: a window sum over the (already tiny) cell
   table instead of a join back (D3).

Standard errors are plain column arithmetic on the totals:
``se = sqrt(scale * sum_r rscale_r * (est_r - centre)^2)`` with
``centre`` = full-sample estimate when ``mse`` is true, else the replicate
mean.  A replicate whose proportion is undefined (parent replicate total of
zero) contributes nothing to the sum; that is a documented choice.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the American Community Survey replicate design used by the
# published runs: 80 replicates, variance scale 4/80, replicate scale 1,
# deviations centred on the full-sample estimate, 90% z value.
ACS_REPLICATES = 80
ACS_SCALE = 4 / 80
Z90 = 1.645

TOTAL_PREFIX = "_t"


@dataclass(frozen=True)
class ReplicateDesign:
    weight: str
    rep_weights: tuple[str, ...]
    scale: float = ACS_SCALE
    rscales: tuple[float, ...] | None = None
    mse: bool = True
    packed: str | None = None

    @classmethod
    def acs(cls, prefix: str = "WGTP", replicates: int = ACS_REPLICATES) -> "ReplicateDesign":
        return cls(prefix, tuple(f"{prefix}{i}" for i in range(1, replicates + 1)))

    @classmethod
    def stored(cls, column: str, replicates: int = ACS_REPLICATES) -> "ReplicateDesign":
        """Weights stored as one array column: the full-sample weight, then the replicates.  Rows cross joins
        and shuffles as one field; the elements are only taken out where they are summed."""
        return cls(column, tuple(f"{column}[{i}]" for i in range(1, replicates + 1)), packed=column)

    @property
    def weight_exprs(self) -> list[str]:
        """The weights as SQL expressions, the full-sample weight first."""
        if self.packed:
            return [f"get(`{self.packed}`, {i})" for i in range(self.replicates + 1)]
        return [f"`{c}`" for c in self.columns]

    @property
    def replicates(self) -> int:
        return len(self.rep_weights)

    @property
    def columns(self) -> list[str]:
        return [self.weight, *self.rep_weights]

    def cells(self) -> "ReplicateDesign":
        """The same design over a table of replicate totals (``_t0.._tR``),
        so cell tables can be re-aggregated with the same functions."""
        return ReplicateDesign(total_name(0),
                               tuple(total_name(i) for i in range(1, self.replicates + 1)),
                               self.scale, self.rscales, self.mse)


def total_name(i: int) -> str:
    return f"{TOTAL_PREFIX}{i}"


def total_names(design: ReplicateDesign) -> list[str]:
    return [total_name(i) for i in range(design.replicates + 1)]


def replicate_totals(df: DataFrame, design: ReplicateDesign, by: Sequence[str]) -> DataFrame:
    """Weighted totals per cell: ``by`` + ``_t0`` (full sample) .. ``_tR``."""
    aggs = [F.expr(f"sum({c}) AS `{total_name(i)}`") for i, c in enumerate(design.weight_exprs)]
    return df.groupBy(*by).agg(*aggs)


def _dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def replicate_se_sql(estimate: str, replicates: str, design: ReplicateDesign) -> str:
    """Replicate standard error of an estimate expression, given an array
    expression of its replicate estimates, as SQL text.

    One small expression reduces the array instead of an 80-term tree, and it is
    only ever evaluated on cell tables.  Terms are summed left to right, so
    results are reproducible to the last bit; undefined replicate terms count as zero."""
    reps = f"transform({replicates}, x -> CAST(x AS DOUBLE))"
    if design.mse:
        centre = f"CAST({estimate} AS DOUBLE)"
    else:
        centre = f"(aggregate({reps}, {_dbl(0.0)}, (acc, x) -> acc + x) / CAST(size({reps}) AS DOUBLE))"
    if design.rscales is not None and any(r != 1 for r in design.rscales):
        rs = "array(" + ", ".join(_dbl(r) for r in design.rscales) + ")"
        sq = f"zip_with({reps}, {rs}, (x, r) -> (x - {centre}) * (x - {centre}) * r)"
    else:
        sq = f"transform({reps}, x -> (x - {centre}) * (x - {centre}))"
    ssq = f"aggregate({sq}, {_dbl(0.0)}, (acc, t) -> acc + coalesce(t, {_dbl(0.0)}))"
    return (f"CASE WHEN {centre} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"ELSE sqrt({_dbl(design.scale)} * {ssq}) END")


def survey_total(df: DataFrame, design: ReplicateDesign, by: Sequence[str],
                 name: str = "num") -> DataFrame:
    """``survey_total()`` per cell: ``name`` and ``name_se``."""
    cells = replicate_totals(df, design, by)
    return totals_from_cells(cells, design, by, name)


def totals_from_cells(cells: DataFrame, design: ReplicateDesign, by: Sequence[str],
                      name: str = "num") -> DataFrame:
    t = total_names(design)
    arr = "array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in t[1:]) + ")"
    packed = cells.selectExpr(*[f"`{c}`" for c in by], f"`{t[0]}` AS _n0", f"{arr} AS _ts")
    return packed.selectExpr(*[f"`{c}`" for c in by], f"CAST(_n0 AS DOUBLE) AS `{name}`",
                             f"{replicate_se_sql('_n0', '_ts', design)} AS `{name}_se`")


def survey_rate(df: DataFrame, design: ReplicateDesign, within: Sequence[str],
                indicator: str, z: float = Z90) -> DataFrame:
    """``survey_total`` + ``survey_mean`` of ``indicator`` within ``within``,
    joined to the ``within`` total and finished with MOE and CV (E1-E5).

    Output: within, indicator, num, num_se, rate, rate_se, pop, pop_se,
    rate_moe, rate_cv, count_moe, count_cv.
    """
    cells = replicate_totals(df, design, [*within, indicator])
    return rate_from_cells(cells, design, within, indicator, z)


def rate_from_cells(cells: DataFrame, design: ReplicateDesign, within: Sequence[str],
                    indicator: str, z: float = Z90) -> DataFrame:
    """Proportions from a cell table of replicate totals.

    The parent total of every replicate is a window sum over ``within``;
    a null key is its own group, like a natural join matching NA to NA (T11).
    """
    n = design.replicates + 1
    t = total_names(design)
    # an empty ``within`` is the whole (cell) table as one parent
    over = ("OVER (PARTITION BY " + ", ".join(f"`{c}`" for c in within) + ")") if within else "OVER ()"
    # built as SQL text: 2 x 81 columns in a handful of JVM calls
    with_parent = cells.selectExpr(
        *[f"`{c}`" for c in [*within, indicator, *t]],
        *[f"sum(`{t[i]}`) {over} AS `_p{i}`" for i in range(n)])
    t_arr = "array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in t[1:]) + ")"
    p_arr = "array(" + ", ".join(f"CAST(`_p{i}` AS DOUBLE)" for i in range(1, n)) + ")"
    packed = with_parent.selectExpr(*[f"`{c}`" for c in [*within, indicator]], f"`{t[0]}` AS _n0",
                                    "_p0 AS _q0", f"{t_arr} AS _ts", f"{p_arr} AS _ps")
    theta0 = "try_divide(CAST(_n0 AS DOUBLE), CAST(_q0 AS DOUBLE))"
    thetas = "zip_with(_ts, _ps, (a, b) -> try_divide(a, b))"
    keys = [f"`{c}`" for c in [*within, indicator]]
    est = packed.selectExpr(
        *keys,
        "CAST(_n0 AS DOUBLE) AS num",
        f"{replicate_se_sql('_n0', '_ts', design)} AS num_se",
        f"{theta0} AS _rate",
        f"{replicate_se_sql(theta0, thetas, design)} AS rate_se",
        "CAST(_q0 AS DOUBLE) AS pop",
        f"{replicate_se_sql('_q0', '_ps', design)} AS pop_se",
    )
    return reliability(est, z)


def reliability(df: DataFrame, z: float = Z90, rate: str = "_rate") -> DataFrame:
    """MOE and CV for the rate and the count (E5).

    The reference mutates sequentially: ``rate`` is already a percentage when
    ``rate_cv`` is computed (T1).  Everything is computed from the raw
    proportion here and the percentage column is named last.  x/0 gives null
    (T9).
    """
    zl = F.lit(float(z))
    hundred = F.lit(100.0)
    pct = F.col(rate) * hundred
    rate_moe = F.col("rate_se") * zl * hundred
    count_moe = F.col("num_se") * zl
    others = [c for c in df.columns if c not in (rate, "num", "num_se", "rate_se", "pop", "pop_se")]
    return df.select(
        *others, "num", "num_se", pct.alias("rate"), "rate_se", "pop", "pop_se",
        rate_moe.alias("rate_moe"),
        (F.try_divide(rate_moe / zl, pct) * hundred).alias("rate_cv"),
        count_moe.alias("count_moe"),
        (F.try_divide(count_moe / zl, F.col("num")) * hundred).alias("count_cv"),
    )


def _expand_dimensions(cells: DataFrame, design: ReplicateDesign, keep: Sequence[str],
                       dims: dict[str, str], total_label: str) -> DataFrame:
    """One row per (cell, dimension): ``dimension`` and ``subgroup`` columns
    plus the cell's totals; the Total row is one more dimension."""
    entries = [F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("subgroup"))
               for name, c in dims.items()]
    entries.append(F.struct(F.lit("total").alias("dimension"), F.lit(total_label).alias("subgroup")))
    return cells.select(*keep, F.inline(F.array(*entries)), *total_names(design.cells()))


def survey_total_breakdown(df: DataFrame, design: ReplicateDesign, geo: Sequence[str],
                           dims: dict[str, str], total_label: str = "Total",
                           z: float = Z90) -> DataFrame:
    """Weighted counts with SE, MOE and CV for several overlapping
    dimensions plus a Total (E1, E5, E6 for counts): the same two stages as
    ``survey_breakdown``."""
    cells = replicate_totals(df, design, [*geo, *dims.values()])
    cdesign = design.cells()
    expanded = _expand_dimensions(cells, design, geo, dims, total_label)
    by_group = replicate_totals(expanded, cdesign, [*geo, "dimension", "subgroup"])
    out = totals_from_cells(by_group, cdesign, [*geo, "dimension", "subgroup"])
    zl = F.lit(float(z))
    return out.select("*", (F.col("num_se") * zl).alias("count_moe"),
                      (F.try_divide(F.col("num_se") * zl / zl, F.col("num")) * F.lit(100.0)).alias("count_cv"))


def survey_breakdown(df: DataFrame, design: ReplicateDesign, geo: Sequence[str],
                     dims: dict[str, str], indicator: str, total_label: str = "Total",
                     z: float = Z90) -> DataFrame:
    """Rates for several *overlapping* subgroup dimensions plus a Total, stacked
    long with ``dimension`` and ``subgroup`` columns (E6).

    Two stages: aggregate the rows once to the finest cell
    (geo x every dimension x indicator), then expand each *cell* into one row
    per dimension and re-aggregate.  Rows are read and shuffled once no matter
    how many dimensions there are; the expansion touches only the cell table,
    whose size depends on the number of categories, not on the data.  The
    expansion keeps a null category as a real null subgroup, so it is never
    confused with a grouping-set null.
    """
    keys = [*geo, *dims.values(), indicator]
    cells = replicate_totals(df, design, keys)
    cdesign = design.cells()
    expanded = _expand_dimensions(cells, design, [*geo, indicator], dims, total_label)
    by_group = replicate_totals(expanded, cdesign, [*geo, "dimension", "subgroup", indicator])
    out = rate_from_cells(by_group, cdesign, [*geo, "dimension", "subgroup"], indicator, z)
    return out


def survey_indicators_breakdown(df: DataFrame, design: ReplicateDesign, geo: Sequence[str], dims: dict[str, str],
                                indicators: dict[str, str], total_label: str = "Total", z: float = Z90) -> DataFrame:
    """``survey_breakdown`` for several indicators of the same rows in one pass (E6, K1, K2):
    ``measure`` names the indicator, ``level`` its value.

    Rows are aggregated once into cells keyed by every dimension *and* every indicator; each
    cell then goes to every (dimension, indicator) pair and is summed over the others there.
    The cells grow with the product of the categories, not with the rows, and another
    indicator of k values makes them k times as many, not another pass."""
    cells = replicate_totals(df, design, [*geo, *dims.values(), *indicators.values()])
    cdesign = design.cells()
    expanded = _expand_dimensions(cells, design, [*geo, *indicators.values()], dims, total_label)
    entries = [F.struct(F.lit(name).alias("measure"), F.col(c).cast("string").alias("level")) for name, c in indicators.items()]
    marginal = expanded.select(*geo, "dimension", "subgroup", F.inline(F.array(*entries)), *total_names(cdesign))
    within = [*geo, "dimension", "subgroup", "measure"]
    by_group = replicate_totals(marginal, cdesign, [*within, "level"])
    return rate_from_cells(by_group, cdesign, within, "level", z)


def survey_threshold_runs(df: DataFrame, design: ReplicateDesign, within: Sequence[str], value: str,
                          cuts: Sequence[float], low: str, high: str, cut_col: str = "cut",
                          indicator: str = "indicator", z: float = Z90) -> DataFrame:
    """Rates of ``value <= cut`` for several cuts in one pass (the published
    100% and 138% runs, C5 + E1-E5).

    Rows are aggregated once into the bands between consecutive cuts; the
    cells of each cut are sums of bands (band <= j is at or below cut j), so
    adding a cut adds one band to the cell table, not another pass over the
    rows.  A null ``value`` has no band and no indicator, as in a single run.
    """
    cuts = sorted(float(c) for c in cuts)
    v = F.col(value)
    band = sum((F.when(v > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    banded = df.withColumn("_band", F.when(v.isNotNull(), band))
    cells = replicate_totals(banded, design, [*within, "_band"])
    cdesign = design.cells()
    entries = [F.struct(F.lit(c).alias(cut_col),
                        F.when(F.col("_band").isNull(), F.lit(None).cast("string"))
                         .when(F.col("_band") <= j, F.lit(low)).otherwise(F.lit(high)).alias(indicator))
               for j, c in enumerate(cuts)]
    expanded = cells.select(*within, F.inline(F.array(*entries)), *total_names(cdesign))
    per_cut = replicate_totals(expanded, cdesign, [*within, cut_col, indicator])
    return rate_from_cells(per_cut, cdesign, [*within, cut_col], indicator, z)
