"""The published survey runs over real person/household microdata.

The registered queries run the same operators on stand-in tables; these
functions take person and household DataFrames with the standard public-use
microdata columns (SERIALNO, SPORDER, PUMA, AGEP, POVPIP, WGTP, WGTP1..80 and
the race/ethnicity codes) and return the published indicator tables.  The
first eligible person of a household is the lowest person number (SPORDER),
the explicit form of "first in file order".
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indicata.operators import crosswalk, households as hh, recode, survey

AT_OR_BELOW = "at or below poverty"
ABOVE = "above poverty"
UNDER5, ALL = "under 5", "all"
DESIGN = survey.ReplicateDesign.acs("WGTP")
RACE_DIMS = {d: d for d in ("latino", "aian", "nhpi", "swana", "race")}


def _eligible(people: DataFrame, housing: DataFrame, area: str, area_cols: Sequence[str],
              under5: bool, keep: Sequence[str]) -> DataFrame:
    people = hh.in_area(people, area_cols, area)
    housing = hh.in_area(housing, area_cols, area)
    return hh.eligible_households(
        people, housing.select("SERIALNO", *area_cols, *DESIGN.columns), serial="SERIALNO",
        join_keys=["SERIALNO", *area_cols], order=["SPORDER"], universe="POVPIP", weight="WGTP",
        person_filter=(F.col("AGEP") < 5) if under5 else None, keep=keep)


def county_run(people: DataFrame, housing: DataFrame, area: str, geoid: str, cut: float = 100,
               under5: bool = True, area_cols: Sequence[str] = ("PUMA",)) -> DataFrame:
    """Share of eligible households at or below ``cut`` percent of the
    poverty line in one area, with SE, MOE and CV."""
    df = _eligible(people, housing, area, area_cols, under5, ["POVPIP"])
    df = df.withColumns({"geoid": F.lit(geoid),
                         "indicator": hh.threshold("POVPIP", cut, AT_OR_BELOW, ABOVE)})
    out = survey.survey_rate(df, DESIGN, ["geoid"], "indicator")
    return out.filter((F.col("indicator") == AT_OR_BELOW) & F.col("geoid").isNotNull())


def county_runs(people: DataFrame, housing: DataFrame, area: str, geoid: str, cuts: Sequence[float] = (100, 138),
                area_cols: Sequence[str] = ("PUMA",), key: Column | None = None) -> DataFrame:
    """The published county runs stacked: households with a child under 5 and all households
    (``population``), at each of the ``cuts`` (``cut``), out of one pass over the persons.  ``key`` orders the
    persons of a household (``order_key``); by default by person number."""
    key = hh.order_key([("SPORDER", 8)]) if key is None else key
    people, housing = hh.in_area(people, area_cols, area), hh.in_area(housing, area_cols, area)
    df = hh.eligible_households(
        people, housing.select("SERIALNO", *area_cols, *DESIGN.columns), serial="SERIALNO", join_keys=["SERIALNO", *area_cols], order=["SPORDER"],
        universe="POVPIP", weight="WGTP", population={UNDER5: F.col("AGEP") < 5, ALL: None}, keep=["POVPIP"], key=key)
    out = survey.survey_threshold_runs(df.withColumn("geoid", F.lit(geoid)), DESIGN, ["population", "geoid"], "POVPIP", cuts, AT_OR_BELOW, ABOVE)
    return out.filter(F.col("indicator") == AT_OR_BELOW)


def race_run(people: DataFrame, housing: DataFrame, codes: DataFrame, area: str, geoid: str,
             cut: float = 100, area_cols: Sequence[str] = ("PUMA",)) -> DataFrame:
    """Six overlapping race/ethnicity breakdowns of households with a child
    under 5, at or below the cut, suppressed as published.  ``codes`` is the
    ancestry code list (ANC_Code, Description)."""
    keep = ["POVPIP", "HISP", "RAC1P", "RACAIAN", "RACPI", "RACNH", "ANC1P", "ANC2P"]
    df = _eligible(people, housing, area, area_cols, True, keep)
    df = recode.race_recode(df, codes)
    df = df.withColumns({"geoid": F.lit(geoid),
                         "indicator": hh.threshold("POVPIP", cut, AT_OR_BELOW, ABOVE)})
    out = survey.survey_breakdown(df, DESIGN, ["geoid"], RACE_DIMS, "indicator")
    return recode.drop_subgroups(out.filter(F.col("indicator") == AT_OR_BELOW))


def area_run(people: DataFrame, housing: DataFrame, xwalk: DataFrame, area: str, cut: float = 100,
             area_key: str = "SPA") -> DataFrame:
    """Rates by planning area through a PUMA crosswalk; a PUMA in two areas
    counts fully in both, as published."""
    df = _eligible(people, housing, area, ["PUMA"], True, ["POVPIP"])
    df = df.withColumn("indicator", hh.threshold("POVPIP", cut, AT_OR_BELOW, ABOVE))
    # totals are additive: sum households to (PUMA, indicator) cells before
    # the many-to-many join, which then carries a few thousand rows
    cells = survey.replicate_totals(df, DESIGN, ["PUMA", "indicator"])
    cells = crosswalk.attach_crosswalk(cells, xwalk.select("PUMA", F.col(area_key).alias("geoid")), "PUMA")
    out = survey.survey_rate(cells, DESIGN.cells(), ["geoid"], "indicator")
    return out.filter((F.col("indicator") == AT_OR_BELOW) & F.col("geoid").isNotNull())
