"""The published yearly series over real estimate and vital-record frames.

Estimates: one row per (GEOID, NAME, variable, year) with estimate and moe
(the yearly pulls stacked by ``sources.read_period_files``).  Vital
records: Year, County, Strata_Name (deaths only), Count (nullable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.functions.scalars import strict_sum
from indicata.operators import aggregate as A
from indicata.operators import series


def population_series(estimates: DataFrame, first_year: int | None = None,
                      last_year: int | None = None) -> DataFrame:
    """Sum of the estimates per area and year with the MOE of the sum (E16,
    NA-strict), missing years inside the range filled by the mean of the
    neighbouring years with MOE 0 (F5), ordered by year (G2)."""
    yearly = (estimates.withColumn("year", F.col("year").cast("int"))
              .groupBy("NAME", "year")
              .agg(F.sum("estimate").cast("double").alias("population"),
                   A.moe_sum("moe", "estimate").alias("moe")))
    filled = series.impute_gap(yearly, ["NAME"], "year", "population", moe="moe",
                               start=first_year, end=last_year, adjacent=True)
    return filled.orderBy("NAME", "year")


def infant_mortality(deaths: DataFrame, births: DataFrame, county: str, strata: str,
                     first_year: int) -> DataFrame:
    """Deaths (sum without NA removal) over births (NA skipped) x 1000 per
    year for one county (E15 E17 D6)."""
    d = (deaths.filter((F.col("County") == county) & (F.col("Strata_Name") == strata))
         .groupBy("Year").agg(strict_sum("Count").alias("Deaths")))
    b = (births.filter((F.col("County") == county) & (F.col("Year") >= first_year))
         .groupBy("Year").agg(F.sum("Count").alias("Births")))
    return d.join(b, "Year", "left").withColumn("mortality", A.rate_per("Deaths", "Births", 1000))
