"""The published register summaries over real licensing-register frames.

Inputs are the register CSVs read with ``sources.read_register`` (snake_case
names): facility_type, facility_name, county_name, facility_zip,
facility_capacity, facility_status, closed_date (text, M/d/yyyy).  The
registered queries run the same operators on stand-in tables.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.functions.scalars import in_set, parse_date, parse_number
from indicata.operators import aggregate as A
from indicata.operators import recode, reshape
from indicata.plans.register_queries import CENTER_COLUMNS, CLOSURES, HOME_COLUMNS, LICENSED, SEATS


def prepare(register: DataFrame, licensed: str = LICENSED) -> DataFrame:
    """Status flags, parsed close date, month and year text, numeric capacity."""
    df = register.withColumns(recode.status_flags("facility_status", licensed))
    df = df.withColumns({"closed": parse_date("closed_date"),
                         "capacity": parse_number("facility_capacity")})
    return df.withColumns({"month": F.date_format("closed", "MM"), "year": F.date_format("closed", "yyyy")})


def closure_summary(centers: DataFrame, homes: DataFrame, county: str, years: Sequence[str],
                    state_label: str = "State", centers_label: str = "Child Care Center",
                    homes_label: str = "Family Child Care Home") -> DataFrame:
    """Closures and seats lost per year for the state and one county, both
    registers, wide by geography (K4)."""
    tagged = []
    for df, label in ((centers, centers_label), (homes, homes_label)):
        d = prepare(df).withColumn("kind", F.lit(label))
        tagged.append(d.select("kind", "county_name", "open", "close", "capacity", "closed", "year"))
    reg = reshape.stack(tagged).filter(F.col("year").isin(*years))
    yearly = A.whole_and_part_by_period(
        reg, F.col("county_name") == F.lit(county), state_label, county, "closed", "year", ["kind"],
        {"closures": "close", "seats": "capacity"}, only=F.col("open") == 0)
    long = yearly.select("year", "geography", F.inline(F.array(
        F.struct(F.concat("kind", F.lit(CLOSURES)).alias("type"), F.col("closures").cast("double").alias("value")),
        F.struct(F.concat("kind", F.lit(SEATS)).alias("type"), F.col("seats").alias("value")))))
    return reshape.pivot_wide(long, ["year", "type"], "geography", "value", [state_label, county]) \
        .orderBy("year", "type")


def capacity_by_zip(centers: DataFrame, homes: DataFrame, zips: DataFrame,
                    population: DataFrame | None = None, strict_reference: bool = False) -> DataFrame:
    """Licensed centers and homes with their capacity per requested ZIP code
    (C14 D4 D5 E9 C19).  ``zips`` is the requested list (one column
    ``zip``); ``population`` (zip,
    total_0_5, moe_0_5) is optional."""
    spine = zips.select(F.col("zip").cast("string").alias("zip")).distinct()

    def summary(df, n, cap):
        d = df.filter(in_set("facility_status", [LICENSED]))
        d = d.join(spine, d.facility_zip == spine.zip, "left_semi")
        d = d.withColumn("cap", parse_number("facility_capacity"))
        return A.count_and_sum(d, ["facility_zip"], "cap", n, cap, strict=True) \
            .withColumnRenamed("facility_zip", "zip")

    c = summary(centers, *CENTER_COLUMNS)
    h = summary(homes, *HOME_COLUMNS)
    out = (c if strict_reference else spine.join(c, "zip", "left")).join(h, "zip", "left")
    if population is not None:
        out = out.join(population, "zip", "left")
    return recode.zero_fill(out)
