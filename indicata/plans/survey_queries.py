"""Survey runs on the stand-in tables.

Each function takes (spark, sf_dir) and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicata.operators import households as hh
from indicata.operators import recode, reports, survey
from indicata.operators.survey import ReplicateDesign
from indicata.plans import standins as S
from indicata.sources.staging import staged

AT_OR_BELOW = "at or below poverty"
ABOVE = "above poverty"
UNDER5 = "under 5"


def _indicator(cut: float):
    return hh.threshold("POVPIP", cut, AT_OR_BELOW, ABOVE)


RECODE_INPUTS = ["HISP", "RAC1P", "RACAIAN", "RACPI", "RACNH", "ANC1P", "ANC2P"]


def eligible(spark: SparkSession, sf_dir: str, population: dict | None = None,
             person_filter=None, recoded: bool = False,
             geo_cols: tuple = ("geoid",), keep: tuple = ("POVPIP",), replicates: bool = True, hashed: bool = False) -> DataFrame:
    """Households with their representative person, weights and area.

    The reference recodes every person before picking one per household.
    The recode is a function of the person's own columns, so it is applied
    after the pick: the same values, with the code-list joins seeing one row
    per household instead of every person."""
    people = S.persons(spark, sf_dir)
    households = S.households(spark, sf_dir)
    picked = hh.eligible_households(
        people, households, serial="SERIALNO", join_keys=["SERIALNO"], order=list(S.PERSON_ORDER),
        universe="POVPIP", weight="WGTP", person_filter=person_filter, population=population,
        keep=[*keep, *(RECODE_INPUTS if recoded else [])], key=S.person_key() if hashed else None)
    if recoded:
        picked = recode.race_recode(picked, S.code_list(spark, sf_dir), S.CODE_LIST_DESCRIPTIONS)
    placed = picked.join(S.geography(spark, sf_dir).select("o_custkey", *geo_cols), "o_custkey", "left")
    return S.add_household_replicates(placed) if replicates else placed


def eligible_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 1: one row per household with an eligible child under 5."""
    df = eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5, keep=("l_linenumber", "AGEP", "POVPIP"))
    return df.select("SERIALNO", "geoid", "l_linenumber", "AGEP", "POVPIP", "WGTP", "WGTP80",
                     _indicator(100).alias("indicator"))


def poverty_by_area(spark: SparkSession, sf_dir: str, cut: float = 100) -> DataFrame:
    """Flagship: share of eligible households at or below the cut, by area,
    for households with a child under 5 and for all households, with SEs,
    MOEs and CVs (county run, E1-E5, H1 with a population tag)."""
    df = eligible(spark, sf_dir, population={UNDER5: F.col("AGEP") < 5, "all": None}, hashed=True)
    df = df.withColumn("indicator", _indicator(cut))
    out = survey.survey_rate(df, S.HH_DESIGN, ["population", "geoid"], "indicator")
    return out.filter((F.col("indicator") == AT_OR_BELOW) & F.col("geoid").isNotNull())


def survey_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 alone: weighted household counts and SEs by area and indicator."""
    df = eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5)
    df = df.withColumn("indicator", _indicator(138))
    return survey.survey_total(df, S.HH_DESIGN, ["geoid", "indicator"])


def survey_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E5 at the 138% cut, every indicator level kept (survey_return)."""
    df = eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5)
    df = df.withColumn("indicator", _indicator(138))
    return survey.survey_rate(df, S.HH_DESIGN, ["geoid"], "indicator")


def _placed_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every household with its area (null where its customer has none).  The households, of which there are fewer
    than persons and of two columns, go to the customers; the persons then cross one join, not two."""
    homes = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("SERIALNO"), "o_custkey")
    return homes.join(S.geography(spark, sf_dir).select("o_custkey", "geoid"), "o_custkey", "left").select("SERIALNO", "geoid")


def person_weighted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + C6: person-weighted share of persons under 5, by area."""
    people = S.persons(spark, sf_dir).select("SERIALNO", "l_linenumber", "AGEP")
    placed = people.join(_placed_homes(spark, sf_dir), "SERIALNO")
    # the weights are added where they are summed: rows cross the joins narrow
    df = (S.add_person_weights(placed)
                .withColumn("age_group", F.when(F.col("AGEP") < 5, F.lit("Under 5"))
                            .when(F.col("AGEP") >= 5, F.lit("Not under 5"))))
    return survey.survey_rate(df, S.PERSON_DESIGN, ["geoid"], "age_group")


RECODE_COLS = ["latino", "aian", "nhpi", "swana", "race"]


def person_recodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person with the five recode columns."""
    people = recode.race_recode(S.persons(spark, sf_dir), S.code_list(spark, sf_dir),
                                S.CODE_LIST_DESCRIPTIONS)
    return people.select("SERIALNO", *S.PERSON_ORDER, "HISP", "RAC1P", "RACAIAN", "RACPI", "RACNH",
                         "ANC1P", "ANC2P", *RECODE_COLS)


def exclusive_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 with T3: person counts per race category (null kept as its own row)."""
    return person_recodes(spark, sf_dir).groupBy("race", "latino").agg(F.count("*").alias("persons"))


def null_safe_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7, C8 with T2: counts per ethnicity / AIAN / NHPI flag combination."""
    return person_recodes(spark, sf_dir).groupBy("latino", "aian", "nhpi").agg(F.count("*").alias("persons"))


def code_list_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestry flag for every person (the person key's
    timestamp part printed as ISO text at the report edge)."""
    out = person_recodes(spark, sf_dir).select("SERIALNO", *S.PERSON_ORDER, "ANC1P", "ANC2P", "swana")
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


BREAKDOWN_DIMS = {d: d for d in ["latino", "aian", "nhpi", "swana", "race"]}


def survey_breakdown(spark: SparkSession, sf_dir: str, cut: float = 100) -> DataFrame:
    """Race/ethnicity run (E6, D3, C21, C22): six overlapping breakdowns of
    households with a child under 5, at or below the cut, suppressed."""
    df = eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5, recoded=True)
    df = df.withColumn("indicator", _indicator(cut))
    out = survey.survey_breakdown(df, S.HH_DESIGN, ["geoid"], BREAKDOWN_DIMS, "indicator")
    out = out.filter(F.col("indicator") == AT_OR_BELOW)
    return recode.drop_subgroups(out)


def weighted_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person-weighted population by area and age group, the magnitude
    check the reference keeps next to its runs (all persons, no universe)."""
    people = S.persons(spark, sf_dir).select("SERIALNO", "l_linenumber", "AGEP")
    df = people.join(_placed_homes(spark, sf_dir), "SERIALNO")
    df = S.add_person_weights(df).select("geoid", "AGEP", "PWGTP")
    return df.groupBy("geoid", (F.col("AGEP") < 5).alias("under_5")).agg(
        F.sum("PWGTP").alias("population"), F.count(F.lit(1)).alias("persons"))


CUTS = (100.0, 138.0)


def poverty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county runs at both published cuts for both populations in one
    pass over the rows (C5 E1-E5 H1): one household pick, one aggregate into
    cut bands, per-cut cells summed from the bands."""
    df = eligible(spark, sf_dir, population={UNDER5: F.col("AGEP") < 5, "all": None}, hashed=True)
    out = survey.survey_threshold_runs(df, S.HH_DESIGN, ["population", "geoid"], "POVPIP", CUTS,
                                       AT_OR_BELOW, ABOVE)
    return out.filter((F.col("indicator") == AT_OR_BELOW) & F.col("geoid").isNotNull())


NOT_UNDER5 = "not under 5"


def children_by_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children under 5 by race/ethnicity (E6 E7 F3 F4, C10 children's
    variant): over all persons, the person-weighted count and share of
    under-fives in each of the five overlapping groupings plus the Total, with
    SE, MOE, CV and denominators, and each count's share of the area's Total;
    suppressed as published."""
    people = recode.race_bits(S.persons(spark, sf_dir), S.code_list(spark, sf_dir), S.CODE_LIST_DESCRIPTIONS)
    df = recode.race_labels(people.join(_placed_homes(spark, sf_dir), "SERIALNO"), nhpi_needs_not_latinx=True)
    df = df.select("SERIALNO", "l_linenumber", "geoid", *RECODE_COLS,
                   F.when(F.col("AGEP") < 5, F.lit(UNDER5)).when(F.col("AGEP") >= 5, F.lit(NOT_UNDER5)).alias("age_group"))
    out = survey.survey_breakdown(S.add_person_weights(df), S.PERSON_DESIGN, ["geoid"], BREAKDOWN_DIMS, "age_group")
    out = out.filter(F.col("age_group") == UNDER5)
    out = out.withColumn("pct", F.try_divide(F.col("num"), reports.total_of("num", ["geoid"])) * F.lit(100.0))
    return out.filter((F.col("dimension") == "total") | ~F.col("subgroup").isin(*recode.SUPPRESSED_SUBGROUPS))


def _stored_homes(spark: SparkSession, sf_dir: str, packed: bool) -> DataFrame:
    """The household file as it is stored: its 81 weights as one array of short numbers, or as columns."""
    homes = S.add_household_replicates(S.households(spark, sf_dir))
    names = S.HH_DESIGN.columns
    if packed:
        whole = ", ".join(f"CAST({c} AS SMALLINT)" for c in names)
        homes = homes.selectExpr("SERIALNO", "o_custkey", f"CASE WHEN WGTP IS NOT NULL THEN array({whole}) END AS weights")
    return staged(homes.select("SERIALNO", "o_custkey", *(["weights"] if packed else names)), "households")


def _stored_run(spark: SparkSession, sf_dir: str, packed: bool, cut: float = 100) -> DataFrame:
    people = S.persons(spark, sf_dir)
    weight = "weights" if packed else "WGTP"
    picked = hh.eligible_households(people, _stored_homes(spark, sf_dir, packed), serial="SERIALNO", join_keys=["SERIALNO"], order=list(S.PERSON_ORDER),
                                    universe="POVPIP", weight=weight, person_filter=F.col("AGEP") < 5, keep=["POVPIP"], key=S.person_key())
    placed = picked.join(S.geography(spark, sf_dir).select("o_custkey", "geoid"), "o_custkey", "left").withColumn("indicator", _indicator(cut))
    return survey.survey_rate(placed, ReplicateDesign.stored("weights", S.REPLICATES) if packed else S.HH_DESIGN, ["geoid"], "indicator")


def stored_weights_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county run over a stored household file whose weights are one array column, which
    crosses both joins as one field of 162 bytes."""
    return _stored_run(spark, sf_dir, True)


def stored_weights_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a file of 81 weight columns, which the bench sets beside it."""
    return _stored_run(spark, sf_dir, False)


BURDENED, NOT_BURDENED, BURDEN_CUT = "rent-burdened", "not rent-burdened", 30


def _burden():
    share = F.col("GRPIP")
    return F.when(share > BURDEN_CUT, F.lit(BURDENED)).when(share <= BURDEN_CUT, F.lit(NOT_BURDENED))


def household_indicators(spark: SparkSession, sf_dir: str, cut: float = 100) -> DataFrame:
    """Poverty and rent burden of households with a child under 5, the published level of each
    (``measure``) in all six breakdowns, out of one pick, recode and aggregate; suppressed."""
    df = eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5, recoded=True)
    df = df.withColumns({"poverty": _indicator(cut), "rent burden": _burden()})
    out = survey.survey_indicators_breakdown(df, S.HH_DESIGN, ["geoid"], BREAKDOWN_DIMS, {m: m for m in ("poverty", "rent burden")})
    return recode.drop_subgroups(out.filter(F.col("level").isin(AT_OR_BELOW, BURDENED)))


def rent_burden_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six breakdowns of households with a child under 5 that pay more than
    the cut for rent (E6, C21)."""
    df = eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5, recoded=True)
    df = df.withColumn("indicator", _burden())
    out = survey.survey_breakdown(df, S.HH_DESIGN, ["geoid"], BREAKDOWN_DIMS, "indicator")
    return recode.drop_subgroups(out.filter(F.col("indicator") == BURDENED))
