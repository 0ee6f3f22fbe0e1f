"""Area report frames over the breakdown run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicata.functions.scalars import replace_first, title_case
from indicata.operators import aggregate as A
from indicata.operators import recode
from indicata.operators import reports as K
from indicata.plans import survey_queries as SQ

GEO = ["geoid"]
GROUP_LABEL = "Households with children under 5"
# a rate counts as stable when its coefficient of variation is below this value
MAX_CV = 40.0

# Labels and sentences of the published frames.
POVERTY_GROUP = "Percent of households with children under 5 in poverty"
RENT_GROUP = "Percent of households with children under 5 in rent-burdened households"
LARGEST = " children under 5 make up the largest racial-ethnic group in "
POVERTY_TITLE = " households with children under 5 are most likely to be in poverty in "
RENT_TITLE = " households with children under 5 are most likely to be rent-burdened in "
TOTAL_SENTENCE = ("The ", " under 5 poverty rate is ", "%.")
ONLY_SENTENCE = (" The only racial/ethnic group with statistically stable poverty rates is ", " whose poverty rate is ", "%.")


def indicator_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 F3 F4 C12 for every area and all six breakdowns at once."""
    return K.indicator_frame(SQ.survey_breakdown(spark, sf_dir), GEO, "num", group_label=GROUP_LABEL)


def children_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 over the children's counts, the first published frame."""
    return K.indicator_frame(SQ.children_by_race(spark, sf_dir), GEO, "num", group_label="Children under 5")


def poverty_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: poverty rates by subgroup with the area's Total rate."""
    return K.rate_frame(SQ.survey_breakdown(spark, sf_dir), GEO, group_label=POVERTY_GROUP)


def rent_burden_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: rent-burden rates by subgroup with the area's Total rate."""
    return K.rate_frame(SQ.rent_burden_breakdown(spark, sf_dir), GEO, group_label=RENT_GROUP)


def top_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the largest group and its count per area."""
    f = indicator_frame(spark, sf_dir)
    return K.top_by(f, GEO, "population").select("geoid", "subgroup", "population", "pct")


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the three published titles of each area from its top groups.  Both household
    indicators come out of one pass, ranked by area and indicator; the children's counts are
    of another universe (all persons, person weights) and so a run of their own."""
    def titles(frame, keys, value, frame_name, text):
        title = K.sentence(F.col("subgroup"), text, F.col("geoid"))
        return K.top_by(frame, keys, value).select("geoid", title.alias("title"), frame_name.alias("frame"))

    largest = titles(children_frame(spark, sf_dir), GEO, "population", F.lit("children"), F.lit(LARGEST))
    rates = K.rate_frame(SQ.household_indicators(spark, sf_dir), [*GEO, "measure"], ordered=False)
    text = F.when(F.col("measure") == "poverty", POVERTY_TITLE).otherwise(RENT_TITLE)
    return largest.unionByName(titles(rates, [*GEO, "measure"], "rate", F.col("measure"), text))


def indicator_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the published rate frames of both household indicators for every area, in one pass."""
    label = F.when(F.col("measure") == "poverty", POVERTY_GROUP).otherwise(RENT_GROUP)
    return K.rate_frame(SQ.household_indicators(spark, sf_dir), [*GEO, "measure"]).withColumn("group", label)


def fallback_text(spark: SparkSession, sf_dir: str, max_cv: float = MAX_CV) -> DataFrame:
    """Areas with fewer than two stable subgroup rates get a sentence
    instead of a chart; an area without any has only its Total rate to tell."""
    rows = SQ.survey_breakdown(spark, sf_dir)
    sub = rows.withColumn("total_rate", K.total_of("rate", GEO)).filter(F.col("dimension") != "total")
    stable = F.coalesce(F.col("rate_cv") < F.lit(max_cv), F.lit(False))
    gated = K.stability_gate(sub, GEO, stable).withColumn("stable_rate", F.when(stable, F.col("rate")))
    best = K.top_by(gated, GEO, "stable_rate")
    text = K.sentence(TOTAL_SENTENCE[0], F.col("geoid"), TOTAL_SENTENCE[1], K.pct_text("total_rate"), TOTAL_SENTENCE[2])
    only = K.sentence(ONLY_SENTENCE[0], F.col("subgroup"), ONLY_SENTENCE[1], K.pct_text("rate"), ONLY_SENTENCE[2])
    told = F.when(F.col("n_subgroups") > 0, F.concat(text, only)).otherwise(text)
    return best.select("geoid", "n_subgroups", "chartable", F.when(~F.col("chartable"), told).alias("text"))


# Subgroup codes relabelled by the access post; every other
# code is title-cased.
ECE_LABELS = {"twoormor": "Multiracial", "aian": "AIAN", "pacisl": "NHPI"}
ECE_GROUP = "Percent of children under 5 enrolled in ECE"


# the indicator table's own codes for the breakdown's labels
ECE_CODES = {recode.WHITE_NL: "nh_white", recode.BLACK_NL: "nh_black", recode.ASIAN_NL: "nh_asian", recode.OTHER_NL: "nh_other",
             recode.MULTI_NL: "nh_twoormor", recode.LATINX: "latinx", recode.AIAN: "aian", recode.NHPI: "pacisl", recode.SWANA: "swana"}


def ece_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-post frame over an indicator table of codes (E17 C11 C12 I4 G1):
    count from percent, drop the first ``nh_``, relabel codes with a title-case
    default, clean labels, drop the Total, sorted by rate."""
    t = SQ.survey_breakdown(spark, sf_dir).withColumn("subgroup", recode.relabel("subgroup", ECE_CODES))
    t = t.filter((F.col("subgroup") != "bipoc") & (F.col("dimension") != "total"))
    t = t.select("geoid", "rate", A.count_from_percent("rate", "pop").alias("population"),
                 replace_first("subgroup", "nh_", "").alias("code"))
    label = recode.relabel("code", ECE_LABELS, title_case("code"))
    label = replace_first(replace_first(label, " NL", ""), " Alone or in Combination", "")
    out = t.select("geoid", label.alias("subgroup"), "rate", "population", F.lit(ECE_GROUP).alias("group"))
    return out.orderBy(F.col("rate").desc(), "geoid", "subgroup")
