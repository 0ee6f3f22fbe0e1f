"""Recodes, flags and label clean-up.

All of these are column expressions or broadcastable lookups; none runs
Python per row.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indicata.functions.scalars import any_equal, col_of, in_set, replace_first

# Subgroup labels of the published race/ethnicity recode.
NOT_LATINX = "Not Latinx"
LATINX = "Latinx"
NOT_AIAN = "Not AIAN"
AIAN = "AIAN Alone or in Combination"
NHPI = "NHPI Alone or in Combination"
NOT_NHPI = "Not NHPI"
SWANA = "SWANA"
NOT_SWANA = "Not SWANA"
WHITE_NL = "White NL"
BLACK_NL = "Black NL"
ASIAN_NL = "Asian NL"
OTHER_NL = "Other NL"
MULTI_NL = "Two or More NL"
LATINX_PLACEHOLDER = "Latinx placeholder"
AIAN_PLACEHOLDER = "AIAN placeholder"
NHPI_PLACEHOLDER = "NHPI placeholder"

# Subgroups dropped from published breakdowns (complements and
# placeholders).
SUPPRESSED_SUBGROUPS = (NOT_AIAN, NOT_LATINX, NOT_NHPI, NOT_SWANA,
                        AIAN_PLACEHOLDER, NHPI_PLACEHOLDER, LATINX_PLACEHOLDER)

# Ancestry descriptions counted as Southwest Asian / North
# African, in the published order.
SWANA_DESCRIPTIONS = (
    "Algerian", "Arab", "Assyrian", "Bahraini", "Berber", "Chaldean", "Egyptian", "Emirati",
    "Iranian", "Iraqi", "Israeli", "Jordanian", "Kurdish", "Kuwaiti", "Lebanese", "Libyan",
    "Middle Eastern", "Moroccan", "North African", "Omani", "Palestinian", "Qatari", "Saudi",
    "Syriac", "Syrian", "Tunisian", "Yazidi", "Yemeni", "Mideast", "Saudi Arabian", "Arabic",
    "Other Arab", "Libyan (2017 or later)", "Kuwaiti (2017 or later)", "Turkish", "Sudanese",
    "Afghan",
)


def case_chain(rules: Sequence[tuple[Column, str]], default: str | None,
               null_when: Column | None = None) -> Column:
    """Ordered ``ifelse`` chain (C10).  ``null_when`` leads the chain: R's
    nested ``ifelse(x == ...)`` yields NA for a null code instead of the
    default (T3)."""
    expr = None
    if null_when is not None:
        expr = F.when(null_when, F.lit(None).cast("string"))
    for cond, label in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def race_rules(race: Column, not_latinx: Column, nhpi_needs_not_latinx: bool = False):
    """Rules of the exclusive race category; the children's variant also
    requires "Not Latinx" for code 7."""
    nhpi_cond = (race == "7") & not_latinx if nhpi_needs_not_latinx else (race == "7")
    return [
        ((race == "1") & not_latinx, WHITE_NL),
        ((race == "1") & ~not_latinx, LATINX_PLACEHOLDER),
        ((race == "2") & not_latinx, BLACK_NL),
        (race.isin("3", "4", "5"), AIAN_PLACEHOLDER),
        ((race == "6") & not_latinx, ASIAN_NL),
        (nhpi_cond, NHPI_PLACEHOLDER),
        ((race == "8") & not_latinx, OTHER_NL),
        ((race == "9") & not_latinx, MULTI_NL),
    ]


def hit_in_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame, code_col: str, out: str) -> DataFrame:
    """``out`` = whether any of ``columns`` holds a code from ``codes`` (C9, D7); never null.

    One left join per code column against the distinct code set; the planner
    broadcasts the code set when its measured size allows (a data dictionary
    is small), otherwise it shuffles.  A null code is never a member (T2).
    """
    distinct_codes = codes.select(F.col(code_col).alias("_code")).distinct()
    hits = []
    res = df
    for i, c in enumerate(columns):
        m = distinct_codes.select(F.col("_code").alias(c), F.lit(True).alias(f"_hit{i}"))
        res = res.join(m, c, "left")
        hits.append(F.coalesce(F.col(f"_hit{i}"), F.lit(False)))
    hit = hits[0]
    for h in hits[1:]:
        hit = hit | h
    return res.withColumn(out, hit).drop(*[f"_hit{i}" for i in range(len(columns))])


def flag_in_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame, code_col: str,
                  yes: str, no: str, out: str) -> DataFrame:
    """``hit_in_codes`` as a label: ``out`` = yes or no."""
    res = hit_in_codes(df, columns, codes, code_col, out)
    return res.withColumn(out, F.when(F.col(out), F.lit(yes)).otherwise(F.lit(no)))


def codes_by_description(codes: DataFrame, descriptions: Iterable[str],
                         description_col: str = "Description") -> DataFrame:
    """Codes whose description is in a list."""
    return codes.filter(in_set(description_col, list(descriptions)))


FLAG_LABELS = {"latino": (LATINX, NOT_LATINX), "aian": (AIAN, NOT_AIAN), "nhpi": (NHPI, NOT_NHPI), "swana": (SWANA, NOT_SWANA)}


def race_bits(people: DataFrame, codes: DataFrame, descriptions: Iterable[str] = SWANA_DESCRIPTIONS) -> DataFrame:
    """Adds latino, aian, nhpi and swana (C7-C9) to person rows as bits: what the joins that follow have to carry
    of them, beside RAC1P, until ``race_labels``.  A null code takes the same side as in the published recode."""
    df = people.withColumns({"latino": ~in_set("HISP", ["01"]), "aian": ~in_set("RACAIAN", ["0"]),
                             "nhpi": any_equal({"RACPI": "1", "RACNH": "1"})})
    return hit_in_codes(df, ["ANC1P", "ANC2P"], codes_by_description(codes, descriptions), "ANC_Code", "swana")


def race_labels(df: DataFrame, nhpi_needs_not_latinx: bool = False) -> DataFrame:
    """The bits of ``race_bits`` as labels, and race."""
    df = df.withColumns({c: F.when(F.col(c), F.lit(yes)).otherwise(F.lit(no)) for c, (yes, no) in FLAG_LABELS.items()})
    race = F.col("RAC1P")
    nl = F.col("latino") == F.lit(NOT_LATINX)
    return df.withColumn("race", case_chain(race_rules(race, nl, nhpi_needs_not_latinx),
                                            LATINX_PLACEHOLDER, null_when=race.isNull()))


def race_recode(people: DataFrame, codes: DataFrame, descriptions: Iterable[str] = SWANA_DESCRIPTIONS,
                nhpi_needs_not_latinx: bool = False) -> DataFrame:
    """Adds latino, aian, nhpi, swana and race (C7-C10) to person rows."""
    return race_labels(race_bits(people, codes, descriptions), nhpi_needs_not_latinx)


def relabel(c, mapping: dict, default=None) -> Column:
    """Keyed relabel with a default (C11): a literal, a Column (e.g. the
    title-cased value), or None to keep unmapped values as they are."""
    expr = None
    for k, v in mapping.items():
        cond = col_of(c) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    if default is None:
        return expr.otherwise(col_of(c))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def clean_labels(c) -> Column:
    """Chart labels (C12): drop the first `` NL`` and `` Alone or in
    Combination``, ``Two or More`` -> ``Multiracial``, drop a leading
    ``nh_`` (first match only, T10)."""
    x = replace_first(col_of(c), " NL", "")
    x = replace_first(x, " Alone or in Combination", "")
    x = replace_first(x, "Two or More", "Multiracial")
    return replace_first(x, "^nh_", "")


def status_flags(status_col: str, open_value: str) -> dict[str, Column]:
    """``open``/``close`` as 1/0 (C13); a null status stays null."""
    s = F.col(status_col)
    return {"open": F.when(s == open_value, 1).when(s.isNotNull(), 0),
            "close": F.when(s == open_value, 0).when(s.isNotNull(), 1)}


def drop_subgroups(df: DataFrame, col: str = "subgroup",
                   labels: Sequence[str] = SUPPRESSED_SUBGROUPS) -> DataFrame:
    """Drop complement and placeholder subgroups (C21).  ``!=`` on NA drops
    the row in the reference, so null subgroups go too."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(labels)))


def override(df: DataFrame, key: str, key_value, column: str, value) -> DataFrame:
    """Point correction of one value by key (C17)."""
    return df.withColumn(column, F.when(F.col(key) == F.lit(key_value), F.lit(value))
                         .otherwise(F.col(column)))


def zero_fill(df: DataFrame) -> DataFrame:
    """Null -> 0 in every numeric column."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    return df.na.fill(0, subset=numeric)


def round_numeric(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column half-to-even."""
    return df.select([F.bround(F.col(f.name), digits).alias(f.name)
                      if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                      for f in df.schema.fields])
