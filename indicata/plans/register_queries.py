"""Register, capacity, series and reshape runs on the stand-in tables
(SURVEY §7 steps 6-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from indicata.functions.scalars import (cast_all_text, clean_names, comma, level_order, month_name, paste, parse_date, parse_number, round_half_even,
                                        strict_sum)
from indicata.operators import aggregate as A
from indicata.operators import households, recode, reshape, series
from indicata.plans import standins as S
from indicata.sources import readers

# Fixed values of the stand-in register (shared with the SQL oracle).
CENTER_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
CENTER = "Child Care Center"
HOME = "Family Child Care Home"
STATUS_BY_CODE = {"F": "CLOSED", "P": "PENDING", "O": "LICENSED"}
LICENSED = "LICENSED"
WHOLE = "All areas"
FOCUS = "AMERICA"
YEARS = ("1997", "1998")
DAY_YEAR = "1998"
KNOWN_FROM = 1200
# Endings of the summary's row labels, and the published names of the capacity columns.
CLOSURES, SEATS = "-Closures", "-Seats Lost"
CENTER_COLUMNS, HOME_COLUMNS = ("total_centers", "capacity_centers"), ("total_family_homes", "capacity_family_homes")
ESTIMATE_FROM = 0.05
MISSING_DAY = "2024-01-15"


def register(spark: SparkSession, sf_dir: str, years: tuple[str, ...] = ()) -> DataFrame:
    """Facility register as the text feed would carry it (A3).  ``years`` bound the
    closing date before it becomes text, so that the scan can skip the other years; the
    capacity of a very small facility isn't known."""
    o = S.table(spark, sf_dir, "orders")
    if years:
        o = o.filter((F.col("o_orderdate") >= F.lit(f"{min(years)}-01-01").cast("timestamp"))
                     & (F.col("o_orderdate") < F.lit(f"{int(max(years)) + 1}-01-01").cast("timestamp")))
    geo = S.geography(spark, sf_dir).select("o_custkey", F.col("geoid").alias("county_name"))
    reg = o.join(geo, "o_custkey", "left")
    return reg.select(
        F.when(F.col("o_orderpriority").isin(*CENTER_PRIORITIES), F.lit(CENTER))
         .otherwise(F.lit(HOME)).alias("facility_type"),
        F.concat(F.lit("Facility "), F.col("o_orderkey").cast("string")).alias("facility_name"),
        "county_name",
        F.when(F.col("o_totalprice") >= KNOWN_FROM, F.floor(F.col("o_totalprice") / 10000).cast("int")).alias("facility_capacity"),
        recode.relabel("o_orderstatus", STATUS_BY_CODE).alias("facility_status"),
        F.date_format(F.col("o_orderdate"), "M/d/yyyy").alias("closed_date_text"),
    )


def prepared_register(spark: SparkSession, sf_dir: str, years: tuple[str, ...] = ()) -> DataFrame:
    """Status flags, parsed close date, month and year text."""
    reg = register(spark, sf_dir, years)
    reg = reg.withColumns(recode.status_flags("facility_status", LICENSED))
    reg = reg.withColumn("closed_date", parse_date("closed_date_text"))
    return reg.withColumns({"month": F.date_format("closed_date", "MM"),
                            "year": F.date_format("closed_date", "yyyy")})


def _periods(reg: DataFrame, period: str, only=None) -> DataFrame:
    return A.whole_and_part_by_period(reg, F.col("county_name") == F.lit(FOCUS), WHOLE, FOCUS, "closed_date", period,
                                      ["facility_type"], {"closed": "close", "seats": "facility_capacity"}, only)


def closures_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed facilities and seats lost per month, whole and part."""
    reg = prepared_register(spark, sf_dir, YEARS).filter(F.col("year").isin(*YEARS))
    return _periods(reg, "month", only=F.col("open") == 0)


def _iso_day(df: DataFrame, col: str = "day") -> DataFrame:
    """Report edge: the period key as ISO text (yyyy-MM-dd), which every
    consumer (CSV, pandas, other engines) reads the same way."""
    return df.withColumn(col, F.date_format(F.col(col), "yyyy-MM-dd"))


def closures_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-day totals without the closed-only filter (E11, as published)."""
    reg = prepared_register(spark, sf_dir, (DAY_YEAR,)).filter(F.col("year") == DAY_YEAR)
    return _iso_day(_periods(reg, "day"))


def mean_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average monthly closures per year (E14), computed, not typed in."""
    monthly = closures_by_month(spark, sf_dir)
    return A.mean_of_sums(monthly, ["facility_type", "geography", "year"], "closed", "mean_closed")


def closure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facility types x closures/seats x two years, wide by geography
    (K4: E13 rollup of the monthly sums, H1, H3, G3)."""
    monthly = closures_by_month(spark, sf_dir)
    yearly = monthly.groupBy("facility_type", "geography", "year").agg(
        strict_sum("closed").alias("closed"), strict_sum("seats").alias("seats"))
    long = yearly.select("year", "geography", F.inline(F.array(
        F.struct(F.concat(F.col("facility_type"), F.lit(CLOSURES)).alias("type"),
                 F.col("closed").alias("value")),
        F.struct(F.concat(F.col("facility_type"), F.lit(SEATS)).alias("type"),
                 F.col("seats").alias("value")))))
    wide = reshape.pivot_wide(long, ["year", "type"], "geography", "value", [WHOLE, FOCUS])
    return wide.orderBy("year", "type")   # G3


def closure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as it is printed: every number as text with thousands separators."""
    wide = closure_summary(spark, sf_dir)
    shown = wide.select("year", "type", *[comma(c).alias(c) for c in (WHOLE, FOCUS)])
    return cast_all_text(shown)


def compare_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus-area months of two years with the yearly mean.

    As published, the later year is summed without the closed-only filter
    (months with only licensed facilities give zero rows) and the earlier one
    with it.
    """
    year = F.col("year")
    reg = prepared_register(spark, sf_dir, YEARS).filter(
        (F.col("county_name") == F.lit(FOCUS)) & ((year == YEARS[1]) | ((year == YEARS[0]) & (F.col("open") == 0))))
    monthly = A.by_period(reg, "closed_date", "month", [], {"closed": "close"})
    return monthly.select(
        "year", "month", month_name(F.make_date(F.lit(2000), F.col("month").cast("int"), F.lit(1)))
        .alias("month_name"), "closed",
        F.avg("closed").over(Window.partitionBy("year")).alias("mean"))


# ------------------------------------------------------------- capacity

def _capacity_registers(spark, sf_dir):
    sup = S.table(spark, sf_dir, "supplier")
    centers = sup.select(
        F.col("s_nationkey").cast("string").alias("facility_zip"),
        F.when(F.col("s_acctbal") >= 0, F.lit(LICENSED)).otherwise(F.lit("CLOSED")).alias("facility_status"),
        F.when(F.col("s_suppkey") % 10 == 3, F.lit("n/a"))
         .otherwise(F.floor(F.abs(F.col("s_acctbal")) / 100).cast("string")).alias("facility_capacity"))
    cus = S.table(spark, sf_dir, "customer")
    homes = cus.select(
        F.col("c_nationkey").cast("string").alias("facility_zip"),
        F.when(F.col("c_acctbal") >= 0, F.lit(LICENSED)).otherwise(F.lit("CLOSED")).alias("facility_status"),
        F.floor(F.abs(F.col("c_acctbal")) / 1000).cast("string").alias("facility_capacity"))
    pop = (cus.filter(F.col("c_mktsegment") == "HOUSEHOLD")
              .groupBy(F.col("c_nationkey").cast("string").alias("zcta"))
              .agg(F.count(F.lit(1)).alias("total_0_5"))
              .withColumn("moe_0_5", F.sqrt(F.col("total_0_5").cast("double")) * F.lit(1.645)))
    return centers, homes, pop


def capacity_on_spine(spark: SparkSession, sf_dir: str, strict_reference: bool = False) -> DataFrame:
    """Centers, homes and population per requested area.

    The spine is the list of requested areas (every nation key here); Spark broadcasts it
    where it measures it as small.  With ``strict_reference``
    the result starts from the centers table as published, which loses areas
    without centers.
    """
    centers, homes, pop = _capacity_registers(spark, sf_dir)
    spine = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("area"))

    def licensed_in_spine(df):
        d = df.filter(F.col("facility_status") == LICENSED)
        d = d.join(spine, d.facility_zip == spine.area, "left_semi")
        return d.withColumn("cap", parse_number("facility_capacity"))

    c = A.count_and_sum(licensed_in_spine(centers), ["facility_zip"], "cap",
                        *CENTER_COLUMNS, strict=True)
    h = A.count_and_sum(licensed_in_spine(homes), ["facility_zip"], "cap",
                        *HOME_COLUMNS, strict=True)
    c = c.withColumnRenamed("facility_zip", "area")
    h = h.withColumnRenamed("facility_zip", "area")
    pop = pop.withColumnRenamed("zcta", "area")
    base = c if strict_reference else spine.join(c, "area", "left")
    out = base.join(h, "area", "left").join(pop, "area", "left")
    return recode.zero_fill(out)


# ------------------------------------------------------------- series

def _event_rows(spark, sf_dir) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    return e.select("event_type", F.col("ts").cast("date").alias("day"),
                    F.when(F.col("value") >= ESTIMATE_FROM, F.floor(F.col("value"))).alias("estimate"),
                    F.ceil(F.col("value") / 2).alias("moe"), "value")


def _daily_estimates(spark, sf_dir) -> DataFrame:
    rows = _event_rows(spark, sf_dir)
    return rows.groupBy("event_type", "day").agg(
        F.sum("estimate").alias("population"), A.moe_sum("moe", "estimate").alias("moe"))


def moe_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-day sums of estimates with root-sum-square MOE."""
    return _iso_day(_daily_estimates(spark, sf_dir))


def impute_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with one unreleased period filled by its neighbours."""
    s = _daily_estimates(spark, sf_dir).filter(F.col("day") != F.lit(MISSING_DAY).cast("date"))
    s = s.withColumn("population", F.col("population").cast("double"))
    filled = series.impute_gap(s, ["event_type"], "day", "population", moe="moe",
                               step=F.expr("INTERVAL 1 DAY"), adjacent=True)
    return _iso_day(filled.orderBy("event_type", "day"))   # G2


def sum_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NA-propagating vs skipping sums of a nullable count."""
    e = S.table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").cast("date").alias("day"),
        F.when(F.col("value") >= 1, F.lit(1)).alias("count"))
    out = e.groupBy("event_type", "day").agg(strict_sum("count").cast("double").alias("strict_total"),
                                             F.sum("count").alias("lenient_total"))
    return _iso_day(out)


def rate_per_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per 1000 views by day: strict numerator, lenient denominator
    joined on the period (E15 E17 D6)."""
    e = S.table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").cast("date").alias("day"),
        F.when(F.col("value") >= 1, F.lit(1)).alias("count"))
    deaths = e.filter(F.col("event_type") == "error").groupBy("day").agg(
        strict_sum("count").cast("double").alias("deaths"))
    births = e.filter(F.col("event_type") == "view").groupBy("day").agg(
        F.sum("count").cast("double").alias("births"))
    out = deaths.join(births, "day", "left").withColumn("mortality", A.rate_per("deaths", "births", 1000))
    return _iso_day(out)


# ------------------------------------------------------------- reshape

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_LABELS = {"automobile": "Automobile", "building": "Building", "furniture": "Furniture",
                  "household": "Household"}
OVERRIDE_STEM, OVERRIDE_VALUE = "household", 50.0


def wide_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-nation wide table with ``num_<segment>`` and ``pct_<segment>``;
    a share over fewer than 10 accounts is suppressed (null)."""
    c = S.table(spark, sf_dir, "customer")
    below = F.col("c_acctbal") < 0
    aggs = []
    for s in SEGMENTS:
        k = s.lower()
        in_s = F.col("c_mktsegment") == s
        n = F.count_if(in_s & below)
        tot = F.count_if(in_s)
        aggs.append(n.alias(f"num_{k}"))
        aggs.append(F.when(tot >= 10, F.try_divide(n.cast("double"), tot.cast("double"))).alias(f"pct_{k}"))
    return c.groupBy(F.col("c_nationkey").alias("county")).agg(*aggs)


def paired_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivot, pair num/pct by stem, correct, drop suppressed, relabel,
    round half-even, order (H4 C23 D8 C17 C18 C11 C20 G1)."""
    wide = wide_cost_table(spark, sf_dir)
    cols = [c for c in wide.columns if c != "county"]
    long = reshape.unpivot(wide.select("county", *[F.col(c).cast("double") for c in cols]),
                           ["county"], cols, "variable", "value")
    paired = reshape.pair_measures(long, ["county"], "variable", "value")
    paired = paired.withColumnsRenamed({"num": "num_value", "pct": "pct_value"})
    paired = paired.withColumn("pct_value", F.col("pct_value") * F.lit(100.0))
    paired = recode.override(paired, "stem", OVERRIDE_STEM, "pct_value", OVERRIDE_VALUE)
    paired = paired.filter(F.col("pct_value").isNotNull())
    paired = paired.withColumn("label", recode.relabel("stem", SEGMENT_LABELS, "Machinery"))
    out = paired.select("county", "stem", "label", round_half_even("num_value", 1).alias("num_value"),
                        round_half_even("pct_value", 1).alias("pct_value"))
    return reshape.order_by_measure(out, "pct_value", ["county", "stem"])


# ------------------------------------------------------------- catalogue

CATALOG_CONCEPT, CATALOG_LABEL = "Brand#2", "ECONOMY"


def select_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables picked from a catalogue by concept and label, their
    estimate (E) and margin (M) rows fetched from a long estimates table and
    summed per variable (A8).  Catalogue: one variable per part; estimates:
    one E and one M row per line item.  The stand-in catalogue grows with
    the data, so the selection is not forced to broadcast."""
    catalog = S.table(spark, sf_dir, "part").select(
        F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_type").alias("label"), F.col("p_brand").alias("concept"))
    li = S.table(spark, sf_dir, "lineitem")
    stem = F.concat(F.lit("V"), F.col("l_partkey").cast("string"))
    estimates = li.select(F.inline(F.array(
        F.struct(F.concat(stem, F.lit("E")).alias("variable"), F.col("l_quantity").alias("estimate")),
        F.struct(F.concat(stem, F.lit("M")).alias("variable"),
                 F.col("l_linenumber").cast("double").alias("estimate")))))
    chosen = readers.select_variables(catalog, estimates, CATALOG_CONCEPT, CATALOG_LABEL)
    return chosen.groupBy("variable").agg(F.sum("estimate").alias("value"), F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------- text feeds

MICRODATA = "SERIALNO STRING, PUMA10 STRING, PUMA20 STRING, AGEP INT, POVPIP DOUBLE"
AREA_CODE = "7"


def microdata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as lines of a microdata file: codes with leading zeros, each
    vintage's area blank in the other's rows, a ratio that isn't always a number."""
    li = S.table(spark, sf_dir, "lineitem")
    area = F.lpad((F.col("l_suppkey") % 100 + 3600).cast("string"), 5, "0")
    early = F.col("l_linenumber") % 2 == 0
    blank = F.lit("")
    return li.select(F.concat_ws(
        ",", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.when(early, area).otherwise(blank), F.when(early, blank).otherwise(area),
        F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_tax") != 0, F.col("l_partkey").cast("string")).otherwise(F.lit("n/a"))).alias("line"))


def microdata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines parsed, the areas that hold the code in either vintage's
    column, persons and ratios by area."""
    people = readers.parse_rows(microdata_lines(spark, sf_dir), "line", MICRODATA)
    return households.in_area(people, ["PUMA10", "PUMA20"], AREA_CODE).groupBy(F.coalesce("PUMA10", "PUMA20").alias("puma")).agg(
        F.count(F.lit(1)).alias("persons"), F.min("SERIALNO").alias("first_serial"), F.sum("AGEP").alias("ages"),
        F.count("POVPIP").alias("with_ratio"), F.sum("POVPIP").alias("ratios"))


LEVELS = ("HOUSEHOLD", "BUILDING", "AUTOMOBILE")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by nation and segment, labels pasted with a missing
    segment as text, names cleaned, everything text, in the order of given levels."""
    c = S.table(spark, sf_dir, "customer")
    n = F.broadcast(S.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))   # 25 rows by construction
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(
        paste("n_name", segment, sep=": ", na_as_text=True).alias("Label Text"), segment.alias("Market Segment")).agg(
        F.count(F.lit(1)).alias("No. of Accounts"))
    clean = clean_names(rows).withColumn("level", level_order("market_segment", LEVELS))
    return cast_all_text(clean.orderBy("level", "label_text"))
