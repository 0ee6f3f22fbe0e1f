"""Text feeds on the stand-in tables: a register with junk, two vintages of microdata, numbered areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.functions.scalars import strict_sum
from indicata.operators import households as hh
from indicata.operators import numbering, recode, survey
from indicata.operators import crosswalk as X
from indicata.plans import pums
from indicata.plans import register_queries as RQ
from indicata.plans import spatial_queries as SPQ
from indicata.plans import standins as S
from indicata.plans import survey_queries as SQ
from indicata.sources import quarantine as Q
from indicata.sources import decoding, readers, sinks, staging, vintages

# Fixed values of the stand-in register's text (shared with the SQL oracle): its header, of which the
# first columns are read, and the keys whose line or field is junk (divisible by the number).
HEADER = ("Facility Type,Facility Number,Facility Name,Facility Zip,Facility Capacity,Facility Status,License First Date,"
          "Regional Office,File Date")
N_COLS = 7
EMPTY, OPEN_QUOTE, CUT, SHIFTED = 43, 31, 23, 29
NO_CAPACITY, SEATS_TEXT, NEGATIVE, BAD_STATUS, NO_ZIP, BAD_DATE, QUOTED = 13, 17, 47, 37, 41, 19, 7
ZIPS = 40
REQUESTED = 30
MOST_SEATS = 500

FIELDS = [Q.Field("facility_number", "bigint", required=True), Q.Field("facility_zip", required=True),
          Q.Field("facility_capacity", "double", least=0, most=MOST_SEATS),
          Q.Field("facility_status", known=("CLOSED", "PENDING", RQ.LICENSED)), Q.Field("license_first_date", "date")]


def register_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register as lines of text, numbered, the header first."""
    o = S.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def by(n: int):
        return k % n == 0

    kind = F.when(F.col("o_orderpriority").isin(*RQ.CENTER_PRIORITIES), RQ.CENTER).otherwise(RQ.HOME)
    number = k.cast("string")
    name = (F.when(by(OPEN_QUOTE), F.concat(F.lit('"Facility '), number)).when(by(SHIFTED), F.concat(F.lit("Facility "), number, F.lit(", Inc")))
            .when(by(QUOTED), F.concat(F.lit('"The ""Facility"", '), number, F.lit('"'))).otherwise(F.concat(F.lit("Facility "), number)))
    zip_code = F.when(by(NO_ZIP), "").otherwise((F.col("o_custkey") % ZIPS + 90000).cast("string"))
    seats = F.floor(F.col("o_totalprice") / 1000).cast("string")
    capacity = F.when(by(NO_CAPACITY), "n/a").when(by(SEATS_TEXT), F.concat(seats, F.lit(" seats"))).when(by(NEGATIVE), F.concat(F.lit("-"), seats)).otherwise(seats)
    status = F.when(by(BAD_STATUS), "UNKNOWN").otherwise(recode.relabel("o_orderstatus", RQ.STATUS_BY_CODE))
    date = F.when(by(BAD_DATE), "13/45/2019").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    first = F.concat_ws(",", kind, number, name, zip_code, capacity)
    whole = F.concat_ws(",", first, status, date, F.lit("East"), F.lit("1/19/2025"))
    line = F.when(by(EMPTY), "").when(by(CUT) & ~by(OPEN_QUOTE), first).otherwise(whole)
    rows = o.select((k + 1).alias("line_no"), line.alias("line"))
    return spark.range(1).select(F.lit(0).cast("long").alias("line_no"), F.lit(HEADER).alias("line")).unionByName(rows)


def parsed_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line promoted to names, the first columns typed, what doesn't fit told."""
    lines = register_lines(spark, sf_dir)
    header = Q.promote_header(lines, "line", "line_no")
    rows = lines.filter(~F.col("line").eqNullSafe(F.lit(header)))
    return Q.parse_lines(rows, "line", Q.header_names(header), FIELDS, N_COLS, keep=["line_no"])


def register_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensed facilities of the requested areas by area, from the text: how many, their
    capacity as published (missing as soon as one of them is junk), what is known of it, and how many
    of the capacities were rejected."""
    asked = S.table(spark, sf_dir, "customer").select((F.col("c_custkey") % REQUESTED + 90000).cast("string").alias("area")).distinct()
    rows = parsed_register(spark, sf_dir).withColumn("_junk", F.exists(Q.REJECTS, lambda x: x["field"] == "facility_capacity"))
    rows = Q.published_rows(rows).filter(F.col("facility_status") == RQ.LICENSED)
    rows = rows.join(asked, F.col("facility_zip") == F.col("area"), "left_semi")
    return rows.groupBy("facility_zip").agg(
        F.count(F.lit(1)).alias(RQ.CENTER_COLUMNS[0]), strict_sum("facility_capacity").alias(RQ.CENTER_COLUMNS[1]),
        F.sum("facility_capacity").alias("capacity_known"), F.count_if("_junk").alias("capacity_rejected"),
        F.date_format(F.min("license_first_date"), "yyyy-MM-dd").alias("first_license"))


def register_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, the typed and the rejected ones, and the rejects by field and reason."""
    return Q.quarantine_report(parsed_register(spark, sf_dir))


# ------------------------------------------------------------- two vintages

# Fixed values of the two vintages: area codes under one name in the early file, under another in the late.
COMMON = "SERIALNO STRING, PUMA10 STRING, PUMA20 STRING, SPORDER INT, AGEP INT, POVPIP DOUBLE"
EARLY, LATE = "2018-2021", "2022"
AREA = "037"
TWO_VINTAGE_CUT = 138.0


def _area_of(key: Column) -> Column:
    """An area code by household, with a leading zero."""
    return F.lpad((key % 100 + 3650).cast("string"), 5, "0")


def vintage_lines(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """One vintage's person file as lines: serial, area, order, age, ratio (not always a number); the late
    one ends with a column that the early one lacks."""
    li = S.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    ratio = F.when(F.col("l_tax") != 0, F.col("l_partkey").cast("string")).otherwise("")
    cells = [F.lpad(k.cast("string"), 9, "0"), _area_of(k), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), ratio]
    return li.filter(k % 2 == int(late)).select(F.concat_ws(",", *cells, *([F.lit("x")] if late else [])).alias("line"))


def two_vintage_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files, each under its own columns, as one."""
    early = readers.parse_rows(vintage_lines(spark, sf_dir, False), "line", "SERIALNO STRING, PUMA STRING, SPORDER INT, AGEP INT, POVPIP DOUBLE")
    late = readers.parse_rows(vintage_lines(spark, sf_dir, True), "line", "SERIALNO STRING, PUMA20 STRING, SPORDER INT, AGEP INT, POVPIP DOUBLE, NOTE STRING")
    return vintages.reconcile({EARLY: early, LATE: late}, COMMON, renames={EARLY: {"PUMA": "PUMA10"}}, ignored={LATE: ["NOTE"]})


def two_vintage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 C2 D1 F1 E1-E5 over two vintages at the 138 % cut: persons of the area by either code column,
    joined to their households by serial and both code columns (a code that a vintage lacks is null on
    both sides), the first child under 5 for the household, rates by vintage."""
    o = S.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    homes = o.select(F.lpad(k.cast("string"), 9, "0").alias("SERIALNO"), F.when(k % 2 == 0, _area_of(k)).alias("PUMA10"),
                     F.when(k % 2 == 1, _area_of(k)).alias("PUMA20"), k.alias("key"),
                     F.when(F.col("o_orderstatus") != S.VACANT_STATUS, k % S.HOUSEHOLD_WEIGHT_MOD + 1).alias("WGTP"))
    people = hh.in_area(two_vintage_people(spark, sf_dir), ["PUMA20", "PUMA10"], AREA)
    eligible = hh.eligible_households(
        people, homes, serial="SERIALNO", join_keys=["SERIALNO", "PUMA10", "PUMA20"], order=["SPORDER", "AGEP", "POVPIP"], universe="POVPIP",
        weight="WGTP", person_filter=F.col("AGEP") < 5, keep=["POVPIP", "vintage"])
    rows = S.add_household_replicates(eligible, "key").withColumn("indicator", hh.threshold("POVPIP", TWO_VINTAGE_CUT, SQ.AT_OR_BELOW, SQ.ABOVE))
    return survey.survey_rate(rows, S.HH_DESIGN, ["vintage"], "indicator")


# ------------------------------------------------------------- published runs on their own columns

COUNTY, COUNTY_CUTS = "06037", (100.0, 138.0)
PLANNING_AREAS = 8


def _microdata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Person and household files with the columns of the public-use microdata."""
    people = S.persons(spark, sf_dir).withColumns({"SPORDER": F.col("l_linenumber"), "PUMA": _area_of(F.col("SERIALNO"))})
    housing = S.add_household_replicates(S.households(spark, sf_dir)).withColumn("PUMA", _area_of(F.col("SERIALNO")))
    return people, housing.select("SERIALNO", "PUMA", *S.HH_DESIGN.columns)


def published_county_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county runs at both cuts and for both populations."""
    return pums.county_runs(*_microdata(spark, sf_dir), AREA, COUNTY, COUNTY_CUTS, key=S.person_key())


def published_area_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planning-area run through a many-to-many crosswalk of area codes: a code ending in 0 is in two areas."""
    people, housing = _microdata(spark, sf_dir)
    codes = housing.select("PUMA").distinct()
    number = F.col("PUMA").cast("int")
    areas = F.array((number % PLANNING_AREAS).cast("string"), F.when(number % 10 == 0, ((number + 1) % PLANNING_AREAS).cast("string")))
    xwalk = codes.select("PUMA", F.explode(areas).alias("SPA")).filter(F.col("SPA").isNotNull())
    return pums.area_run(people.withColumn("SPORDER", S.person_key()), housing, xwalk, AREA)


# ------------------------------------------------------------- sinks

SINK_KEYS = ["geography", "year"]
EXTRACT_YEAR = "1998"
EXTRACT = "facility_name STRING, county_name STRING, facility_capacity INT, closed_date_text STRING"


def indicator_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: monthly closures written into a table partitioned by geography and year, the first year alone, then
    both, then both again, which writes nothing; read back with each partition's rows as its manifest tells them."""
    monthly = RQ.closures_by_month(spark, sf_dir)
    path = staging.new_folder(spark, "indicator")
    sinks.write_partitions(monthly.filter(F.col("year") == RQ.YEARS[0]), path, SINK_KEYS)
    for _ in range(2):
        sinks.write_partitions(monthly, path, SINK_KEYS)
    told = sinks.read_manifest(spark, path, monthly.schema, SINK_KEYS).select(*[F.col(k).alias(f"_{k}") for k in SINK_KEYS], F.col("rows").alias("partition_rows"))
    back = sinks.read_partitions(spark, path, monthly.schema)
    return back.join(told, (F.col("geography") == F.col("_geography")) & (F.col("year") == F.col("_year"))).drop("_geography", "_year")


def closures_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one year's closures handed to another process as text, and what that reads."""
    closed = RQ.prepared_register(spark, sf_dir, (EXTRACT_YEAR,)).filter(F.col("open") == 0)
    path = staging.new_folder(spark, "extract")
    sinks.write_extract(closed.select("facility_name", "county_name", "facility_capacity", "closed_date_text", "year"), F.col("year") == EXTRACT_YEAR, path)
    return readers.read_microdata(spark, path, schema=T.StructType.fromDDL(EXTRACT + ", year STRING")).drop("year")


# ------------------------------------------------------------- encodings

# Fixed values of the encoded code list: by key, the encoding of its line, and keys of malformed lines.
ENCODINGS = 5
BAD_8, BAD_16 = 11, 13


def encoded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code list's lines (key; description, with a letter beyond ASCII) as bytes in five encodings."""
    k = F.col("p_partkey")
    text = F.concat_ws(";", k.cast("string"), F.concat(F.col("p_type"), F.lit(" é€ü")))
    western = F.concat(F.encode(F.concat_ws(";", k.cast("string"), F.concat(F.col("p_type"), F.lit(" é"))), "ISO-8859-1"), F.lit(b"\x80\xfc"))
    kind = k % ENCODINGS
    line = (F.when(k % BAD_8 == 0, F.concat(F.lit(decoding.MARK_8), F.encode(text, "UTF-8"), F.lit(b"\xc3(")))
            .when(k % BAD_16 == 0, F.concat(F.lit(decoding.MARK_LE), F.encode(text, "UTF-16LE"), F.lit(b"\x41")))
            .when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.concat(F.lit(decoding.MARK_8), F.encode(text, "UTF-8")))
            .when(kind == 2, F.concat(F.lit(decoding.MARK_LE), F.encode(text, "UTF-16LE")))
            .when(kind == 3, F.concat(F.lit(decoding.MARK_BE), F.encode(text, "UTF-16BE"))).otherwise(western))
    return S.table(spark, sf_dir, "part").select(line.alias("line"))


def decoded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by encoding and whether they are text in it, with the codes and descriptions read from them."""
    rows = decoding.decode_column(encoded_codes(spark, sf_dir), "line")
    cells = F.split("text", ";")
    return rows.groupBy("encoding", "malformed").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(cells[0].cast("bigint")).alias("codes"), F.min(cells[1]).alias("first_description"),
        F.max(cells[1]).alias("last_description"))


# ------------------------------------------------------------- row ids

def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas numbered 1 to n in the order of their names, and the centroids, taken as a frame of
    their own and numbered likewise, attached by that number."""
    areas = SPQ.pumas(spark, sf_dir)
    cx, cy = X.ring_centroid()
    points = areas.select("NAMELSAD20", "PUMA", F.round(cx, SPQ.DIGITS).alias("cx"), F.round(cy, SPQ.DIGITS).alias("cy"))
    return numbering.attach_by_row_id(areas.select("NAMELSAD20", "PUMA"), points, ["NAMELSAD20", "PUMA"])
