"""Quarantined text feeds, vintages, row ids, packed order keys, indicators in one pass, the interior cover."""

import random

import pytest
from pyspark.sql import functions as F

from indicata.operators import crosswalk as X
from indicata.operators import households as H
from indicata.operators import numbering, series, survey
from indicata.operators.survey import ReplicateDesign
from indicata.plans import feed_queries as FQ
from indicata.plans import report_queries as RP
from indicata.plans import spatial_queries as SPQ
from indicata.plans import survey_queries as SQ
from indicata.sources import quarantine as Q
from indicata.sources import vintages as V

SF = "/root/testdata/sf0.001"
FIELDS = [Q.Field("facility_zip", required=True), Q.Field("facility_capacity", "double", least=0, most=100), Q.Field("closed_date", "date"),
          Q.Field("facility_status", known=("LICENSED", "CLOSED"))]
HEADER = ["facility_zip", "facility_capacity", "closed_date", "facility_status", "extra"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table):
    return len([line for line in plan_of(df).split("\n") if "FileScan" in line and f"/{table}.parquet" in line])


# ---- quarantine -----------------------------------------------------------

LINES = [
    ("90001,12,1/7/2020,LICENSED,x", (("90001", 12.0, "2020-01-07", "LICENSED"), [])),
    ('"90002"," 7 ",12/31/2021,CLOSED,"a, ""b"""', (("90002", 7.0, "2021-12-31", "CLOSED"), [])),
    ("90003,,,,", (("90003", None, None, None), [])),
    (",12,1/7/2020,LICENSED,x", ((None, 12.0, "2020-01-07", "LICENSED"), [("facility_zip", "missing")])),
    ("90004,n/a,13/45/2019,OPEN,x", (("90004", None, None, None), [("facility_capacity", "not a number"), ("closed_date", "not a date"), ("facility_status", "unknown value")])),
    ("90005,-1,1/7/2020,CLOSED,x", (("90005", None, "2020-01-07", "CLOSED"), [("facility_capacity", "out of range")])),
    ("90006,101,1/7/2020,CLOSED,x", (("90006", None, "2020-01-07", "CLOSED"), [("facility_capacity", "out of range")])),
    ("90007,5", ((None,) * 4, [("(line)", "too few fields")])),
    ("90008,5,1/7/2020,CLOSED,x,y", ((None,) * 4, [("(line)", "too many fields")])),
    ('90009,5,1/7/2020,CLOSED,"x', ((None,) * 4, [("(line)", "open quote")])),
    ("", ((None,) * 4, [("(line)", "empty line")])),
    ("   ", ((None,) * 4, [("(line)", "empty line")])),
    (None, ((None,) * 4, [("(line)", "empty line")])),
]


def test_every_line_is_typed_or_told(spark):
    lines = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(LINES)], "at int, line string")
    parsed = Q.parse_lines(lines, "line", HEADER, FIELDS, n_cols=4, keep=["at"])
    assert parsed.columns == ["at", *HEADER[:4], "_rejects"]
    for r in parsed.collect():
        values, reasons = LINES[r.at][1]
        assert (r.facility_zip, r.facility_capacity, r.closed_date and r.closed_date.isoformat(), r.facility_status) == values, r.at
        assert [(x.field, x.reason) for x in r._rejects] == reasons, r.at
    typed, told = Q.typed_rows(parsed), Q.rejects(parsed, ["at"])
    assert {r.at for r in typed.collect()} == {0, 1, 2}
    assert {r.at for r in told.collect()} == set(range(3, len(LINES)))
    assert {r.at for r in Q.published_rows(parsed).collect()} == set(range(7))
    assert told.filter("at = 4 and field = 'facility_capacity'").first().text == "n/a"
    counts = {(r.field, r.reason): r.lines for r in Q.quarantine_report(parsed).collect()}
    assert (counts["(all)", None], counts["(typed)", None], counts["(rejected)", None]) == (len(LINES), 3, len(LINES) - 3)
    assert counts["(line)", "empty line"] == 3 and counts["facility_capacity", "out of range"] == 2
    assert Q.quarantine_report(parsed.filter("false")).collect() == []


def test_a_line_is_parsed_once_whatever_is_asked_of_it(spark):
    lines = spark.createDataFrame([(text,) for text, _ in LINES], "line string")
    parsed = Q.published_rows(Q.parse_lines(lines, "line", HEADER, FIELDS, n_cols=4).withColumn("junk", F.size("_rejects") > 0))
    asked = parsed.filter("facility_status = 'LICENSED' and facility_zip > '9' and not junk")
    assert plan_of(asked).count("from_csv(") == 1 and plan_of(asked).count("try_to_date") <= 1
    assert [tuple(r)[:2] for r in asked.collect()] == [("90001", 12.0)]


def test_register_file_with_header_in_each_part(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"part{k}.csv").write_text("﻿Facility Zip,Facility Capacity,Closed Date,Facility Status,Facility Status\n"
                                               f"9000{k},1{k},1/7/2020,LICENSED,x\n9000{k},n/a,,CLOSED,\n", encoding="utf-8")
    got = Q.read_register_quarantined(spark, str(tmp_path), FIELDS, n_cols=4)
    assert sorted((r.facility_zip, r.facility_capacity) for r in Q.typed_rows(got).collect()) == [("90000", 10.0), ("90001", 11.0)]
    assert sorted((r.field, r.reason, r.lines) for r in Q.quarantine_report(got).filter("reason is not null").collect()) == [("facility_capacity", "not a number", 2)]
    assert Q.header_names("Facility Zip,2 Wide,Facility.Zip") == ["facility_zip", "x2_wide", "facility_zip_2"]


def test_fields_of_a_schema_and_unknown_fields(spark):
    lines = spark.createDataFrame([("007,4,x",), ("008,five,1.5",)], "line string")
    parsed = Q.parse_lines(lines, "line", ["SERIALNO", "AGEP", "POVPIP"], Q.fields_of("SERIALNO STRING, AGEP INT, POVPIP DOUBLE"))
    assert sorted((r.SERIALNO, r.AGEP, r.POVPIP, [x.field for x in r._rejects]) for r in parsed.collect()) == [
        ("007", 4, None, ["POVPIP"]), ("008", None, 1.5, ["AGEP"])]
    with pytest.raises(ValueError, match="AGE"):
        Q.parse_lines(lines, "line", ["SERIALNO"], [Q.Field("AGE")])


def test_register_queries_read_the_orders_once(spark):
    for query in (FQ.register_text, FQ.register_rejects):
        assert scans(query(spark, SF), "orders") == 1
    report = {(r.field, r.reason): r.lines for r in FQ.register_rejects(spark, SF).collect()}
    assert report["(all)", None] == report["(typed)", None] + report["(rejected)", None]
    assert min(report.values()) > 0 and len(report) == 12


# ---- vintages -------------------------------------------------------------

def test_vintages_under_one_schema(spark):
    early = spark.createDataFrame([("1", "03701", 4)], "SERIALNO string, PUMA string, AGEP int")
    late = spark.createDataFrame([("2", "03702", 3, "x")], "SERIALNO string, PUMA20 string, AGEP int, NOTE string")
    schema = "SERIALNO STRING, PUMA10 STRING, PUMA20 STRING, AGEP BIGINT"
    got = V.reconcile({"a": early, "b": late}, schema, {"a": {"PUMA": "PUMA10"}}, {"b": ["NOTE"]})
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "03701", None, 4, "a"), ("2", None, "03702", 3, "b")]
    assert got.columns == ["SERIALNO", "PUMA10", "PUMA20", "AGEP", "vintage"]
    # a filter on the vintage prunes the other one's branch
    assert plan_of(got.filter("vintage = 'a'")).count("LocalTableScan") + plan_of(got.filter("vintage = 'a'")).count("Scan ExistingRDD") == 1


@pytest.mark.parametrize("columns, renames, ignored, said", [
    ("SERIALNO string, PUMA string, PUMA10 string", {"PUMA": "PUMA10"}, (), "both PUMA10"),
    ("SERIALNO string, OTHER string", {}, (), "neither common nor ignored"),
    ("SERIALNO string", {"PUMA": "PUMA10"}, (), "no column PUMA"),
    ("SERIALNO string, PUMA string", {"PUMA": "AREA"}, (), "isn't common"),
    ("SERIALNO bigint", {}, (), "SERIALNO is bigint"),
    ("NOTE string", {}, ("NOTE",), "no common column")])
def test_vintage_conflicts_are_raised(spark, columns, renames, ignored, said):
    frame = spark.createDataFrame([], columns)
    with pytest.raises(V.VintageConflict, match=said):
        V.reconcile({"a": frame}, "SERIALNO STRING, PUMA10 STRING", {"a": renames}, {"a": ignored})


def test_two_vintage_households_match_by_null_area_codes(spark):
    people = FQ.two_vintage_people(spark, SF)
    assert people.filter("(PUMA10 is null) = (PUMA20 is null)").count() == 0
    assert {r.vintage for r in FQ.two_vintage_run(spark, SF).collect()} == {FQ.EARLY, FQ.LATE}


# ---- row ids --------------------------------------------------------------

def test_dense_row_ids(spark):
    rng = random.Random(4)
    # one key holds a third of the rows; nulls come first
    rows = [("hot" if k % 3 == 0 else None if k % 50 == 1 else f"k{rng.randrange(500)}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "name string, at long").repartition(9)
    got = numbering.dense_row_ids(df, ["name", "at"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["name"], r["at"]) for r in sorted(got, key=lambda r: r["id"])] == want
    assert sorted(r["id"] for r in got) == list(range(1, 3001))
    assert numbering.dense_row_ids(df.filter("false"), ["name", "at"]).collect() == []
    assert numbering.dense_row_ids(df.limit(1), ["at"], first=0).first()["id"] == 0
    with pytest.raises(ValueError, match="already"):
        numbering.dense_row_ids(df, ["name"], "at")


def test_frames_attached_by_row_id(spark):
    a = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "name string, v int")
    b = spark.createDataFrame([("y", 20.0), ("x", 10.0)], "name string, x double")
    got = numbering.attach_by_row_id(a, b, ["name"])
    assert sorted(map(tuple, got.select("id", "name", "v", "x").collect())) == [(1, "a", 1, 10.0), (2, "b", 2, 20.0), (3, "c", 3, None)]


# ---- first person ---------------------------------------------------------

@pytest.mark.parametrize("bits", [(5, 10), (5, 40, 40), (6, 60, 60)])
def test_order_key_sorts_like_its_columns(spark, bits):
    rng = random.Random(sum(bits))
    rows = [tuple(None if rng.random() < 0.1 else rng.choice([0, 1, (1 << b) - 2, rng.randrange((1 << b) - 1)]) for b in bits) for _ in range(300)]
    names = [f"c{k}" for k in range(len(bits))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    got = [tuple(r)[:len(bits)] for r in sorted(df.withColumn("key", H.order_key(list(zip(names, bits)))).collect(), key=lambda r: r["key"])]
    assert got == sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


def test_order_key_raises_what_does_not_fit(spark):
    df = spark.createDataFrame([(31,)], "a long")
    with pytest.raises(Exception, match="doesn't fit 5 bits"):
        df.select(H.order_key([("a", 5)])).collect()
    with pytest.raises(Exception, match="doesn't fit 5 bits"):
        df.select(H.order_key([(-F.col("a"), 5)])).collect()
    with pytest.raises(ValueError, match="126"):
        H.order_key([("a", 64), ("a", 63)])


def test_first_by_key_equals_first_per(spark):
    rng = random.Random(8)
    rows = [(0 if k % 3 == 0 else rng.randrange(400), rng.randrange(1, 6), rng.randrange(50), None if rng.random() < 0.1 else rng.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "s long, o int, age int, v double").withColumn("o2", F.monotonically_increasing_id() % 1000)
    runs = {"young": F.col("age") < 5, "all": None}
    got = {(r["population"], r["s"]): r["v"] for r in H.first_by_key(df, ["s"], H.order_key([("o", 4), ("age", 8), ("o2", 12)]), ["v"], runs).collect()}
    for label, cond in runs.items():
        own = H.first_per(df.filter(cond) if cond is not None else df, ["s"], ["o", "age", "o2"], keep=["v"])
        assert {s: v for (p, s), v in got.items() if p == label} == {r["s"]: r["v"] for r in own.collect()}
    with pytest.raises(ValueError, match="varying width"):
        H.first_by_key(df.withColumn("t", F.lit("x")), ["s"], H.order_key([("o", 4)]), ["t"])


def test_poverty_by_area_sorts_and_copies_no_person(spark):
    for query in (SQ.poverty_by_area, SQ.poverty_runs):
        plan = plan_of(query(spark, SF))
        assert "SortAggregate" not in plan
        # the populations are told apart after the pick: nothing is generated below the first exchange
        lowest = plan[plan.rindex("partial_min"):]
        assert "Generate" not in lowest and lowest.count("lineitem.parquet") == 1


# ---- indicators in one pass -----------------------------------------------

def test_headline_reads_persons_once_for_both_household_indicators(spark):
    assert scans(SQ.household_indicators(spark, SF), "lineitem") == 1
    assert scans(RP.indicator_frames(spark, SF), "lineitem") == 1
    assert scans(RP.headline(spark, SF), "lineitem") == 2      # the other one: the children's counts, of all persons


def test_indicators_in_one_pass_equal_single_runs(spark):
    rng = random.Random(5)
    rows = [(rng.choice("AB"), rng.choice(["x", "y", None]), rng.choice(["p", "q"]), rng.choice(["yes", "no", None]), rng.choice(["hi", "lo"]),
             rng.randrange(0, 9), rng.randrange(-2, 9), rng.randrange(0, 9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "geo string, d1 string, d2 string, i1 string, i2 string, w long, w1 long, w2 long")
    design, dims = ReplicateDesign("w", ("w1", "w2")), {"d1": "d1", "d2": "d2"}
    both = survey.survey_indicators_breakdown(df, design, ["geo"], dims, {"one": "i1", "two": "i2"})
    for measure, column in (("one", "i1"), ("two", "i2")):
        single = survey.survey_breakdown(df, design, ["geo"], dims, column).withColumnRenamed(column, "level")
        mine = both.filter(F.col("measure") == measure).select(single.columns)
        assert sorted(map(repr, map(tuple, mine.collect()))) == sorted(map(repr, map(tuple, single.collect())))


# ---- imputation -----------------------------------------------------------

def test_impute_gap_of_adjacent_periods_only(spark):
    rows = [(1, 2018, 2.0), (1, 2019, 4.0), (1, 2021, 8.0), (1, 2024, 9.0), (2, 2018, None), (2, 2020, 6.0)]
    df = spark.createDataFrame(rows, "k int, year int, v double")
    got = {(r.k, r.year): (r.v, r.imputed) for r in series.impute_gap(df, ["k"], "year", "v", adjacent=True).collect()}
    assert got[1, 2020] == (6.0, True)
    assert got[1, 2022] == got[1, 2023] == got[2, 2019] == (None, False)


# ---- interior cover -------------------------------------------------------

def squares(spark, n, side=1.0):
    rows = [(x * n + y, [x * side, (x + 1) * side, (x + 1) * side, x * side], [y * side, y * side, (y + 1) * side, (y + 1) * side]) for x in range(n) for y in range(n)]
    return spark.createDataFrame(rows, "u long, xs array<double>, ys array<double>")


def clipped_pairs(spark, n):
    """(pairs, pairs that have to be clipped) of n x n unit squares in a diamond."""
    half = n / 2
    large = spark.createDataFrame([("d", [half, float(n), half, 0.0], [0.0, half, float(n), half])], "l string, xs array<double>, ys array<double>")
    units = X.with_level(X.with_bbox(squares(spark, n)), 1.0)
    top = X.top_level(units, X.with_level(X.with_bbox(large), 1.0))
    met = X.matched(X.entered(units, 1.0, top), X.cover(large, 1.0, top, ["l"]))
    row = met.agg(F.count("*").alias("n"), F.count_if(~F.col("_c_inside")).alias("clipped"), F.count_distinct("u").alias("units")).first()
    assert row.n == row.units
    return row.n, row.clipped


def test_clips_grow_with_the_border(spark):
    small, large = clipped_pairs(spark, 16), clipped_pairs(spark, 48)
    assert large[0] > 7 * small[0]              # nine times the area
    assert large[1] < 4 * small[1]              # three times the border


def test_cover_and_present_areas_agree(spark):
    """Random concave outlines with holes against exact clipping of every pair."""
    rng = random.Random(2)
    units = squares(spark, 12, 1.0)

    def star(cx, cy, r, k):
        import math
        pts = [(cx + r * (0.35 + 0.65 * rng.random()) * math.cos(2 * math.pi * i / k), cy + r * (0.35 + 0.65 * rng.random()) * math.sin(2 * math.pi * i / k)) for i in range(k)]
        return [p[0] for p in pts], [p[1] for p in pts]

    rings = [(name, sign, *star(cx, cy, r, 11)) for name, cx, cy, r, hole in (("a", 4.0, 4.0, 5.0, 1.0), ("b", 8.0, 7.0, 6.0, 1.2), ("c", 6.0, 6.0, 30.0, 2.0))
             for sign, r in ((1.0, r), (-1.0, hole * 0.3))]
    large = spark.createDataFrame(rings, "l string, sign double, xs array<double>, ys array<double>")
    got = {(r.u, r.l): r.prc_small_area for r in X.build_crosswalk(units, large, min_share=1e-9).collect()}
    both = units.crossJoin(large.select("l", "sign", F.col("xs").alias("lx"), F.col("ys").alias("ly")))
    exact = both.select("u", "l", (F.col("sign") * X.overlap_area_expr([("xs", "ys"), ("lx", "ly")])).alias("a")).groupBy("u", "l").agg(F.sum("a").alias("a"))
    want = {(r.u, r.l): r.a for r in exact.collect() if r.a > 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_crosswalk_reads_each_layer_once(spark):
    """Units, strips, outline and the names of two layers: customer three times, region once."""
    plan = SPQ.overlay_crosswalk(spark, SF)
    assert scans(plan, "customer") == 3 and scans(plan, "region") == 1
    assert plan_of(plan).count("BroadcastNestedLoopJoin") == 0


# ---- sinks ----------------------------------------------------------------

def files_below(path):
    import os
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_rerun_of_the_sink_changes_nothing(spark, tmp_path):
    from indicata.sources import sinks
    schema, keys, path = "geo string, year string, v long", ["geo", "year"], str(tmp_path / "table")
    first = spark.createDataFrame([("a", "2019", 1), ("a", "2019", 1), ("b", "2019", 2), (None, "2019", 3), ("007", "2019", 7)], schema)
    assert sinks.write_partitions(first, path, keys) == 4
    before = files_below(path)
    assert sinks.write_partitions(first.repartition(3), path, keys) == 0 and files_below(path) == before
    # another year beside it, one partition changed (a repeated row goes), the rest as it was
    second = spark.createDataFrame([("a", "2019", 1), ("b", "2019", 2), ("a", "2020", 4)], schema)
    assert sinks.write_partitions(second, path, keys) == 2
    back = sinks.read_partitions(spark, path, first.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("a", "2019", 1), ("b", "2019", 2), (None, "2019", 3), ("007", "2019", 7), ("a", "2020", 4)], key=str)
    assert {k: v for k, v in files_below(path).items() if "geo=b" in k or "007" in k} == {k: v for k, v in before.items() if "geo=b" in k or "007" in k}
    told = {(r.geo, r.year): r.rows for r in sinks.read_manifest(spark, path, first.schema, keys).collect()}
    assert told == {("a", "2019"): 1, ("b", "2019"): 1, (None, "2019"): 1, ("007", "2019"): 1, ("a", "2020"): 1}
    assert sinks.broken_partitions(spark, path, first.schema, keys).count() == 0
    assert sinks.write_partitions(first.filter("false"), path, keys) == 0


def test_a_broken_run_is_seen_and_made_good(spark, tmp_path):
    from indicata.sources import sinks
    schema, keys, path = "geo string, year int, v double", ["geo", "year"], str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 2019, 1.5), ("b", 2019, 2.5)], schema)
    sinks.write_partitions(rows, path, keys)
    # a run that wrote its data and no manifest: the partition is told as broken, and written again
    other = spark.createDataFrame([("a", 2019, 9.0)], schema)
    other.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/data")
    assert [tuple(r) for r in sinks.broken_partitions(spark, path, rows.schema, keys).collect()] == [("a", 2019)]
    assert sinks.write_partitions(other, path, keys) == 1
    assert sinks.broken_partitions(spark, path, rows.schema, keys).count() == 0
    assert sorted(r.v for r in sinks.read_partitions(spark, path, rows.schema).collect()) == [2.5, 9.0]


# ---- stored weights -------------------------------------------------------

def test_stored_weights_cross_joins_as_one_field(spark):
    packed, wide = SQ.stored_weights_packed(spark, SF), SQ.stored_weights_wide(spark, SF)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, wide.collect()))
    plan = plan_of(packed)
    assert "weights#" in plan and "WGTP1#" not in plan and "WGTP1#" in plan_of(wide)


def test_stored_design_equals_columns(spark):
    rows = [("a", 1, 2, 3), ("a", 4, 0, -1), ("b", 5, 5, 5), ("b", None, None, None)]
    df = spark.createDataFrame(rows, "g string, w long, w1 long, w2 long").withColumn("all", F.array("w", "w1", "w2"))
    one = survey.survey_total(df, ReplicateDesign("w", ("w1", "w2")), ["g"]).collect()
    assert sorted(map(tuple, survey.survey_total(df, ReplicateDesign.stored("all", 2), ["g"]).collect())) == sorted(map(tuple, one))


# ---- decoding -------------------------------------------------------------

@pytest.mark.parametrize("data, text, encoding, malformed", [
    (None, None, None, None), (b"", "", "utf-8", False), (b"plain", "plain", "utf-8", False), ("é€ü".encode(), "é€ü", "utf-8", False),
    (b"\xef\xbb\xbf" + "Jahr é".encode(), "Jahr é", "utf-8 mark", False), (b"\xef\xbb\xbf\xc3(", None, "utf-8 mark", True), (b"\xef\xbb\xbf", "", "utf-8 mark", False),
    (b"\xff\xfe" + "é𝄞x".encode("utf-16le"), "é𝄞x", "utf-16le", False), (b"\xfe\xff" + "é𝄞x".encode("utf-16be"), "é𝄞x", "utf-16be", False),
    (b"\xff\xfea", None, "utf-16le", True), (b"\xff\xfe\x00\xd8a\x00", None, "utf-16le", True), (b"\xfe\xff\xdc\x00", None, "utf-16be", True),
    ("no mark".encode("utf-16le"), "no mark", "utf-16le", False), ("no mark".encode("utf-16be"), "no mark", "utf-16be", False),
    ("é€ü“”".encode("cp1252"), "é€ü“”", "windows-1252", False), (b"\xe9\x81", None, "windows-1252", True)])
def test_encodings_are_found_from_the_bytes(spark, data, text, encoding, malformed):
    from indicata.sources import decoding
    frame = spark.createDataFrame([(1, bytearray(data) if data is not None else None)], "k int, line binary")
    assert tuple(decoding.decode_column(frame, "line").first()) == (1, text, encoding, malformed)


def test_decoded_files(spark, tmp_path):
    from indicata.sources import decoding
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + "Year,Count\n2020,é\n".encode())
    (tmp_path / "b.csv").write_bytes("Year,Count\n2021,é\n".encode("cp1252"))
    got = decoding.read_decoded_files(spark, str(tmp_path))
    assert sorted((r.text, r.encoding) for r in got.collect()) == [("Year,Count\n2020,é\n", "utf-8 mark"), ("Year,Count\n2021,é\n", "windows-1252")]
    assert {(r.encoding, r["values"]) for r in decoding.encoding_report(got).collect()} == {("utf-8 mark", 1), ("windows-1252", 1)}
