"""One test per semantic trap T1-T16 on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from indicata.functions import scalars as S
from indicata.operators import aggregate as A
from indicata.operators import households as H
from indicata.operators import recode as RC
from indicata.operators import reports as K


def one(df, expr):
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_t1_cv_uses_proportion_not_percent(spark):
    from indicata.operators.survey import reliability
    df = spark.createDataFrame([(10.0, 2.0, 0.25, 0.05, 40.0, 1.0)],
                               "num double, num_se double, _rate double, rate_se double, pop double, pop_se double")
    (r,) = reliability(df).collect()
    assert r.rate == 25.0 and r.rate_cv == pytest.approx(20.0) and r.count_cv == pytest.approx(20.0)


def test_t2_null_is_not_member(spark):
    df = spark.createDataFrame([("01",), (None,), ("02",)], "HISP string")
    assert one(df, S.not_equal_flag("HISP", "01", "Latinx", "Not Latinx")) == ["Not Latinx", "Latinx", "Latinx"]
    assert one(df, S.in_set("HISP", ["01"])) == [True, False, False]


def test_t3_null_code_gives_null_category(spark):
    df = spark.createDataFrame([(None, "Not Latinx"), ("1", "Not Latinx"), ("1", "Latinx"), ("7", "Latinx"),
                                ("12", "Not Latinx")], "RAC1P string, latino string")
    race = F.col("RAC1P")
    expr = RC.case_chain(RC.race_rules(race, F.col("latino") == "Not Latinx"), RC.LATINX_PLACEHOLDER,
                         null_when=race.isNull())
    assert one(df, expr) == [None, "White NL", "Latinx placeholder", "NHPI placeholder", "Latinx placeholder"]
    kids = RC.case_chain(RC.race_rules(race, F.col("latino") == "Not Latinx", True), RC.LATINX_PLACEHOLDER,
                         null_when=race.isNull())
    assert one(df, kids)[3] == "Latinx placeholder"


def test_t4_first_row_follows_explicit_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 5, "z")], "k int, o int, v string")
    out = {r.k: r.v for r in H.first_per(df, ["k"], ["o"]).collect()}
    assert out == {1: "a", 2: "z"}


def test_t5_strict_and_lenient_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, x int")
    out = {r.g: (r.s, r.l) for r in df.groupBy("g").agg(S.strict_sum("x").alias("s"),
                                                          F.sum("x").alias("l")).collect()}
    assert out == {"a": (None, 1), "b": (2, 2)}


def test_t6_paste_na(spark):
    df = spark.createDataFrame([("1 Main", None)], "a string, b string")
    assert one(df, S.paste("a", "b", na_as_text=True)) == ["1 Main NA"]
    assert one(df, S.paste("a", "b")) == ["1 Main"]


def test_t7_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.125,)], "x double")
    assert one(df, S.round_half_even("x")) == [2.0, 4.0, 0.0]
    assert one(df, S.round_half_even("x", 2)) == [2.5, 3.5, 0.12]


def test_t8_junk_to_null(spark):
    df = spark.createDataFrame([("1/7/2020", "12"), ("13/45/2020", "n/a"), ("x", " 7 ")], "d string, n string")
    assert one(df, S.parse_date("d")) == [dt.date(2020, 1, 7), None, None]
    assert one(df, S.parse_number("n")) == [12.0, None, 7.0]


def test_t9_divide_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert one(df, S.safe_divide("a", "b")) == [None, 0.25]


def test_t10_replace_first_only(spark):
    df = spark.createDataFrame([("White NL NL",), ("AIAN Alone or in Combination",), ("nh_white",)], "s string")
    assert one(df, S.replace_first("s", " NL", "")) == ["White NL", "AIAN Alone or in Combination", "nh_white"]
    assert one(df, RC.clean_labels("s")) == ["White NL", "AIAN", "white"]


def test_t11_null_keys_share_a_window_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    assert sorted(one(df, A.share_within("v", ["g"]))) == pytest.approx([100 / 3, 200 / 3, 100.0])


def test_t13_ties_go_to_first_label(spark):
    df = spark.createDataFrame([("g", "b", 5.0), ("g", "a", 5.0), ("g", "c", 1.0)], "geoid string, subgroup string, v double")
    assert [r.subgroup for r in K.top_by(df, ["geoid"], "v").collect()] == ["a"]


def test_t14_substring_anywhere(spark):
    df = spark.createDataFrame([("0904411", None), (None, "0441"), ("0101", "0202")], "p1 string, p2 string")
    assert one(df, S.contains_any(["p1", "p2"], "044")) == [True, True, False]


def test_t15_title_case(spark):
    df = spark.createDataFrame([("RIVER VALLEY",), ("abc-def",)], "s string")
    assert one(df, S.title_case("s")) == ["River Valley", "Abc-def"]


def test_t16_full_month_name(spark):
    df = spark.createDataFrame([(dt.date(2020, 6, 3),)], "d date")
    assert one(df, S.month_name("d")) == ["June"]


def test_clean_names_snake_and_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Facility Capacity` int, `facility.capacity` int, `1st` int")
    assert S.clean_names(df).columns == ["facility_capacity", "facility_capacity_2", "x1st"]


def test_zero_fill_and_round(spark):
    df = spark.createDataFrame([(None, None, "a", 1.25)], "a int, b double, c string, d double")
    (r,) = RC.round_numeric(RC.zero_fill(df), 1).collect()
    assert (r.a, r.b, r.c, r.d) == (0, 0.0, "a", 1.2)


def test_drop_subgroups_drops_null(spark):
    df = spark.createDataFrame([("Not AIAN",), (None,), ("Asian NL",)], "subgroup string")
    assert [r.subgroup for r in RC.drop_subgroups(df).collect()] == ["Asian NL"]


def test_flag_in_codes_either_column(spark):
    people = spark.createDataFrame([("1", None), (None, "2"), ("3", "4"), (None, None)], "ANC1P string, ANC2P string")
    codes = spark.createDataFrame([("1", "Arab"), ("2", "Iraqi"), ("3", "Irish"), ("2", "Iraqi")],
                                  "ANC_Code string, Description string")
    sel = RC.codes_by_description(codes, RC.SWANA_DESCRIPTIONS)
    out = RC.flag_in_codes(people, ["ANC1P", "ANC2P"], sel, "ANC_Code", "SWANA", "Not SWANA", "swana")
    assert out.count() == 4
    assert sorted((r.ANC1P or "", r.ANC2P or "", r.swana) for r in out.collect()) == [
        ("", "", "Not SWANA"), ("", "2", "SWANA"), ("1", "", "SWANA"), ("3", "4", "Not SWANA")]


def test_moe_sum_counts_one_zero_estimate(spark):
    df = spark.createDataFrame([(10, 3.0), (0, 4.0), (0, 5.0), (2, 1.0)], "e int, m double")
    (r,) = df.agg(A.moe_sum("m", "e").alias("v")).collect()
    assert r.v == pytest.approx((9 + 25 + 1) ** 0.5)


def test_whole_and_part_one_pass(spark):
    df = spark.createDataFrame([("North", 1), ("South", 1), ("North", 0)], "county string, close int")
    t = A.whole_and_part(df, F.col("county") == "North", "State", "North")
    out = {r.geography: r.n for r in t.groupBy("geography").agg(F.sum("close").alias("n")).collect()}
    assert out == {"State": 2, "North": 1}


def test_comma_and_text_cast(spark):
    df = spark.createDataFrame([(1234567, 2.5)], "n long, x double")
    assert one(df, S.comma("n")) == ["1,234,567"]
    assert S.cast_all_text(df).dtypes == [("n", "string"), ("x", "string")]


def test_stack_with_tags_and_label_order(spark):
    from indicata.operators import reshape
    a = spark.createDataFrame([("A01", 1.0)], "geoid string, rate double")
    b = spark.createDataFrame([(2.0, "A01")], "rate double, geoid string")
    out = reshape.stack([a, b], {"population": ["under 5", "all"]})
    assert sorted((r.population, r.rate) for r in out.collect()) == [("all", 2.0), ("under 5", 1.0)]
    levels = ["Child Care", "Food", "Housing"]
    df = spark.createDataFrame([("Housing",), ("Other",), ("Child Care",), ("Food",)], "expense string")
    assert [r.expense for r in reshape.order_by_labels(df, "expense", levels).collect()] == \
        ["Child Care", "Food", "Housing", "Other"]


def test_pair_measures_by_stem(spark):
    from indicata.operators import reshape
    long = spark.createDataFrame([("North", "pct_white_hh", 0.2), ("North", "num_white_hh", 10.0),
                                  ("North", "num_black_hh", 5.0), ("North", "pct_black_hh", 0.1),
                                  ("North", "county_total", 1.0)], "county string, variable string, value double")
    out = {r.stem: (r.num, r.pct) for r in reshape.pair_measures(long, ["county"], "variable", "value").collect()}
    assert out == {"white_hh": (10.0, 0.2), "black_hh": (5.0, 0.1)}


def test_moe_sum_missing_moe_is_missing(spark):
    df = spark.createDataFrame([(10, 3.0), (2, None)], "e int, m double")
    (r,) = df.agg(A.moe_sum("m", "e").alias("v"), A.moe_sum("m", "e", na_rm=True).alias("w")).collect()
    assert r.v is None and r.w == pytest.approx(3.0)


def test_date_parts_and_percent_to_count(spark):
    df = spark.createDataFrame([(dt.date(2020, 3, 9), 25.0, 80.0)], "d date, rate double, pop double")
    (r,) = df.select(S.date_part_text("d", "month").alias("m"), S.date_part_text("d", "year").alias("y"),
                     A.count_from_percent("rate", "pop").alias("n"), A.rate_per("rate", "pop", 1000).alias("p")).collect()
    assert (r.m, r.y, r.n, r.p) == ("03", "2020", 20.0, 312.5)
