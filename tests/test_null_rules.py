"""Null rules, silent loss and scale of the plans: a test for each fault found."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from indicata import sources as SRC
from indicata.functions import scalars as S
from indicata.operators import aggregate as A
from indicata.operators import households as H
from indicata.operators import reports as K
from indicata.operators import series
from indicata.plans import register_queries as RQ
from indicata.plans import report_queries as RP

SF = "/root/testdata/sf0.001"


def test_null_keys_match_in_the_household_join(spark):
    people = spark.createDataFrame([("a", None, "03701", 3)], "SERIALNO string, PUMA10 string, PUMA20 string, AGEP int")
    homes = spark.createDataFrame([("a", None, "03701", 9)], "SERIALNO string, PUMA10 string, PUMA20 string, WGTP int")
    for never_null in ((), ("SERIALNO",)):
        joined = H.attach_household(people, homes, ["SERIALNO", "PUMA10", "PUMA20"], never_null=never_null)
        assert [r.WGTP for r in joined.collect()] == [9] and joined.columns == ["SERIALNO", "PUMA10", "PUMA20", "AGEP", "WGTP"]


def test_replace_first_with_groups_and_dollars(spark):
    df = spark.createDataFrame([("xx foo yy",)], "s string")
    got = df.select(S.replace_first("s", "(foo|bar)", "Z").alias("a"), S.replace_first("s", "o+", "$1\\").alias("b")).first()
    assert got.a == "xx Z yy" and got.b == "xx f$1\\ yy"


def test_moe_sum_needs_every_estimate(spark):
    df = spark.createDataFrame([(4.0, 10.0), (3.0, None)], "m double, e double")
    assert df.agg(A.moe_sum("m", "e").alias("v")).first().v is None
    assert df.agg(A.moe_sum("m", "e", na_rm=True).alias("v")).first().v == pytest.approx(4.0)


def test_period_totals_are_strict(spark):
    df = spark.createDataFrame([("2020-01-05", 3), ("2020-01-06", None), ("2020-02-01", 4)], "d string, n int").withColumn("d", F.to_date("d"))
    strict = {r.month: r.total for r in A.by_period(df, "d", "month", [], {"total": "n"}).collect()}
    assert strict == {"01": None, "02": 4}
    assert {r.month: r.total for r in A.by_period(df, "d", "month", [], {"total": "n"}, strict=False).collect()} == {"01": 3, "02": 4}


def test_whole_and_part_cells_equal_rows(spark):
    rows = [("LA", "2020-01-05", 3), ("LA", "2020-02-06", 2), ("SF", "2020-01-01", 4), (None, "2020-02-09", None)]
    df = spark.createDataFrame(rows, "county string, d string, n int").withColumn("d", F.to_date("d"))
    got = A.whole_and_part_by_period(df, F.col("county") == "LA", "all", "LA", "d", "month", [], {"total": "n"}).collect()
    assert {(r.geography, r.month): r.total for r in got} == {("all", "01"): 7, ("all", "02"): None, ("LA", "01"): 3, ("LA", "02"): 2}


def test_impute_gap_leaves_present_nulls_and_edges(spark):
    rows = [(1, 2018, None, 1.0), (1, 2019, 4.0, 1.0), (1, 2020, None, 2.0), (1, 2022, 8.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, year int, v double, moe double")
    got = {r.year: (r.v, r.moe, r.imputed) for r in series.impute_gap(df, ["k"], "year", "v", "moe", start=2017).collect()}
    assert got == {2017: (None, None, False), 2018: (None, 1.0, False), 2019: (4.0, 1.0, False), 2020: (None, 2.0, False),
                   2021: (6.0, 0.0, True), 2022: (8.0, 1.0, False)}


def test_total_is_told_by_dimension(spark):
    df = spark.createDataFrame([("g", "race", "Total", 9.0), ("g", "total", "Total", 4.0)], "geoid string, dimension string, subgroup string, num double")
    assert {r.total for r in df.withColumn("total", K.total_of("num", ["geoid"])).collect()} == {4.0}


def test_rare_decimals_survive_type_inference(spark, tmp_path):
    rows = [f"{i},{'12.5' if i % 5000 == 4999 else 100}" for i in range(20_000)]
    (tmp_path / "p.csv").write_text("\n".join(["SERIALNO,POVPIP", *rows]))
    df = SRC.read_microdata(spark, str(tmp_path / "p.csv"))
    assert df.filter("POVPIP is null").count() == 0 and df.filter("POVPIP = 12.5").count() == 4


def test_report_frames_keep_every_dimension_and_area(spark):
    frame = RP.indicator_frame(spark, "/root/testdata/sf0.01")
    assert frame.select("dimension").distinct().count() > 2
    assert RP.fallback_text(spark, "/root/testdata/sf0.01", max_cv=0.0).filter("n_subgroups = 0 and text is not null").count() == 5


def test_register_years_reach_the_scan(spark):
    for query in (RQ.closures_by_month, RQ.closures_by_day, RQ.closure_summary, RQ.compare_years):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate" in plan and "RoundRobinPartitioning" not in plan
        assert plan.count("orders.parquet") == 1


def test_submitted_settings_win(tmp_path):
    code = ("from indicata import get_session; s = get_session('local[1]');"
            "print(s.conf.get('spark.sql.adaptive.enabled'), s.conf.get('spark.sql.session.timeZone'), s.conf.get('spark.ui.enabled'))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--conf spark.sql.adaptive.enabled=false --conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, cwd=tmp_path)
    assert out.stdout.split()[-3:] == ["false", "Asia/Tokyo", "false"], out.stderr
