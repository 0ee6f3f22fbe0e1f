"""Series, sources and sinks."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from indicata import sources as SRC
from indicata.operators import series


def test_impute_gap_mean_of_neighbours(spark):
    rows = [("North", 2018, 10.0, 1.0), ("North", 2019, 20.0, 2.0), ("North", 2021, 40.0, 4.0), ("South", 2020, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "name string, year int, population double, moe double")
    out = {(r.name, r.year): r for r in series.impute_gap(df, ["name"], "year", "population", "moe").collect()}
    assert out[("North", 2020)].population == 30.0 and out[("North", 2020)].moe == 0.0 and out[("North", 2020)].imputed
    assert not out[("North", 2019)].imputed and len(out) == 5


def test_read_register_promotes_header_and_parses(spark, tmp_path):
    p = tmp_path / "reg.csv"
    p.write_text("Facility Type,Facility Zip,Facility Capacity,Extra\n"
                 "CENTER,90001,12,x\nCENTER,90002,n/a,y\n")
    df = SRC.read_register(spark, str(p), n_cols=3, numeric={"facility_capacity": "double"})
    assert df.columns == ["facility_type", "facility_zip", "facility_capacity"]
    assert [r.facility_capacity for r in df.orderBy("facility_zip").collect()] == [12.0, None]


def test_read_microdata_keeps_leading_zeros(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("SERIALNO,PUMA,AGEP\n1,03701,4\n2,03702,40\n")
    df = SRC.read_microdata(spark, str(p), string_cols=["PUMA"])
    assert [r.PUMA for r in df.orderBy("SERIALNO").collect()] == ["03701", "03702"]
    assert dict(df.dtypes)["AGEP"] == "int"


def test_read_open_csv_strips_bom(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes("﻿Year,Count\n2020,3\n".encode("utf-8"))
    assert SRC.read_open_csv(spark, str(p)).columns == ["Year", "Count"]


def test_jdbc_options():
    o = SRC.jdbc_options("jdbc:postgresql://h/db", query="select * from t", partition_column="id",
                         lower=0, upper=100, partitions=4, user="u")
    assert o["dbtable"] == "(select * from t) AS src" and o["numPartitions"] == "4" and o["user"] == "u"
    assert SRC.jdbc_options("jdbc:x", table="s.t")["dbtable"] == "s.t"
    with pytest.raises(ValueError):
        SRC.jdbc_options("jdbc:x")


def test_wkt_ring(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))",)], "wkt string")
    (r,) = df.select(F.inline(SRC.wkt_rings(F.col("wkt")))).collect()
    assert r.xs == [0.0, 4.0, 4.0, 0.0] and r.ys == [0.0, 0.0, 2.0, 2.0]


def test_select_variables(spark):
    cat = spark.createDataFrame([("S0101_C01_002", "Estimate!!Under 5", "Age and Sex"), ("X", "Other", "Age and Sex")],
                                "name string, label string, concept string")
    est = spark.createDataFrame([("S0101_C01_002E", 5.0), ("S0101_C01_002M", 1.0), ("XE", 9.0)],
                                "variable string, value double")
    out = SRC.select_variables(cat, est, "Age and Sex", "Estimate!!Under 5")
    assert sorted(r.variable for r in out.collect()) == ["S0101_C01_002E", "S0101_C01_002M"]


def test_write_indicator_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("A01", "Total", 1.5, "2023")], "geoid string, subgroup string, rate double, year string")
    SRC.write_indicator(df, str(tmp_path / "out"), "csv", partition_by=["year"])
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 1 and "year" in back.columns
    SRC.write_extract(df, F.col("year") == "2023", str(tmp_path / "ext"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ext")).count() == 1


def test_read_period_files(spark, tmp_path):
    for y in (2019, 2021):
        (tmp_path / f"{y}.csv").write_text("GEOID,estimate\n037,5\n")
    df = SRC.read_period_files(spark, {y: str(tmp_path / f"{y}.csv") for y in (2019, 2021)})
    assert sorted(r.year for r in df.collect()) == ["2019", "2021"]


def test_impute_gap_edge_stays_null(spark):
    rows = [("North", 2019, 20.0, 2.0), ("North", 2021, 40.0, 4.0)]
    df = spark.createDataFrame(rows, "name string, year int, population double, moe double")
    out = {r.year: r for r in series.impute_gap(df, ["name"], "year", "population", "moe",
                                                start=2019, end=2022).collect()}
    assert out[2020].population == 30.0 and out[2020].imputed
    assert out[2022].population is None and not out[2022].imputed and out[2022].moe is None


def test_to_parquet_codes_and_wkt_polygons(spark, tmp_path):
    df = spark.createDataFrame([("A01", 2019, 1.0), ("A01", 2020, 2.0)], "geoid string, year int, v double")
    SRC.to_parquet(df, str(tmp_path / "pq"), partition_by=["year"])
    back = spark.read.parquet(str(tmp_path / "pq"))
    assert back.filter("year = 2020").count() == 1 and set(back.columns) == {"geoid", "v", "year"}

    (tmp_path / "codes.csv").write_text("Code_1,Description\n007,Arab\n010,Irish\n")
    codes = SRC.read_codes(spark, str(tmp_path / "codes.csv"), {"Code_1": "ANC_Code"})
    assert sorted(r.ANC_Code for r in codes.collect()) == ["007", "010"]     # text keeps zeros

    (tmp_path / "poly.csv").write_text('id,wkt\np1,"POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))"\n')
    polys = SRC.read_polygons(spark, str(tmp_path / "poly.csv"), fmt="csv", wkt_col="wkt")
    (r,) = polys.collect()
    assert r.id == "p1" and r.xs == [0.0, 2.0, 2.0, 0.0] and r.ys == [0.0, 0.0, 1.0, 1.0]


def test_matches_is_null_safe(spark):
    from indicata.functions import scalars as S
    df = spark.createDataFrame([("pct_white",), (None,), ("num_white",)], "v string")
    assert [r[0] for r in df.select(S.matches("v", "^pct_")).collect()] == [True, False, False]
