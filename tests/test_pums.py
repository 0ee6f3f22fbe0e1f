"""The published runs over microdata-shaped frames (hand-made rows)."""

import pytest

from indicata.plans import pums

R = 80


def _housing(spark, rows):
    cols = ["SERIALNO", "PUMA", "WGTP", *[f"WGTP{k}" for k in range(1, R + 1)]]
    data = [(s, p, w, *[w + (k % 3) - 1 for k in range(1, R + 1)]) for s, p, w in rows]
    return spark.createDataFrame(data, cols)


PEOPLE_SCHEMA = ("SERIALNO string, SPORDER int, PUMA string, AGEP int, POVPIP double, HISP string, "
                 "RAC1P string, RACAIAN string, RACPI string, RACNH string, ANC1P string, ANC2P string")


def _people(spark):
    rows = [
        # household a: the second person is the first child under 5 -> ratio 80 (below)
        ("a", 1, "03701", 35, 80.0, "01", "1", "0", "0", "0", "1", None),
        ("a", 2, "03701", 3, 80.0, "01", "1", "0", "0", "0", "1", None),
        # household b: child at 150 (above); SWANA ancestry code 2
        ("b", 1, "03702", 2, 150.0, "01", "2", "0", "0", "0", "2", None),
        # household c: child, null ratio -> outside the universe
        ("c", 1, "03702", 1, None, "02", "6", "0", "0", "0", None, None),
        # household d: other area
        ("d", 1, "05901", 2, 50.0, "01", "1", "0", "0", "0", None, None),
        # household e: child below the line, Latinx
        ("e", 2, "03701", 4, 90.0, "03", "8", "1", "0", "0", None, None),
        ("e", 1, "03701", 40, 400.0, "03", "8", "1", "0", "0", None, None),
    ]
    return spark.createDataFrame(rows, PEOPLE_SCHEMA)


def test_county_run(spark):
    housing = _housing(spark, [("a", "03701", 10), ("b", "03702", 20), ("c", "03702", 5),
                               ("d", "05901", 7), ("e", "03701", 30)])
    (r,) = pums.county_run(_people(spark), housing, "037", "06037").collect()
    # eligible: a (80, w10), b (150, w20), e (90, w30): below = 40 of 60
    assert (r.geoid, r.num, r.pop) == ("06037", 40.0, 60.0)
    assert r.rate == pytest.approx(200 / 3)
    (allhh,) = pums.county_run(_people(spark), housing, "037", "06037", under5=False).collect()
    # all persons: household e is represented by person 1 (ratio 400, above)
    assert (allhh.num, allhh.pop) == (10.0, 60.0)


def test_race_run(spark):
    housing = _housing(spark, [("a", "03701", 10), ("b", "03702", 20), ("e", "03701", 30)])
    codes = spark.createDataFrame([("2", "Iraqi"), ("9", "Irish")], "ANC_Code string, Description string")
    out = {r.subgroup: r for r in pums.race_run(_people(spark), housing, codes, "037", "06037").collect()}
    assert out["Total"].num == 40.0 and out["White NL"].num == 10.0 and out["Latinx"].num == 30.0
    assert "SWANA" not in out            # the SWANA household is above the line
    assert "Not Latinx" not in out and "Latinx placeholder" not in out


def test_area_run(spark):
    housing = _housing(spark, [("a", "03701", 10), ("b", "03702", 20), ("e", "03701", 30)])
    xwalk = spark.createDataFrame([("03701", "1"), ("03701", "2"), ("03702", "2")], "PUMA string, SPA string")
    out = {r.geoid: r for r in pums.area_run(_people(spark), housing, xwalk, "037").collect()}
    assert out["1"].num == 40.0 and out["1"].pop == 40.0
    assert out["2"].num == 40.0 and out["2"].pop == 60.0


def test_county_runs_equal_single_runs(spark):
    """Both populations and both cuts in one pass, against a run for each."""
    housing = _housing(spark, [("a", "03701", 10), ("b", "03702", 20), ("c", "03702", 5), ("d", "05901", 7), ("e", "03701", 30)])
    got = {(r.population, r.cut): r for r in pums.county_runs(_people(spark), housing, "037", "06037").collect()}
    assert set(got) == {(p, c) for p in ("under 5", "all") for c in (100.0, 138.0)}
    for (population, cut), r in got.items():
        (own,) = pums.county_run(_people(spark), housing, "037", "06037", cut, under5=population == "under 5").collect()
        assert (r.num, r.num_se, r.rate, r.rate_se, r.pop) == (own.num, own.num_se, own.rate, own.rate_se, own.pop)
