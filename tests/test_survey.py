"""Replicate estimators against a NumPy brute force (SURVEY §5 (2))."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from indicata.operators import survey
from indicata.operators.survey import ReplicateDesign

R = 4
DESIGN = ReplicateDesign("w", tuple(f"w{i}" for i in range(1, R + 1)), scale=4 / R)


def make_rows(rng, n, geos=("a", "b"), inds=("x", "y")):
    rows = []
    for _ in range(n):
        w0 = int(rng.integers(1, 50))
        reps = [int(w0 + rng.integers(-6, 7)) for _ in range(R)]   # may be <= 0
        rows.append((str(rng.choice(list(geos))), str(rng.choice(list(inds))), w0, *reps))
    return rows


def cols():
    return ["geo", "ind", "w", *[f"w{i}" for i in range(1, R + 1)]]


def brute(rows, design=DESIGN):
    arr = {}
    for g, i, *w in rows:
        arr.setdefault((g, i), np.zeros(R + 1))
        arr[(g, i)] += np.array(w, dtype=float)
    out = {}
    for (g, i), t in arr.items():
        p = sum(v for (gg, _), v in arr.items() if gg == g)
        num_se = math.sqrt(design.scale * sum((t[1:] - t[0]) ** 2))
        th = [t[k] / p[k] if p[k] != 0 else None for k in range(R + 1)]
        rate_se = math.sqrt(design.scale * sum((x - th[0]) ** 2 for x in th[1:] if x is not None))
        pop_se = math.sqrt(design.scale * sum((p[1:] - p[0]) ** 2))
        out[(g, i)] = dict(num=t[0], num_se=num_se, rate=th[0] * 100, rate_se=rate_se, pop=p[0],
                           pop_se=pop_se, rate_moe=rate_se * 1.645 * 100,
                           rate_cv=(rate_se * 100) / (th[0] * 100) * 100 if th[0] else None,
                           count_moe=num_se * 1.645,
                           count_cv=num_se / t[0] * 100 if t[0] else None)
    return out


def check(got, exp):
    assert set(got) == set(exp)
    for k, e in exp.items():
        for c, v in e.items():
            g = got[k][c]
            if v is None:
                assert g is None, (k, c)
            else:
                assert g == pytest.approx(v, rel=1e-9, abs=1e-9), (k, c, g, v)


def test_rate_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = make_rows(rng, 300)
    df = spark.createDataFrame(rows, cols())
    got = {(r.geo, r.ind): r.asDict() for r in survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()}
    check(got, brute(rows))


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=1, max_value=40), st.integers(min_value=0, max_value=10_000))
def test_rate_property(spark, n, seed):
    rows = make_rows(np.random.default_rng(seed), n)
    df = spark.createDataFrame(rows, cols())
    got = {(r.geo, r.ind): r.asDict() for r in survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()}
    check(got, brute(rows))


def test_zero_replicate_denominator_is_dropped(spark):
    # replicate 1 of geo a sums to zero: that replicate is left out of rate_se
    rows = [("a", "x", 5, 0, 6, 5, 4), ("a", "y", 5, 0, 4, 6, 5)]
    df = spark.createDataFrame(rows, cols())
    out = {r.ind: r for r in survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()}
    check({(("a", k)): v.asDict() for k, v in out.items()}, brute(rows))
    assert out["x"].rate == pytest.approx(50.0)


def test_single_cell_group_has_zero_rate_se(spark):
    rows = [("a", "x", 3, 4, 2, 3, 3), ("a", "x", 1, 1, 1, 0, 2)]
    df = spark.createDataFrame(rows, cols())
    (r,) = survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()
    assert r.rate == 100.0 and r.rate_se == 0.0 and r.rate_cv == 0.0


def test_zero_estimate_cv_is_null(spark):
    rows = [("a", "x", 0, 0, 0, 0, 0), ("a", "y", 3, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, cols())
    out = {r.ind: r for r in survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()}
    assert out["x"].rate == 0.0 and out["x"].rate_cv is None and out["x"].count_cv is None


def test_null_key_is_its_own_group(spark):
    rows = [(None, "x", 2, 2, 2, 2, 2), (None, "y", 2, 2, 2, 2, 2), ("a", "x", 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "geo string, ind string, w long, w1 long, w2 long, w3 long, w4 long")
    out = {(r.geo, r.ind): r for r in survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()}
    assert out[(None, "x")].rate == 50.0 and out[("a", "x")].rate == 100.0


def test_mse_false_centres_on_replicate_mean(spark):
    d = ReplicateDesign("w", DESIGN.rep_weights, scale=1.0, mse=False)
    rows = [("a", "x", 10, 8, 12, 9, 11)]
    df = spark.createDataFrame(rows, cols())
    (r,) = survey.survey_total(df, d, ["geo"]).collect()
    assert r.num == 10 and r.num_se == pytest.approx(math.sqrt(4 + 4 + 1 + 1))


def test_rscales(spark):
    d = ReplicateDesign("w", DESIGN.rep_weights, scale=1.0, rscales=(1.0, 2.0, 0.0, 0.0))
    rows = [("a", "x", 10, 8, 12, 9, 11)]
    (r,) = survey.survey_total(spark.createDataFrame(rows, cols()), d, ["geo"]).collect()
    assert r.num_se == pytest.approx(math.sqrt(4 + 2 * 4))


def test_breakdown_equals_separate_runs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, i, *w in make_rows(rng, 200):
        rows.append((g, i, str(rng.choice(["p", "q", None])), str(rng.choice(["u", "v"])), *w))
    df = spark.createDataFrame(rows, ["geo", "ind", "d1", "d2", "w", *DESIGN.rep_weights])
    b = survey.survey_breakdown(df, DESIGN, ["geo"], {"d1": "d1", "d2": "d2"}, "ind")
    got = {(r.geo, r.dimension, r.subgroup, r.ind): r.asDict() for r in b.collect()}
    for dim in ("d1", "d2"):
        sep = survey.survey_rate(df, DESIGN, ["geo", dim], "ind").collect()
        for r in sep:
            key = (r.geo, dim, r[dim], r.ind)
            for c in ("num", "num_se", "rate", "rate_se", "pop", "pop_se"):
                assert got[key][c] == pytest.approx(r[c], rel=1e-12), (key, c)
    tot = survey.survey_rate(df, DESIGN, ["geo"], "ind").collect()
    for r in tot:
        assert got[(r.geo, "total", "Total", r.ind)]["rate_se"] == pytest.approx(r.rate_se, rel=1e-12)


def test_survey_plan_has_no_python(spark):
    from indicata.plans import survey_queries as SQ
    plan = SQ.survey_breakdown(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_persons_cross_the_joins_narrow(spark):
    from indicata.operators import recode
    from indicata.plans import survey_queries as SQ
    plan = SQ.children_by_race(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[plan.index("Join"):]
    assert recode.NOT_LATINX not in joins and recode.NOT_AIAN not in joins and recode.NHPI not in joins   # labels are written above them
    persons = joins[:joins.index("l_orderkey")]
    assert persons.count("Join") == 3   # households and both codes; the area is joined to the households
    rows = [("01", "0", "0", "0", "7", "a", None), (None, None, None, None, None, None, "b"), ("02", "1", "1", None, "1", "c", "a")]
    people = spark.createDataFrame(rows, "HISP string, RACAIAN string, RACPI string, RACNH string, RAC1P string, ANC1P string, ANC2P string")
    codes = spark.createDataFrame([("a", "Arab"), ("b", "Other")], "ANC_Code string, Description string")
    bits = recode.race_bits(people, codes)
    assert {(r.latino, r.aian, r.nhpi, r.swana) for r in bits.collect()} == {(False, False, False, True), (True, True, False, False), (True, True, True, True)}
    assert sorted((r.latino, r.swana, str(r.race)) for r in recode.race_labels(bits, True).collect()) == [
        (recode.LATINX, recode.NOT_SWANA, "None"), (recode.LATINX, recode.SWANA, recode.LATINX_PLACEHOLDER), (recode.NOT_LATINX, recode.SWANA, recode.NHPI_PLACEHOLDER)]


def test_threshold_runs_equal_single_runs(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v) if v >= 0 else None, *w)
            for (g, _, *w), v in zip(make_rows(rng, 300), rng.integers(-20, 200, 300))]
    df = spark.createDataFrame(rows, ["geo", "val", "w", *DESIGN.rep_weights])
    multi = {(r.geo, r.cut, r.indicator): r for r in
             survey.survey_threshold_runs(df, DESIGN, ["geo"], "val", [138, 100], "low", "high").collect()}
    from pyspark.sql import functions as F
    for cut in (100.0, 138.0):
        single = df.withColumn("ind", F.when(F.col("val") <= cut, "low").when(F.col("val") > cut, "high"))
        for r in survey.survey_rate(single, DESIGN, ["geo"], "ind").collect():
            m = multi[(r.geo, cut, r.ind)]
            for c in ("num", "num_se", "rate", "rate_se", "pop", "pop_se"):
                assert m[c] == pytest.approx(r[c], rel=1e-12), (cut, c)


def test_total_breakdown_equals_separate_totals(spark):
    rng = np.random.default_rng(9)
    rows = [(g, str(rng.choice(["p", "q", None])), *w) for g, _, *w in make_rows(rng, 150)]
    df = spark.createDataFrame(rows, ["geo", "d1", "w", *DESIGN.rep_weights])
    got = {(r.geo, r.dimension, r.subgroup): r for r in
           survey.survey_total_breakdown(df, DESIGN, ["geo"], {"d1": "d1"}).collect()}
    for r in survey.survey_total(df, DESIGN, ["geo", "d1"]).collect():
        g = got[(r.geo, "d1", r.d1)]
        assert g.num == r.num and g.num_se == pytest.approx(r.num_se, rel=1e-12)
        assert g.count_moe == pytest.approx(r.num_se * 1.645, rel=1e-12)
    for r in survey.survey_total(df, DESIGN, ["geo"]).collect():
        assert got[(r.geo, "total", "Total")].num == r.num


def test_rate_without_grouping_keys(spark):
    rows = [("a", "x", 2, 2, 2, 2, 2), ("b", "y", 6, 5, 6, 7, 6)]
    df = spark.createDataFrame(rows, cols())
    out = {r.ind: r.rate for r in survey.survey_rate(df, DESIGN, [], "ind").collect()}
    assert out == {"x": 25.0, "y": 75.0}


def test_three_cuts_and_numeric_dimension(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(21)
    rows = [(g, float(v), int(rng.integers(0, 3)), *w)
            for (g, _, *w), v in zip(make_rows(rng, 200), rng.integers(0, 300, 200))]
    df = spark.createDataFrame(rows, ["geo", "val", "kids", "w", *DESIGN.rep_weights])
    multi = {(r.geo, r.cut, r.indicator): r.rate for r in
             survey.survey_threshold_runs(df, DESIGN, ["geo"], "val", [200, 100, 138], "low", "high").collect()}
    for cut in (100.0, 138.0, 200.0):
        single = df.withColumn("ind", F.when(F.col("val") <= cut, "low").otherwise("high"))
        for r in survey.survey_rate(single, DESIGN, ["geo"], "ind").collect():
            assert multi[(r.geo, cut, r.ind)] == pytest.approx(r.rate, rel=1e-12)
    b = survey.survey_breakdown(df.withColumn("ind", F.when(F.col("val") <= 100, "low").otherwise("high")),
                                DESIGN, ["geo"], {"kids": "kids"}, "ind")
    assert {r.subgroup for r in b.filter("dimension = 'kids'").collect()} == {"0", "1", "2"}
