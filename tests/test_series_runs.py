"""The published yearly series over hand-made estimate and vital-record rows."""

import pytest

from indicata.plans import series_runs


def test_population_series(spark):
    rows = [("A County", "M", "2019", 100.0, 10.0), ("A County", "F", "2019", 110.0, 20.0),
            ("A County", "M", "2021", 90.0, 30.0), ("A County", "F", "2021", 100.0, 40.0),
            ("A County", "M", "2022", 95.0, None), ("A County", "F", "2022", 0.0, 5.0)]
    est = spark.createDataFrame(rows, "NAME string, variable string, year string, estimate double, moe double")
    out = {r.year: r for r in series_runs.population_series(est).collect()}
    assert out[2019].population == 210.0 and out[2019].moe == pytest.approx((100 + 400) ** 0.5)
    assert out[2020].population == 200.0 and out[2020].moe == 0.0 and out[2020].imputed
    assert out[2022].moe is None                      # one missing MOE: the sum's MOE is missing


def test_infant_mortality(spark):
    deaths = spark.createDataFrame([(2020, "X", "Under 1 year", 3), (2020, "X", "Under 1 year", 2),
                                    (2021, "X", "Under 1 year", None), (2021, "Y", "Under 1 year", 9),
                                    (2020, "X", "1-4 years", 7)],
                                   "Year int, County string, Strata_Name string, Count int")
    births = spark.createDataFrame([(2020, "X", 1000), (2020, "X", None), (2021, "X", 800), (2012, "X", 5)],
                                   "Year int, County string, Count int")
    out = {r.Year: r for r in series_runs.infant_mortality(deaths, births, "X", "Under 1 year", 2014).collect()}
    assert (out[2020].Deaths, out[2020].Births, out[2020].mortality) == (5, 1000, 5.0)
    assert out[2021].Deaths is None and out[2021].mortality is None
