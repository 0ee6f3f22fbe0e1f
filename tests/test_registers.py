"""The published register summaries over register-shaped frames (hand-made rows)."""

from indicata.plans import registers

SCHEMA = ("facility_type string, facility_name string, county_name string, facility_zip string, "
          "facility_capacity string, facility_status string, closed_date string")


def test_closure_summary(spark):
    centers = spark.createDataFrame([
        ("C", "a", "North", "90001", "10", "CLOSED", "1/7/2020"),
        ("C", "b", "South", "90002", "5", "CLOSED", "3/9/2020"),
        ("C", "c", "North", "90001", "7", "LICENSED", "3/9/2020"),     # licensed: not a closure
        ("C", "d", "North", "90001", "4", "CLOSED", "12/30/2019"),
        ("C", "e", "North", "90001", "9", "CLOSED", "junk"),           # unparsable date: no year
    ], SCHEMA)
    homes = spark.createDataFrame([("H", "f", "North", "90003", "8", "CLOSED", "6/1/2020")], SCHEMA)
    out = {(r.year, r.type): (r.State, r.North) for r in
           registers.closure_summary(centers, homes, "North", ["2019", "2020"]).collect()}
    assert out[("2020", "Child Care Center-Closures")] == (2.0, 1.0)
    assert out[("2020", "Child Care Center-Seats Lost")] == (15.0, 10.0)
    assert out[("2019", "Child Care Center-Closures")] == (1.0, 1.0)
    assert out[("2020", "Family Child Care Home-Seats Lost")] == (8.0, 8.0)


def test_capacity_by_zip(spark):
    centers = spark.createDataFrame([
        ("C", "a", "N", "90001", "10", "LICENSED", None), ("C", "b", "N", "90001", "n/a", "LICENSED", None),
        ("C", "c", "N", "90002", "12", "LICENSED", None), ("C", "d", "N", "90002", "30", "CLOSED", None),
        ("C", "e", "N", "99999", "50", "LICENSED", None)], SCHEMA)
    homes = spark.createDataFrame([("H", "f", "N", "90003", "8", "LICENSED", None)], SCHEMA)
    zips = spark.createDataFrame([("90001",), ("90002",), ("90003",)], "zip string")
    out = {r.zip: r for r in registers.capacity_by_zip(centers, homes, zips).collect()}
    assert (out["90001"].total_centers, out["90001"].capacity_centers) == (2, 0.0)   # junk -> NA -> 0
    assert (out["90002"].total_centers, out["90002"].capacity_centers) == (1, 12.0)
    assert (out["90003"].total_centers, out["90003"].total_family_homes) == (0, 1)
    strict = registers.capacity_by_zip(centers, homes, zips, strict_reference=True)
    assert sorted(r.zip for r in strict.collect()) == ["90001", "90002"]            # no centers -> lost
