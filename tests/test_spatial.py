"""Polygon areas, centroids and overlay against closed forms (SURVEY §5 (5))."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicata.operators import crosswalk as X
from spatial_reference import intersection_area as reference_area

L_XS, L_YS = [0.0, 4.0, 4.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0, 4.0, 4.0]       # concave L, area 12


def rect(x0, y0, x1, y1, cw=False):
    x0, y0, x1, y1 = float(x0), float(y0), float(x1), float(y1)
    xs, ys = [x0, x1, x1, x0], [y0, y0, y1, y1]
    return (xs[::-1], ys[::-1]) if cw else (xs, ys)


def spark_areas(spark, layers):
    """Evaluate the JVM-side area expression on rows of rings."""
    k = len(layers)
    schema = ", ".join(f"x{i} array<double>, y{i} array<double>" for i in range(k))
    rows = [tuple(v for ring in combo for v in (list(map(float, ring[0])), list(map(float, ring[1]))))
            for combo in zip(*layers)]
    df = spark.createDataFrame(rows, schema)
    expr = X.overlap_area_expr([(f"x{i}", f"y{i}") for i in range(k)])
    return [r.a for r in df.select(expr.alias("a")).collect()]


def test_intersection_concave_and_orientation(spark):
    got = spark_areas(spark, [
        [(L_XS, L_YS), (L_XS[::-1], L_YS[::-1]), (L_XS, L_YS), (L_XS, L_YS)],
        [rect(1, 1, 3, 3), rect(1, 1, 3, 3, cw=True), rect(2.5, 2.5, 3, 3), (L_XS, L_YS)]])
    assert got == [pytest.approx(3.0), pytest.approx(3.0), pytest.approx(0.0, abs=1e-12), pytest.approx(12.0)]
    three = spark_areas(spark, [[(L_XS, L_YS)], [rect(1, 1, 3, 3)], [rect(0, 0, 10, 1.5)]])
    assert three == [pytest.approx(1.0)]


def test_random_rectangles_match_closed_form(spark):
    rng = np.random.default_rng(3)
    A, B, exp = [], [], []
    for _ in range(200):
        a = sorted(rng.uniform(0, 10, 2)), sorted(rng.uniform(0, 10, 2))
        b = sorted(rng.uniform(0, 10, 2)), sorted(rng.uniform(0, 10, 2))
        exp.append(max(0, min(a[0][1], b[0][1]) - max(a[0][0], b[0][0]))
                   * max(0, min(a[1][1], b[1][1]) - max(a[1][0], b[1][0])))
        A.append(rect(a[0][0], a[1][0], a[0][1], a[1][1], cw=bool(rng.integers(2))))
        B.append(rect(b[0][0], b[1][0], b[0][1], b[1][1]))
    for g, e in zip(spark_areas(spark, [A, B]), exp):
        assert g == pytest.approx(e, abs=1e-9)


def test_ring_area_and_centroid(spark):
    df = spark.createDataFrame([(L_XS, L_YS)], "xs array<double>, ys array<double>")
    cx, cy = X.ring_centroid()
    (r,) = df.select(X.ring_area().alias("a"), cx.alias("cx"), cy.alias("cy")).collect()
    # L = [0,4]x[0,2] (area 8, centroid (2,1)) + [0,2]x[2,4] (area 4, centroid (1,3))
    assert r.a == pytest.approx(12.0)
    assert (r.cx, r.cy) == (pytest.approx(20 / 12), pytest.approx(20 / 12))


def test_crosswalk_threshold_and_many_to_many(spark):
    small = spark.createDataFrame([("p1", *rect(0, 0, 10, 10)), ("p2", *rect(10, 0, 20, 10))],
                                  "PUMA string, xs array<double>, ys array<double>")
    large = spark.createDataFrame([("s1", *rect(0, 0, 7, 10)), ("s2", *rect(7, 0, 18.5, 10)),
                                   ("s3", *rect(18.5, 0, 30, 10))],
                                  "SPA string, xs array<double>, ys array<double>")
    xw = {(r.PUMA, r.SPA): r for r in X.build_crosswalk(small, large, cell=4.0).collect()}
    assert set(xw) == {("p1", "s1"), ("p1", "s2"), ("p2", "s2")}     # p2/s3 holds 15% < 20%
    assert xw[("p1", "s2")].prc_small_area == pytest.approx(0.3)
    assert xw[("p2", "s2")].prc_large_area == pytest.approx(85 / 115)


def test_crosswalk_with_clip(spark):
    small = spark.createDataFrame([("p1", *rect(0, 0, 10, 10))], "PUMA string, xs array<double>, ys array<double>")
    large = spark.createDataFrame([("s1", *rect(0, 0, 10, 4)), ("s2", *rect(0, 4, 10, 10))],
                                  "SPA string, xs array<double>, ys array<double>")
    clip = spark.createDataFrame([rect(0, 0, 10, 5)], "xs array<double>, ys array<double>")
    xw = {r.SPA: r for r in X.build_crosswalk(small, large, cell=3.0, clip=clip).collect()}
    assert set(xw) == {"s1", "s2"}
    assert xw["s1"].prc_small_area == pytest.approx(0.8)
    assert xw["s2"].prc_small_area == pytest.approx(0.2)


def test_candidate_pairs_each_pair_once(spark):
    a = spark.createDataFrame([("a", *rect(0, 0, 9, 9))], "ida string, xs array<double>, ys array<double>")
    b = spark.createDataFrame([("b", *rect(1, 1, 8, 8))], "idb string, xs array<double>, ys array<double>")
    pairs = X.candidate_pairs(X.with_bbox(a), X.with_bbox(b), cell=2.0)
    assert pairs.count() == 1


def test_attach_crosswalk_counts_a_unit_in_each_area(spark):
    df = spark.createDataFrame([("p1", 1)], "PUMA string, v int")
    xw = spark.createDataFrame([("p1", "s1"), ("p1", "s2")], "PUMA string, SPA string")
    out = X.attach_crosswalk(df, xw, "PUMA")
    assert out.count() == 2


def test_random_polygons_match_reference(spark):
    rng = np.random.default_rng(11)

    def poly():
        k = int(rng.integers(3, 8))
        ang = np.sort(rng.uniform(0, 2 * np.pi, k))
        r = rng.uniform(0.5, 3, k)
        c = rng.uniform(0, 4, 2)
        xs, ys = list(c[0] + r * np.cos(ang)), list(c[1] + r * np.sin(ang))
        return (xs[::-1], ys[::-1]) if rng.integers(2) else (xs, ys)

    A = [poly() for _ in range(150)] + [(L_XS, L_YS), (L_XS, L_YS)]
    B = [poly() for _ in range(150)] + [rect(1, 1, 3, 3), (L_XS[::-1], L_YS[::-1])]
    C = [poly() for _ in range(152)]
    two = spark_areas(spark, [A, B])
    three = spark_areas(spark, [A, B, C])
    for i in range(len(A)):
        assert two[i] == pytest.approx(reference_area([A[i], B[i]]), abs=1e-9)
        assert three[i] == pytest.approx(reference_area([A[i], B[i], C[i]]), abs=1e-9)
    assert two[-2] == pytest.approx(3.0) and two[-1] == pytest.approx(12.0)


def test_overlay_plan_has_no_python(spark):
    from indicata.plans import spatial_queries as SP
    plan = SP.overlay_crosswalk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_grid_cell_size_from_data(spark):
    small = spark.createDataFrame([("p1", *rect(0, 0, 10, 10)), ("p2", *rect(10, 0, 20, 10)),
                                   ("p3", *rect(0, 10, 30, 40))],
                                  "PUMA string, xs array<double>, ys array<double>")
    assert X.grid_cell_size(small) == 10.0
    large = spark.createDataFrame([("s1", *rect(0, 0, 7, 10)), ("s2", *rect(7, 0, 18.5, 10))],
                                  "SPA string, xs array<double>, ys array<double>")
    xw = {(r.PUMA, r.SPA) for r in X.build_crosswalk(small, large).collect()}
    assert xw == {("p1", "s1"), ("p1", "s2"), ("p2", "s2")}


def test_parts_holes_and_empty_rings(spark):
    from indicata.sources import wkt_rings
    texts = ["MULTIPOLYGON (((0 0, 4 0, 4 2, 0 2, 0 0)), ((10 10, 20 10, 20 20, 10 20, 10 10)))",
             "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "POLYGON EMPTY", "POINT (1 2)", None, "POLYGON ((1 1, 2 2))"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, wkt string")
    rings = df.select("id", F.inline(wkt_rings(F.col("wkt"))))
    assert {r.id: r.area for r in X.polygon_measures(rings, ["id"]).collect()} == {0: 108.0, 1: 96.0, 5: 0.0}
    empty = spark.createDataFrame([("e", [], [])], "id string, xs array<double>, ys array<double>")
    assert empty.select(X.ring_area().alias("a"), X.ring_centroid()[0].alias("c")).first().asDict() == {"a": 0.0, "c": None}


def test_a_ring_is_split_once_and_texts_are_dealt_out(spark):
    from indicata.plans import spatial_queries as SPQ
    from indicata.sources import wkt_rings
    one = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 2))",)], "wkt string").select(wkt_rings(F.col("wkt")).alias("r"))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2   # into points, and a point into its numbers
    plan = SPQ.wkt_layers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert "MULTIPOLYGON" not in plan[:plan.index("Generate")] + below.split("\n")[0]   # the text is made below the parsing
    assert "REPARTITION_BY_NUM" in below


def test_crosswalk_of_parts_holes_and_empty_rings(spark):
    schema = "xs array<double>, ys array<double>, sign double"
    small = spark.createDataFrame([("p", *rect(0, 0, 10, 10), 1.0), ("p", *rect(0, 0, 5, 5), -1.0), ("p", *rect(100, 0, 105, 5), 1.0), ("e", [], [], 1.0)], f"PUMA string, {schema}")
    large = spark.createDataFrame([("w", *rect(0, 0, 5, 10), 1.0), ("w", *rect(100, 0, 200, 100), 1.0), ("o", *rect(5, 0, 10, 10), 1.0), ("o", *rect(6, 6, 8, 8), -1.0)], f"SPA string, {schema}")
    clip = spark.createDataFrame([(*rect(-5, -5, 300, 300), 1.0), (*rect(0, 9, 300, 10), -1.0)], schema)
    got = {r.SPA: round(r.prc_small_area, 9) for r in X.build_crosswalk(small, large, cell=4.0, min_share=0.0).collect()}
    assert got == {"w": 0.5, "o": 0.46}
    cut = {r.SPA: round(r.prc_small_area * 90, 6) for r in X.build_crosswalk(small, large, cell=4.0, min_share=0.0, clip=clip).collect()}
    assert cut == {"w": 45.0, "o": 41.0}


def test_a_large_ring_enters_few_cells(spark):
    big = X.with_level(X.with_bbox(spark.createDataFrame([("b", *rect(0.5, 0.5, 1e6, 1e6))], "id string, xs array<double>, ys array<double>")), 1.0)
    assert X._entered(big, 1.0, F.col("level")).count() <= 4
    tiny = spark.createDataFrame([(i, *rect(i * 1000, i * 1000, i * 1000 + 1, i * 1000 + 1)) for i in range(50)], "k int, xs array<double>, ys array<double>")
    assert X.candidate_pairs(X.with_bbox(tiny), big, 1.0).count() == 50
    assert X.candidate_pairs(big, X.with_bbox(tiny), 1.0).count() == 50


def test_no_replicate_column_below_the_crosswalk_exchange(spark):
    from indicata.plans import spatial_queries as SP
    plan = SP.survey_by_crosswalk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    joined = min(i for i, line in enumerate(lines) if "Join" in line)
    assert max(i for i, line in enumerate(lines) if "AS WGTP1#" in line) < joined and "RoundRobinPartitioning" not in plan
