"""Polygon layers derived from the customer and region tables, the
crosswalk built from their overlap, and a survey run through it (SURVEY §7
steps 5, 13).

Small units (PUMA-like) are the customers, one 10 x 10 square each on a grid
50 squares wide, so the layer grows with the table.  Large units (planning
areas) are the regions as vertical strips as tall as the grid; the last one
is an L-shape (concave) that takes the bottom of the previous strip.  The
clip shape (the "state" outline) cuts the first column of squares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicata.operators import crosswalk as X
from indicata.operators import survey
from indicata.plans import standins as S
from indicata.plans import survey_queries as SQ
from indicata.sources import readers

# Fixed values of the test layout.
GRID = 50
SIDE = 10.0
STRIP_X = (0.0, 87.0, 233.0, 313.0, 428.5, 500.0)
NOTCH_Y = 20.0
CLIP_X = 4.0
CELL = SIDE   # the grid's cells: about a small unit's size
MIN_SHARE = 0.20
DIGITS = 9
HOLE, ISLAND = (2, 2, 2, 3), (20, 0, 4, 3)   # x and y from the square's corner, width, height


def _arr(*vals):
    return F.array(*[v if not isinstance(v, (int, float)) else F.lit(float(v)) for v in vals])


def pumas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    x0 = (k % GRID).cast("double") * F.lit(SIDE)
    y0 = F.floor(k / GRID).cast("double") * F.lit(SIDE)
    x1, y1 = x0 + F.lit(SIDE), y0 + F.lit(SIDE)
    return c.select(k.cast("string").alias("PUMA"), F.col("c_name").alias("NAMELSAD20"),
                   F.array(x0, x1, x1, x0).alias("xs"), F.array(y0, y0, y1, y1).alias("ys"))


def _extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the height of the square grid."""
    c = S.table(spark, sf_dir, "customer")
    return c.agg(((F.floor(F.max("c_custkey") / GRID) + 1) * F.lit(SIDE)).alias("top"))


def _strip_ring(j: int):
    a, b = STRIP_X[j], STRIP_X[j + 1]
    top = F.col("top")
    if j == 3:   # gives its bottom to the L-shaped last strip
        return _arr(a, b, b, a), _arr(NOTCH_Y, NOTCH_Y, top, top)
    if j == 4:   # L-shape, counter-clockwise, concave at (a, NOTCH_Y)
        p = STRIP_X[3]
        return _arr(p, b, b, a, a, p), _arr(0, 0, top, top, NOTCH_Y, NOTCH_Y)
    return _arr(a, b, b, a), _arr(0, 0, top, top)


def spas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips built from the one-row extent (exploded to one row per strip)
    and named by an equi-join with the region table."""
    strips = []
    for j in range(len(STRIP_X) - 1):
        rx, ry = _strip_ring(j)
        strips.append(F.struct(F.lit(j).alias("r_regionkey"), rx.alias("xs"), ry.alias("ys")))
    rings = _extent(spark, sf_dir).select(F.inline(F.array(*strips)))
    r = S.table(spark, sf_dir, "region")
    return rings.join(r, "r_regionkey").select(F.col("r_regionkey").cast("string").alias("SPA"),
                                               F.col("r_name").alias("SPA_NAME"), "xs", "ys")


def state_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip polygon over the whole grid except a band on the left."""
    lo, hi = CLIP_X, STRIP_X[-1]
    top = F.col("top")
    return _extent(spark, sf_dir).select(F.lit("state").alias("GEOID"), _arr(lo, hi, hi, lo).alias("xs"),
                                         _arr(0, 0, top, top).alias("ys"))


def _layers(spark, sf_dir) -> DataFrame:
    p = pumas(spark, sf_dir).select(F.lit("puma").alias("layer"), F.col("PUMA").alias("id"), "xs", "ys")
    s = spas(spark, sf_dir).select(F.lit("spa").alias("layer"), F.col("SPA").alias("id"), "xs", "ys")
    c = state_outline(spark, sf_dir).select(F.lit("state").alias("layer"), F.col("GEOID").alias("id"),
                                            "xs", "ys")
    return p.unionByName(s).unionByName(c)


def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of every polygon of the three layers."""
    return _layers(spark, sf_dir).select("layer", "id", F.round(X.ring_area(), DIGITS).alias("area"))


def ring_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of every polygon."""
    cx, cy = X.ring_centroid()
    return _layers(spark, sf_dir).select("layer", "id", F.round(cx, DIGITS).alias("cx"),
                                         F.round(cy, DIGITS).alias("cy"))


def wkt_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 J1 J5 over text: each customer's square with a hole, and an island a
    row of squares away, as a WKT multipolygon; its area and centroid."""
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    x0, y0 = (k % GRID) * int(SIDE), F.floor(k / GRID) * int(SIDE)

    def box(dx, dy, w, h):
        points = [(dx, dy), (dx + w, dy), (dx + w, dy + h), (dx, dy + h), (dx, dy)]
        text = [F.concat_ws(" ", (x0 + F.lit(x)).cast("string"), (y0 + F.lit(y)).cast("string")) for x, y in points]
        return F.concat(F.lit("("), F.concat_ws(", ", *text), F.lit(")"))

    wkt = F.concat(F.lit("MULTIPOLYGON (("), box(0, 0, 10, 10), F.lit(", "), box(*HOLE), F.lit("), ("), box(*ISLAND), F.lit("))"))
    # a text is a key's worth of table but much to parse: the keys are dealt out to all cores, whatever the splits
    # of the file, by the id that the measures are grouped by
    c = c.select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    texts = c.select(k.alias("id"), F.when(k % 7 != 0, wkt).otherwise(F.lit("POLYGON EMPTY")).alias("wkt"))
    rings = texts.select("id", F.inline(readers.wkt_rings(F.col("wkt"))))
    measured = X.polygon_measures(rings, ["id"])
    out = c.select(k.alias("id")).join(measured, "id", "left")   # an empty polygon has no ring to measure
    return out.select("id", F.round(F.coalesce("area", F.lit(0.0)), DIGITS).alias("area"),
                      F.round("cx", DIGITS).alias("cx"), F.round("cy", DIGITS).alias("cy"))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    xw = X.build_crosswalk(pumas(spark, sf_dir), spas(spark, sf_dir), CELL, MIN_SHARE,
                           clip=state_outline(spark, sf_dir).select("xs", "ys"))
    return xw.select("PUMA", "NAMELSAD20", "SPA", "SPA_NAME",
                     F.col("prc_large_area").alias("prc_spas_area"),
                     F.col("prc_small_area").alias("prc_pumas_area"))


def overlay_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUMA -> planning-area crosswalk with the 20% rule."""
    return crosswalk(spark, sf_dir).select(
        "PUMA", "NAMELSAD20", "SPA", "SPA_NAME",
        F.round("prc_spas_area", DIGITS).alias("prc_spas_area"),
        F.round("prc_pumas_area", DIGITS).alias("prc_pumas_area"))


def survey_by_crosswalk(spark: SparkSession, sf_dir: str, cut: float = 100) -> DataFrame:
    """Households of a unit that falls in two planning areas count in
    both; rates by planning area for households with a child under 5.

    Here the small units are customers, so the crosswalk grows with the data
    and is not forced to broadcast (a real PUMA crosswalk is a few thousand
    rows and would be).  Households are joined as rows: a stand-in unit
    holds about two eligible households, so summing them to (unit,
    indicator) cells first costs an extra 81-column aggregate and saves
    nothing (measured).  With real PUMAs, thousands of households per unit,
    ``pums.area_run`` sums to cells before the join."""
    df = SQ.eligible(spark, sf_dir, person_filter=F.col("AGEP") < 5, geo_cols=(), replicates=False)
    df = df.withColumn("PUMA", F.col("o_custkey").cast("string"))
    xw = crosswalk(spark, sf_dir).select("PUMA", F.col("SPA_NAME").alias("geoid"))
    # rows cross the join narrow; the replicate weights are added after it
    df = S.add_household_replicates(X.attach_crosswalk(df, xw, "PUMA")).withColumn("indicator", SQ._indicator(cut))
    out = survey.survey_rate(df, S.HH_DESIGN, ["geoid"], "indicator")
    return out.filter((F.col("indicator") == SQ.AT_OR_BELOW) & F.col("geoid").isNotNull())
