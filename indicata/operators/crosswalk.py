"""Area crosswalks from polygon overlap, and their use.

Polygons are rows with a ring as two arrays ``xs``/``ys`` (projected
coordinates, ring not closed).  A polygon of several parts or with holes is
one row per ring, with a ``sign`` of 1 for an outer ring and -1 for a hole;
every area is a signed sum over its rings.  A ring of fewer than three
points has area 0.  Areas and centroids are higher-order array expressions
evaluated in the JVM.

Overlay (which pieces of layer A fall in layer B, and how big they are) is
a relational job:

1. every ring gets a level, at which a grid cell is no smaller than its
   bounding box, so that it touches four cells at most, whatever its size;
2. a ring is entered at the levels of the other layer that are coarser than
   its own, and an equi-join on level and cell yields the pairs whose boxes
   meet; a pair is kept only in the cell holding the lower-left corner of the
   intersection of the two boxes, so no ``distinct`` shuffle is needed;
3. the exact intersection area of each candidate pair is a column
   expression built from Spark's array higher-order functions, so the
   whole overlay runs in the JVM with no Python worker.

Exact area of intersection of simple (possibly concave) polygons without a
geometry library: every polygon after the first is fanned into signed
triangles from its first vertex (its indicator function is the signed sum
of the triangle indicators); the first polygon is clipped by each triangle
half-plane by half-plane (Sutherland-Hodgman keeps the signed area of any
closed ring, concave or not) and the clipped areas are summed with the
triangle signs.  A clip shape is one more factor.
"""

from __future__ import annotations

import itertools
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- JVM side

def _cross_terms(xs: Column, ys: Column):
    n = F.size(xs)
    idx = F.sequence(F.lit(0), n - F.lit(1))
    return n, idx


def ring_area(xs: str = "xs", ys: str = "ys", signed: bool = False) -> Column:
    """Planar area of a ring by the shoelace formula."""
    X, Y = F.col(xs), F.col(ys)
    n, idx = _cross_terms(X, Y)
    s = F.aggregate(idx, F.lit(0.0),
                    lambda acc, i: acc + X[i] * Y[(i + 1) % n] - X[(i + 1) % n] * Y[i])
    a = F.when(n >= 3, s / F.lit(2.0)).otherwise(F.lit(0.0))
    return a if signed else F.abs(a)


def ring_centroid(xs: str = "xs", ys: str = "ys", area: Column | None = None) -> tuple[Column, Column]:
    """Area-weighted centroid of a ring (J5); for concave rings it may fall
    outside the polygon, as the standard centroid does.  ``area`` is its signed
    area where that is at hand."""
    X, Y = F.col(xs), F.col(ys)
    n, idx = _cross_terms(X, Y)

    def moment(c):
        C = F.col(c)
        return F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + (C[i] + C[(i + 1) % n]) * (
            X[i] * Y[(i + 1) % n] - X[(i + 1) % n] * Y[i]))

    a6 = (ring_area(xs, ys, signed=True) if area is None else area) * F.lit(6.0)
    there = n >= 3
    return F.when(there, F.try_divide(moment(xs), a6)), F.when(there, F.try_divide(moment(ys), a6))


def polygon_measures(rings: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Area and centroid of polygons of several rings: ``ids``, area, cx, cy (J1, J5).  Without an
    area there is no centroid."""
    # the shoelace sum is a column of its own, made once for the area and both axes of the centroid
    shoelace = signed_rings(rings).select(*ids, "sign", "xs", "ys", ring_area(signed=True).alias("_s"))
    cx, cy = ring_centroid(area=F.col("_s"))
    each = shoelace.select(*ids, (F.col("sign") * F.abs("_s")).alias("_a"), cx.alias("_cx"), cy.alias("_cy"))
    total = F.sum("_a")
    return each.groupBy(*ids).agg(total.alias("area"), F.try_divide(F.sum(F.col("_a") * F.col("_cx")), total).alias("cx"),
                                  F.try_divide(F.sum(F.col("_a") * F.col("_cy")), total).alias("cy"))


def signed_rings(df: DataFrame) -> DataFrame:
    """``df`` with a ``sign`` for each ring: 1 where it has none."""
    return df if "sign" in df.columns else df.withColumn("sign", F.lit(1.0))


def with_bbox(df: DataFrame, xs: str = "xs", ys: str = "ys") -> DataFrame:
    return df.withColumns({"minx": F.array_min(xs), "maxx": F.array_max(xs),
                           "miny": F.array_min(ys), "maxy": F.array_max(ys)})


def grid_cell_size(df: DataFrame, quantile: float = 0.5) -> float:
    """A grid cell about the size of a typical polygon of ``df`` (the given
    quantile of its bounding-box extents).  Cells much smaller than the
    polygons multiply grid rows; much larger ones put many polygons in one
    cell.  One aggregate; only the resulting number reaches the driver."""
    b = with_bbox(df)
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    row = b.agg(F.percentile_approx(extent, quantile).alias("cell")).first()
    cell = row["cell"] if row is not None else None
    return float(cell) if cell and cell > 0 else 1.0


def with_level(df: DataFrame, cell: float) -> DataFrame:
    """The level of each box: cells of ``cell * 2**level`` are no smaller than it."""
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    level = F.when(extent > cell, F.ceil(F.log2(extent / F.lit(float(cell))))).otherwise(F.lit(0))
    return df.withColumn("level", level.cast("int"))


def _entered(df: DataFrame, cell: float, level: Column) -> DataFrame:
    """One row for each cell of ``level`` (a column, no finer than the box's own) that the box touches."""
    at = df.withColumn("gl", level).withColumn("_side", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("gl")))
    side = F.col("_side")
    at = at.withColumn("gx", F.explode(F.sequence(F.floor(F.col("minx") / side), F.floor(F.col("maxx") / side))))
    return at.withColumn("gy", F.explode(F.sequence(F.floor(F.col("miny") / side), F.floor(F.col("maxy") / side))))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: a few small numbers, whatever the layer's size."""
    return sorted(r["level"] for r in df.filter("level is not null").select("level").distinct().collect())


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{p}{c}") for c in df.columns])


def candidate_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of polygons (columns prefixed ``a_``/``b_``) whose bounding
    boxes intersect, each pair exactly once, plus the bounding box of the
    intersection (``minx..maxy``).  Inputs need ``minx..maxy`` columns."""
    a, b = (df if "level" in df.columns else with_level(df, cell) for df in (a, b))
    levels_a, levels_b = _levels(a), _levels(b)
    own = F.col("level")

    def coarser(levels: list[int], strictly: bool) -> Column:
        wanted = F.array(*[F.lit(x) for x in levels])
        return F.explode(F.filter(wanted, lambda x: x > own if strictly else x >= own))

    joins = []
    if levels_a and levels_b:
        if levels_b[-1] >= levels_a[0]:   # a's rings no larger than b's
            joins.append((_entered(a, cell, coarser(levels_b, False)), _entered(b, cell, own)))
        if levels_a[-1] > levels_b[0]:    # and the other way round
            joins.append((_entered(a, cell, own), _entered(b, cell, coarser(levels_a, True))))
    joins = joins or [(_entered(a, cell, own), _entered(b, cell, own))]
    parts = []
    for left, right in joins:
        ga, gb = _prefixed(left, "a_"), _prefixed(right, "b_")
        j = ga.join(gb, (ga.a_gl == gb.b_gl) & (ga.a_gx == gb.b_gx) & (ga.a_gy == gb.b_gy))
        j = j.withColumns({
            "minx": F.greatest("a_minx", "b_minx"), "maxx": F.least("a_maxx", "b_maxx"),
            "miny": F.greatest("a_miny", "b_miny"), "maxy": F.least("a_maxy", "b_maxy")})
        parts.append(j.filter((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))
                              & (F.floor(F.col("minx") / F.col("a__side")) == F.col("a_gx"))
                              & (F.floor(F.col("miny") / F.col("a__side")) == F.col("a_gy"))))
    boxes = [f"{p}{c}" for p in ("a_", "b_") for c in ("gl", "gx", "gy", "_side", "level", "minx", "maxx", "miny", "maxy")]
    return reduce(DataFrame.unionByName, parts).drop(*boxes)


# ------------------------------------------------- exact area, JVM side
#
# Sutherland-Hodgman clipping written with array higher-order functions
# (aggregate / transform / filter / flatten), evaluated in the JVM.  Rings
# are arrays of (x, y) structs.  Intermediate rings are bound once to a
# lambda variable (``bind``) so no sub-expression is evaluated twice.

_ids = itertools.count()


def _v(name):
    return f"{name}{next(_ids)}"


def ring(xs: str, ys: str) -> str:
    i = _v("i")
    none = "CAST(array() AS array<struct<x:double,y:double>>)"
    return f"IF(size({xs}) < 3, {none}, transform(sequence(0, size({xs}) - 1), {i} -> named_struct('x', CAST({xs}[{i}] AS DOUBLE), 'y', CAST({ys}[{i}] AS DOUBLE))))"


def bind(expr: str, body) -> str:
    """Evaluate ``expr`` once and use it through a lambda variable."""
    v = _v("b")
    return f"transform(array({expr}), {v} -> {body(v)})[0]"


def area_of(P: str) -> str:
    """Signed shoelace area of a bound ring variable."""
    acc, i = _v("acc"), _v("i")
    n = f"size({P})"
    nx = f"{P}[({i} + 1) % {n}]"
    return (f"CASE WHEN {n} < 3 THEN CAST(0 AS DOUBLE) ELSE aggregate(sequence(0, {n} - 1), CAST(0 AS DOUBLE), "
            f"({acc}, {i}) -> {acc} + {P}[{i}].x * {nx}.y - {nx}.x * {P}[{i}].y) / 2 END")


def ccw(R: str) -> str:
    return bind(R, lambda r: f"IF({area_of(r)} >= 0, {r}, reverse({r}))")


def clip_ring(S: str, C: str) -> str:
    """Sutherland-Hodgman: ring S clipped by the CCW convex ring C (C bound).

    For each clipper edge the side value of every vertex is computed once
    (bound with the ring), then each vertex emits itself when inside and the
    crossing point when the edge to the next vertex crosses the line."""
    P, k, i, q, v = _v("p"), _v("k"), _v("i"), _v("q"), _v("v")
    a, b = f"{C}[{k}]", f"{C}[({k} + 1) % size({C})]"
    side = f"(({b}.x - {a}.x) * ({v}.y - {a}.y) - ({b}.y - {a}.y) * ({v}.x - {a}.x))"

    def emit(e):
        n = f"size({e}.p)"
        j = f"({i} + 1) % {n}"
        cur, nxt = f"{e}.p[{i}]", f"{e}.p[{j}]"
        si, sn = f"{e}.s[{i}]", f"{e}.s[{j}]"
        t = f"try_divide({si}, {si} - {sn})"
        ipt = (f"named_struct('x', {cur}.x + {t} * ({nxt}.x - {cur}.x), "
               f"'y', {cur}.y + {t} * ({nxt}.y - {cur}.y))")
        return (f"flatten(transform(sequence(0, {n} - 1), {i} -> concat("
                f"filter(array({cur}), {q} -> {si} >= 0), "
                f"filter(array({ipt}), {q} -> ({si} >= 0) <> ({sn} >= 0)))))")
    with_sides = f"named_struct('p', {P}, 's', transform({P}, {v} -> {side}))"
    step = f"CASE WHEN size({P}) = 0 THEN {P} ELSE {bind(with_sides, emit)} END"
    return f"aggregate(sequence(0, size({C}) - 1), {S}, ({P}, {k}) -> {step})"


def fan(C: str) -> str:
    """Fan triangles of a bound CCW ring, each CCW, with its sign."""
    j = _v("j")
    p0, pj, pk = f"{C}[0]", f"{C}[{j}]", f"{C}[{j} + 1]"
    cr = f"(({pj}.x - {p0}.x) * ({pk}.y - {p0}.y) - ({pj}.y - {p0}.y) * ({pk}.x - {p0}.x))"
    return (f"transform(sequence(1, size({C}) - 2), {j} -> named_struct('s', signum({cr}), "
            f"'t', IF({cr} >= 0, array({p0}, {pj}, {pk}), array({p0}, {pk}, {pj}))))")


def convex(C: str) -> str:
    """True when the bound CCW ring turns left (or goes straight) at every vertex."""
    i = _v("i")
    n = f"size({C})"
    a, b, c = f"{C}[{i}]", f"{C}[({i} + 1) % {n}]", f"{C}[({i} + 2) % {n}]"
    return (f"forall(sequence(0, {n} - 1), {i} -> "
            f"({b}.x - {a}.x) * ({c}.y - {b}.y) - ({b}.y - {a}.y) * ({c}.x - {b}.x) >= 0)")


def pieces(C: str) -> str:
    """Signed convex pieces of a bound CCW ring: the ring itself when it is
    convex (one clip with all its edges), otherwise its fan triangles."""
    none = "CAST(array() AS array<struct<s:double,t:array<struct<x:double,y:double>>>>)"
    return (f"IF(size({C}) < 3, {none}, IF({convex(C)}, array(named_struct('s', CAST(1 AS DOUBLE), 't', {C})), {fan(C)}))")


def _nest(P: str, piece_lists: Sequence[str]) -> str:
    """Σ over the signed convex pieces of each further polygon of the area
    of the bound ring P clipped by them (recursively for a third polygon)."""
    if not piece_lists:
        return bind(P, area_of)
    acc, t = _v("acc"), _v("t")
    return (f"aggregate({piece_lists[0]}, CAST(0 AS DOUBLE), ({acc}, {t}) -> {acc} + {t}.s * "
            f"{bind(clip_ring(P, f'{t}.t'), lambda p: _nest(p, piece_lists[1:]))})")


def overlap_area(rings) -> str:
    """Area of the intersection of 2 or 3 rings given as (xs, ys) SQL exprs.

    area(A ∩ B ∩ C) = Σ_j Σ_k s_j s_k area(clip_ring(clip_ring(A, T_j), T_k)) over the
    signed convex pieces T of B and C (the polygon itself when convex, else
    its fan triangles); half-plane clipping keeps the area of any ring, so A
    may be concave."""
    first, *others = rings
    lists = [bind(ccw(ring(xs, ys)), pieces) for xs, ys in others]
    return f"greatest({bind(ccw(ring(*first)), lambda a: _nest(a, lists))}, CAST(0 AS DOUBLE))"


def overlap_area_expr(rings: Sequence[tuple[str, str]]) -> Column:
    """Column with the exact intersection area of 2 or 3 rings, each given
    by its x and y array column names."""
    return F.expr(overlap_area(list(rings)))


def prepared_ring(xs: str = "xs", ys: str = "ys") -> Column:
    """Per polygon, once: the ring as counter-clockwise (x, y) structs."""
    return F.expr(ccw(ring(xs, ys)))


def prepared_pieces(xs: str = "xs", ys: str = "ys") -> Column:
    """Per polygon, once: its signed convex pieces (itself when convex)."""
    return F.expr(bind(ccw(ring(xs, ys)), pieces))


def prepared_overlap_expr(subject_ring: str, piece_cols: Sequence[str]) -> Column:
    """Per pair: area of the subject ring intersected with polygons given as
    precomputed piece lists; only the clipping runs per pair."""
    return F.expr(f"greatest({_nest(subject_ring, list(piece_cols))}, CAST(0 AS DOUBLE))")


# ------------------------------------------------------------- cover
#
# A cell of a level stands for the box of twice its side whose lower-left corner it holds: a unit no
# larger than a cell, entered by its own lower-left corner, lies in that box whole.  A polygon is
# covered from coarse to fine: a cell whose box lies within it is inside and stays as it is, one
# whose box it only touches keeps the part of its outline there and is cut in four.  So cells
# grow with the border, and so do the pairs that have to be clipped.

#: share of a box by which an area may miss all or nothing of it and still count as that
ROUNDING = 1e-12


#: rounds after which a cover's cells are dealt out to all cores
SPREAD_AFTER = 3


def _box(x: str, y: str, width: str) -> str:
    at = [(x, y), (f"{x} + {width}", y), (f"{x} + {width}", f"{y} + {width}"), (x, f"{y} + {width}")]
    return "array(" + ", ".join(f"named_struct('x', {px}, 'y', {py})" for px, py in at) + ")"


def _cell(ring_var: str, level: str, gx: str, gy: str, cell: float) -> str:
    """A cell as a struct: whether its box lies inside the ring, its share of it, and the ring cut to the box."""
    side = f"({float(cell)!r}D * power(2D, {level}))"
    box = _box(f"{gx} * {side}", f"{gy} * {side}", f"2D * {side}")

    def judged(part: str) -> str:
        share = f"({area_of(part)} / (4D * {side} * {side}))"
        none = "CAST(NULL AS array<struct<x:double,y:double>>)"
        return bind(share, lambda s: f"named_struct('gl', CAST({level} AS INT), 'gx', CAST({gx} AS BIGINT), 'gy', CAST({gy} AS BIGINT), 'share', {s}, "
                                     f"'inside', {s} >= 1D - {ROUNDING!r}D, 'done', false, 'ring', IF({s} >= 1D - {ROUNDING!r}D, {none}, {part}))")

    return bind(box, lambda c: bind(clip_ring(ring_var, c), judged))


def top_level(*layers: DataFrame) -> int:
    """The coarsest level of layers with a ``level``: one small number for each."""
    found = [df.agg(F.max("level")).first()[0] for df in layers]
    return max((x for x in found if x is not None), default=0)


def cover(rings: DataFrame, cell: float, top: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` and, for each ring, its cells: gl, gx, gy, inside, and the signed convex pieces of the
    part of the ring in a cell's box (null where it is inside).

    ``rings`` has xs, ys; cells go from level ``top``, which no ring's box may exceed, down to 0.  A ring
    starts from nine cells at most; each round cuts the border's cells in four, in one pass over
    what the round before left, so the layer is read once, and a large outline is many rows, each
    with its own stretch of the border only."""
    side = f"({float(cell)!r}D * power(2D, {top}))"
    start = with_bbox(rings).withColumn("_ring", prepared_ring())
    for axis in ("x", "y"):
        start = start.withColumn(f"_{axis}", F.expr(f"explode(sequence(CAST(floor(min{axis} / {side}) AS BIGINT) - 1, CAST(floor(max{axis} / {side}) AS BIGINT)))"))
    cells = start.select(*keep, F.expr(_cell("_ring", str(top), "_x", "_y", cell)).alias("c")).filter(f"c.share > {ROUNDING!r}D")
    for level in range(top, 0, -1):
        if top - level == SPREAD_AFTER:  # by now a large outline is many rows: the finer rounds, which are most of the work, are dealt out
            cells = cells.repartition(rings.sparkSession.sparkContext.defaultParallelism, "c.gx", "c.gy")
        q = _v("q")
        child = _cell("c.ring", str(level - 1), f"(2 * c.gx + {q} % 2)", f"(2 * c.gy + {q} div 2)", cell)
        quarters = f"filter(transform(sequence(0, 3), {q} -> {child}), x -> x.share > {ROUNDING!r}D)"
        cut = f"concat(array(named_struct('gl', c.gl, 'gx', c.gx, 'gy', c.gy, 'share', c.share, 'inside', false, 'done', true, 'ring', c.ring)), {quarters})"
        cells = cells.select(*keep, F.explode(F.expr(f"IF(c.inside OR c.done, array(c), {cut})")).alias("c"))
    return cells.select(*keep, "c.gl", "c.gx", "c.gy", "c.inside", F.expr(f"IF(c.inside, NULL, {bind('c.ring', pieces)})").alias("pieces"))


def entered(units: DataFrame, cell: float, top: int, also: int | None = None) -> DataFrame:
    """A row for each unit and level from its own up to ``top``: its lower-left corner's cell.  With
    ``also``, one row more of that level, which no cell has."""
    levels = F.sequence(F.col("level"), F.lit(top))
    at = units.withColumn("_gl", F.explode(levels if also is None else F.concat(F.array(F.lit(also)), levels)))
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.greatest("_gl", F.lit(0)))
    return at.withColumns({"_gx": F.floor(F.col("minx") / side), "_gy": F.floor(F.col("miny") / side)})


def matched(units: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """Entered units with the cells (prefixed ``_c_``) they fall in: each unit meets a ring once at most, in
    an inside cell of any level or a border cell of its own."""
    c = _prefixed(cells, "_c_")
    here = (F.col("_gl") == F.col("_c_gl")) & (F.col("_gx") == F.col("_c_gx")) & (F.col("_gy") == F.col("_c_gy"))
    return units.join(c, here & (F.col("_c_inside") | (F.col("_c_gl") == F.col("level"))), how)


# ------------------------------------------------------------- crosswalk

def build_crosswalk(small: DataFrame, large: DataFrame, cell: float | None = None,
                    min_share: float = 0.20, clip: DataFrame | None = None) -> DataFrame:
    """Crosswalk of small units to large units.

    ``small`` and ``large`` carry ``xs``, ``ys``, ``sign`` where they have parts
    or holes, and their own id columns (distinct names).  With ``clip`` (polygons with ``xs``/``ys``), small
    units are first cut to the clip shape, and their areas are the clipped
    areas.  Keeps pairs holding at least ``min_share`` of the small unit's
    area; returns the id columns, ``prc_large_area`` and ``prc_small_area``.
    ``cell`` is the grid size, best about a small unit's; by default it is derived
    from the small layer (``grid_cell_size``).

    Units within a polygon take their own area; only those at its border are
    clipped.  Every layer is read and cut once: a unit's own area is one more
    row beside its pairs, summed with them.
    """
    small, large = signed_rings(small), signed_rings(large)
    if cell is None:
        cell = grid_cell_size(small)
    s_ids = [c for c in small.columns if c not in ("xs", "ys", "sign")]
    l_ids = [c for c in large.columns if c not in ("xs", "ys", "sign")]
    units = with_level(with_bbox(small), cell).filter("level is not null")
    clip = signed_rings(clip).select("xs", "ys", "sign") if clip is not None else None
    top = top_level(units, *(with_level(with_bbox(x), cell) for x in (large, clip) if x is not None))
    units = units.withColumn("ring", prepared_ring()).drop("xs", "ys")
    rest = ["sign", "minx", "miny", "level", "ring"]
    if clip is not None:
        met = matched(entered(units, cell, top), cover(clip, cell, top, ["sign"]))
        # whole where the unit lies inside, else once for each convex piece of the outline there
        whole = F.expr("array(named_struct('s', 1D, 't', CAST(NULL AS array<struct<x:double,y:double>>)))")
        met = met.withColumn("_piece", F.explode(F.when(F.col("_c_inside"), whole).otherwise(F.col("_c_pieces"))))
        units = met.select(*s_ids, (F.col("sign") * F.col("_c_sign") * F.col("_piece.s")).alias("sign"), "minx", "miny", "level",
                           F.expr(f"IF(_c_inside, ring, {clip_ring('ring', '_piece.t')})").alias("ring"))
    units = units.select(*s_ids, *rest).withColumn("area", F.col("sign") * F.expr(bind("ring", area_of)))
    total = F.sum(F.col("sign") * ring_area()).over(Window.partitionBy(*l_ids)) if l_ids else F.lit(0.0)
    cells = cover(large.withColumn("large_area", total), cell, top, [*l_ids, "sign", "large_area"]).withColumn("hit", F.lit(True))
    own, none = -1, F.col("_c_hit").isNull()
    pairs = matched(entered(units, cell, top, also=own), cells, "left").filter((F.col("_gl") == own) | ~none)
    clipped = F.col("sign") * F.col("_c_sign") * prepared_overlap_expr("ring", ["_c_pieces"])
    value = F.when(none, F.col("area")).when(F.col("_c_inside"), F.col("area") * F.col("_c_sign")).otherwise(clipped)
    sums = pairs.withColumn("_value", value).groupBy(*s_ids, *[f"_c_{c}" for c in l_ids], none.alias("_own")).agg(
        F.sum("_value").alias("_sum"), F.first("_c_large_area").alias("large_area"))
    small_area = F.max(F.when(F.col("_own"), F.col("_sum"))).over(Window.partitionBy(*s_ids))
    shares = sums.withColumn("small_area", small_area).filter(~F.col("_own") & (F.col("_sum") > 0))
    out = shares.select(
        *s_ids, *[F.col(f"_c_{c}").alias(c) for c in l_ids],
        F.try_divide(F.col("_sum"), F.col("large_area")).alias("prc_large_area"),
        F.try_divide(F.col("_sum"), F.col("small_area")).alias("prc_small_area"))
    return out.filter(F.col("prc_small_area") >= F.lit(float(min_share)))


def attach_crosswalk(df: DataFrame, xwalk: DataFrame, key: str) -> DataFrame:
    """Many-to-many left join of rows to their crosswalk areas (D2); Spark
    broadcasts the crosswalk where it measures it as small.  A unit in two areas
    counts fully in both (area totals may exceed the whole), as published.
    """
    return df.join(xwalk, key, "left")
