"""Brute-force reference for polygon intersection areas (NumPy, one tuple
of rings at a time), used to check the JVM-side expression in
``indicata.operators.crosswalk``."""

from __future__ import annotations

from typing import Sequence

import numpy as np


def _signed_area(px: np.ndarray, py: np.ndarray) -> float:
    return 0.5 * float(np.dot(px, np.roll(py, -1)) - np.dot(np.roll(px, -1), py))


def _fan(xs, ys):
    """Triangles of the fan from vertex 0, counter-clockwise, with the sign
    that makes their signed sum the polygon's indicator."""
    xs = np.asarray(xs, dtype=float)
    ys = np.asarray(ys, dtype=float)
    total = _signed_area(xs, ys)
    if total == 0 or len(xs) < 3:
        return []
    orient = 1.0 if total > 0 else -1.0
    out = []
    for i in range(1, len(xs) - 1):
        tri = np.array([[xs[0], ys[0]], [xs[i], ys[i]], [xs[i + 1], ys[i + 1]]])
        a = _signed_area(tri[:, 0], tri[:, 1])
        if a == 0:
            continue
        if a < 0:
            tri = tri[::-1]
        out.append((tri, (1.0 if a > 0 else -1.0) * orient,
                    tri[:, 0].min(), tri[:, 0].max(), tri[:, 1].min(), tri[:, 1].max()))
    return out


def _clip(subject: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: subject polygon clipped by a CCW convex clipper."""
    out = subject
    m = len(clipper)
    for k in range(m):
        if len(out) == 0:
            break
        ax, ay = clipper[k]
        bx, by = clipper[(k + 1) % m]
        ex, ey = bx - ax, by - ay
        side = ex * (out[:, 1] - ay) - ey * (out[:, 0] - ax)   # >= 0 inside
        res = []
        n = len(out)
        for i in range(n):
            j = (i + 1) % n
            si, sj = side[i], side[j]
            if si >= 0:
                res.append(out[i])
            if (si >= 0) != (sj >= 0):
                t = si / (si - sj)
                res.append(out[i] + t * (out[j] - out[i]))
        out = np.array(res) if res else np.empty((0, 2))
    return out


def _ccw(xs, ys) -> np.ndarray:
    pts = np.column_stack([np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)])
    return pts[::-1] if _signed_area(pts[:, 0], pts[:, 1]) < 0 else pts


def _is_convex(pts: np.ndarray) -> bool:
    d = np.roll(pts, -1, axis=0) - pts
    cross = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    return bool(np.all(cross >= 0))


def intersection_area(rings: Sequence[tuple]) -> float:
    """Exact area of the intersection of simple polygons.

    One polygon (a concave one if there is any) is the subject; every
    convex polygon clips it directly, half-plane by half-plane.  Half-plane
    clipping keeps the area of any closed ring, so the subject may be
    concave.  Further concave polygons are fanned into signed triangles and
    the clipped areas are summed with the triangle signs.
    """
    polys = [_ccw(x, y) for x, y in rings]
    if any(len(p) < 3 or _signed_area(p[:, 0], p[:, 1]) == 0 for p in polys):
        return 0.0
    convex = [_is_convex(p) for p in polys]
    subject_i = next((i for i, c in enumerate(convex) if not c), 0)
    subject = polys[subject_i]
    sx0, sx1 = subject[:, 0].min(), subject[:, 0].max()
    sy0, sy1 = subject[:, 1].min(), subject[:, 1].max()
    factors = []
    for i, p in enumerate(polys):
        if i == subject_i:
            continue
        if convex[i]:
            factors.append([(p, 1.0)])
        else:
            factors.append([(tri, sign) for tri, sign, *_ in _fan(p[:, 0], p[:, 1])])

    def walk(poly, k, sign):
        if k == len(factors):
            return sign * _signed_area(poly[:, 0], poly[:, 1])
        acc = 0.0
        for clipper, s in factors[k]:
            if (clipper[:, 0].min() > sx1 or clipper[:, 0].max() < sx0
                    or clipper[:, 1].min() > sy1 or clipper[:, 1].max() < sy0):
                continue
            q = _clip(poly, clipper)
            if len(q) >= 3:
                acc += walk(q, k + 1, sign * s)
        return acc

    return max(walk(subject, 0, 1.0), 0.0)
