"""Figures with straight and arc edges: membership of points, relations of figures, dilation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.rasters import Vertex, flattened, inside


def completely_contains(outer: list[Vertex], inner: list[Vertex]) -> bool:
    """Whether every point of inner lies in outer and their outlines do not cross."""
    p = flattened(inner)
    return bool(inside(outer, p[:, 0], p[:, 1], 1e-6).all()) and not outlines_cross(outer, inner)


def outlines_cross(a: list[Vertex], b: list[Vertex]) -> bool:
    """Whether the outlines properly cross; arcs are taken as short chords."""
    p, q = flattened(a), flattened(b)
    p2, q2 = np.roll(p, -1, axis=0), np.roll(q, -1, axis=0)

    def side(u, v, w):
        return (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])

    p, p2, q, q2 = p[:, None], p2[:, None], q[None], q2[None]
    return bool(((side(p, p2, q) * side(p, p2, q2) < 0) & (side(q, q2, p) * side(q, q2, p2) < 0)).any())


def figures_meet(a: list[Vertex], b: list[Vertex]) -> bool:
    """Whether two figures share a point."""
    p, q = flattened(a), flattened(b)
    return outlines_cross(a, b) or bool(inside(a, q[:, 0], q[:, 1]).any() or inside(b, p[:, 0], p[:, 1]).any())


def inflated_convex(ring: list[Vertex], r: float) -> list[Vertex]:
    """Dilation of a convex figure: edges move outward, arcs of radius r join them."""
    p = flattened(ring)
    q = np.roll(p, -1, axis=0)
    turn = 1 if (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() > 0 else -1  # counter-clockwise or not
    out: list[Vertex] = []
    for (x, y, xc, yc, d), (x2, y2, *_) in zip(ring, ring[1:] + ring[:1]):
        if d:
            rho = math.hypot(x - xc, y - yc)
            grow = (rho + r) / rho
            a, b = (xc + (x - xc) * grow, yc + (y - yc) * grow), (xc + (x2 - xc) * grow, yc + (y2 - yc) * grow)
            out += [(*a, xc, yc, turn), (*b, x2, y2, turn)]
        else:
            n = math.hypot(x2 - x, y2 - y)
            ox, oy = turn * (y2 - y) / n * r, -turn * (x2 - x) / n * r
            out += [(x + ox, y + oy, 0.0, 0.0, 0), (x2 + ox, y2 + oy, x2, y2, turn)]
    # An arc between coinciding ends is none.
    kept = []
    for v, w in zip(out, out[1:] + out[:1]):
        if not (v[4] and math.hypot(v[0] - w[0], v[1] - w[1]) < 1e-12):
            kept.append(v)
    return kept


def points_in_figures(points: DataFrame, figures: dict[int, list[Vertex]], id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(fid, id): points in each of a few figures, tested in Arrow batches behind their bounding boxes."""
    boxes = {f: flattened(ring) for f, ring in figures.items()}
    bounds = {f: (*(p.min(axis=0) - 1e-9), *(p.max(axis=0) + 1e-9)) for f, p in boxes.items()}
    # Chords cut arcs short: widen by the largest sagitta.
    slack = {f: max((math.hypot(v[0] - v[2], v[1] - v[3]) for v in ring if v[4]), default=0.0) * (1 - math.cos(math.radians(1.0))) for f, ring in figures.items()}

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, px, py = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for f, ring in figures.items():
                x0, y0, x1, y1 = bounds[f]
                s = slack[f]
                at = np.flatnonzero((px >= x0 - s) & (px <= x1 + s) & (py >= y0 - s) & (py <= y1 + s))
                hit = at[inside(ring, px[at], py[at])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), f, np.int64)), pa.array(ids[hit], pa.int64())], ["fid", "id"])

    return points.select(id, x, y).mapInArrow(test, "fid long, id long")
