"""Precomputed rasters: figures classified over cells, their codes, symmetries, banks and look-ups.

A raster in long form has one row a cell: (tid, col, row, state) with states
0 outside, 1 cut, 2 inside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shapes import IN, MAYBE, OUT

Vertex = tuple[float, float, float, float, int]  # x, y, and of the edge that follows: arc centre and turn (0: straight)


def square(sx: float, sy: float, ex: float, ey: float) -> list[Vertex]:
    return [(sx, sy, 0, 0, 0), (ex, sy, 0, 0, 0), (ex, ey, 0, 0, 0), (sx, ey, 0, 0, 0)]


def box(side: float) -> list[Vertex]:
    """A square about the origin."""
    return square(-side / 2, -side / 2, side / 2, side / 2)


def circle(r: float) -> list[Vertex]:
    return [(0, -r, 0, 0, -1), (0, r, 0, 0, -1)]


def drop(width: float, height: float) -> list[Vertex]:
    """A tip at the origin under a half disc of radius `width` about (0, height)."""
    return [(-width, height, 0, height, -1), (width, height, 0, 0, 0), (0, 0, 0, 0, 0)]


def placed(ring: list[Vertex], scale: float = 1.0, degrees: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> list[Vertex]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def at(x, y):
        x, y = x * scale, y * scale
        return x * c - y * s + dx, x * s + y * c + dy

    return [(*at(x, y), *(at(xc, yc) if d else (0.0, 0.0)), d) for x, y, xc, yc, d in ring]


def flattened(ring: list[Vertex], step_degrees: float = 2.0) -> np.ndarray:
    """The ring as points; arcs are cut into short chords."""
    out = []
    for (x, y, xc, yc, d), (x2, y2, *_) in zip(ring, ring[1:] + ring[:1]):
        out.append((x, y))
        if d:
            r, a, b = math.hypot(x - xc, y - yc), math.atan2(y - yc, x - xc), math.atan2(y2 - yc, x2 - xc)
            sweep = (b - a) % (2 * math.pi) if d > 0 else -((a - b) % (2 * math.pi))
            n = max(1, round(abs(math.degrees(sweep)) / step_degrees))
            out += [(xc + r * math.cos(a + sweep * i / n), yc + r * math.sin(a + sweep * i / n)) for i in range(1, n)]
    return np.array(out)


def inside(ring: list[Vertex], x: np.ndarray, y: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Points in a ring of lines and arcs, exactly: chord crossings, corrected by the arcs' segments.

    The boundary counts as inside.
    """
    odd = np.zeros(len(x), dtype=bool)
    on = np.zeros(len(x), dtype=bool)
    for (ax, ay, xc, yc, d), (bx, by, *_) in zip(ring, ring[1:] + ring[:1]):
        spans = (y >= min(ay, by)) & (y < max(ay, by))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if ay != by:
            # An arc's chord and segment are judged by one sign, so that rounding moves a point across both or none.
            odd ^= spans & ((cross > 0 if by > ay else cross < 0) if d else (y - ay) * ((bx - ax) / (by - ay)) + ax > x)
        if d:
            r2 = (ax - xc) ** 2 + (ay - yc) ** 2
            d2 = (x - xc) ** 2 + (y - yc) ** 2
            # Between chord and arc: right of the chord for a counter-clockwise arc, left for the other turn.
            outer = cross < 0 if d > 0 else cross > 0
            # On the chord itself: as a point a little to the right and above, which is how crossings are counted.
            if d * ((by - ay) or (ax - bx)) > 0:
                outer = outer | (cross == 0)
            odd ^= outer & (d2 < r2)
            on |= (outer | (cross == 0)) & (np.abs(d2 - r2) <= eps * max(r2, 1.0))
        else:
            on |= (np.abs(cross) <= eps) & (x >= min(ax, bx) - eps) & (x <= max(ax, bx) + eps) & (y >= min(ay, by) - eps) & (y <= max(ay, by) + eps)
    return odd | on


def _sweep(ax: float, ay: float, bx: float, by: float, xc: float, yc: float, d: int) -> tuple[float, float, float]:
    """Radius, first angle and signed sweep of an arc."""
    a, b = math.atan2(ay - yc, ax - xc), math.atan2(by - yc, bx - xc)
    return math.hypot(ax - xc, ay - yc), a, (b - a) % (2 * math.pi) if d > 0 else -((a - b) % (2 * math.pi))


def bounds(ring: list[Vertex]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest corner of a ring; arcs count with the extremes that they pass."""
    p = [(x, y) for x, y, *_ in ring]
    for (ax, ay, xc, yc, d), (bx, by, *_) in zip(ring, ring[1:] + ring[:1]):
        if d:
            r, a, sweep = _sweep(ax, ay, bx, by, xc, yc, d)
            for quarter, (ux, uy) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1))):
                if (quarter * math.pi / 2 - a) * d % (2 * math.pi) <= abs(sweep):
                    p.append((xc + r * ux, yc + r * uy))
    return np.min(p, axis=0), np.max(p, axis=0)


def traced(ring: list[Vertex], x0: float, y0: float, cw: float, ch: float) -> np.ndarray:
    """(n, 2) cells that the outline passes through: every edge is cut at all grid lines, and each piece lies in one cell.

    A straight edge along a grid line passes through no cell.
    """
    out = [np.empty((0, 2), int)]
    for (ax, ay, xc, yc, d), (bx, by, *_) in zip(ring, ring[1:] + ring[:1]):
        t = [np.array([0.0, 1.0])]
        r, a, sweep = _sweep(ax, ay, bx, by, xc, yc, d) if d else (0.0, 0.0, 0.0)
        along = False
        for axis, (p, q, c, o, size) in enumerate(((ax, bx, xc, x0, cw), (ay, by, yc, y0, ch))):
            lo, hi = ((c - r, c + r) if d else (min(p, q), max(p, q)))
            lines = np.arange(math.ceil((lo - o) / size), math.floor((hi - o) / size) + 1) * size + o
            if d:
                turn = np.arccos(np.clip((lines - c) / r, -1, 1)) if axis == 0 else np.arcsin(np.clip((lines - c) / r, -1, 1))
                for angle in (turn, -turn if axis == 0 else math.pi - turn):
                    t.append((angle - a) * d % (2 * math.pi) / abs(sweep))
            elif p != q:
                t.append((lines - p) / (q - p))
            else:
                along |= len(lines) > 0
        if along:
            continue
        t = np.unique(np.concatenate(t))
        t = t[(t >= 0) & (t <= 1)]
        mid = (t[:-1] + t[1:])[np.diff(t) > 1e-12] / 2
        x, y = (xc + r * np.cos(a + sweep * mid), yc + r * np.sin(a + sweep * mid)) if d else (ax + (bx - ax) * mid, ay + (by - ay) * mid)
        out.append(np.floor(np.stack([(x - x0) / cw, (y - y0) / ch], axis=1)).astype(int))
    return np.concatenate(out)


def classify(ring: list[Vertex], x0: float, y0: float, cols: int, rows: int, cw: float, ch: float) -> np.ndarray:
    """(rows, cols) of cell states: cut where the outline passes or a corner differs."""
    gx, gy = np.meshgrid(x0 + cw * np.arange(cols + 1), y0 + ch * np.arange(rows + 1))
    corner = inside(ring, gx.ravel(), gy.ravel()).reshape(gx.shape)
    every = corner[:-1, :-1] & corner[:-1, 1:] & corner[1:, :-1] & corner[1:, 1:]
    some = corner[:-1, :-1] | corner[:-1, 1:] | corner[1:, :-1] | corner[1:, 1:]
    state = np.where(every, IN, np.where(some, MAYBE, OUT)).astype(np.uint8)
    p = traced(ring, x0, y0, cw, ch)
    p = p[((p >= 0) & (p < (cols, rows))).all(axis=1)]
    state[p[:, 1], p[:, 0]] = MAYBE
    return state


#: Names of the eight symmetries, in the order of ``symmetries``.
SYMMETRIES = ("eq", "rCC", "rC", "r180", "fLR", "fTB", "fTLBR", "fTRBL")


def symmetries(m: np.ndarray) -> list[np.ndarray]:
    return [m, np.rot90(m, -1), np.rot90(m), np.rot90(m, 2), m[:, ::-1], m[::-1], m.T, np.rot90(m, 2).T]


def undo(m: np.ndarray, name: str) -> np.ndarray:
    """The raster whose symmetry `name` is m."""
    back = {"rCC": "rC", "rC": "rCC"}.get(name, name)
    return symmetries(m)[SYMMETRIES.index(back)]


def code(m: np.ndarray) -> bytes:
    """Lossless code: 4 header bytes (rows, columns), then 2 bits a cell in row order, the last byte padded."""
    rows, cols = m.shape
    flat = np.concatenate([m.ravel(), np.zeros(-m.size % 4, np.uint8)]).reshape(-1, 4)
    return rows.to_bytes(2, "little") + cols.to_bytes(2, "little") + (flat << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def decode(b: bytes) -> np.ndarray:
    if len(b) < 4:
        raise ValueError("too short for a raster header")
    rows, cols = int.from_bytes(b[:2], "little"), int.from_bytes(b[2:4], "little")
    if len(b) < 4 + -(-rows * cols // 4):
        raise ValueError("truncated raster")
    flat = np.frombuffer(b, np.uint8, offset=4)
    return ((flat[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel()[: rows * cols].reshape(rows, cols).astype(np.uint8)


def canonical(m: np.ndarray) -> tuple[bytes, str]:
    """Least code among the symmetries of a raster, and the symmetry that turns the stored raster back into m."""
    best = min(range(8), key=lambda i: (code(symmetries(m)[i]), i))
    back = {"rCC": "rC", "rC": "rCC"}.get(SYMMETRIES[best], SYMMETRIES[best])
    return code(symmetries(m)[best]), back


# The figures and angles of the fingerprint.
FIGURES = {"drop": drop(0.2, 0.8), "circle": circle(1.0), "box": box(1.0), "square": square(0.0, 0.0, 0.5, 0.7)}
FINGERPRINT_ANGLES = [0.0, 15.0, 30.0, 45.0, 90.0, 135.0, 180.0, 270.0]


def angles(step: float) -> list[float]:
    return [i * step for i in range(math.ceil(360 / step))]


def subtasks(spark: SparkSession, figures: list[str], scales: list[float], cells: list[int], step: float | list[float], most: int = 500_000) -> DataFrame:
    """(figure, scale, cell, angle, task): the work of a bank, in tasks of at most about `most` rasters; angles by step or as a list."""
    rows = spark.createDataFrame([(f, float(s), c) for f in figures for s in scales for c in cells], "figure string, scale double, cell int")
    out = rows.withColumn("angle", F.explode(F.array(*(F.lit(float(a)) for a in (step if isinstance(step, list) else angles(step))))))
    per = F.col("cell") * F.col("cell")
    n = F.sum(per).over(Window.partitionBy("figure", "scale", "cell").orderBy("angle"))
    return out.withColumn("task", F.floor((n - 1) / most).cast("int"))


BANK = "figure string, scale double, cell int, angle double, dx int, dy int, rows int, cols int, code binary, op string"


def bank(tasks: DataFrame, figures: dict[str, list[Vertex]] = FIGURES) -> DataFrame:
    """Every integer offset of every angle, classified; ``code`` is the canonical raster and ``op`` turns it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.to_pylist():
                for dx in range(t["cell"]):
                    for dy in range(t["cell"]):
                        m = raster(figures[t["figure"]], t["scale"], t["angle"], t["cell"], dx, dy)
                        c, op = canonical(m)
                        out.append((t["figure"], t["scale"], t["cell"], t["angle"], dx, dy, *m.shape, c, op))
            names = [x.split()[0] for x in BANK.split(", ")]
            types = [pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names)

    return tasks.repartition("figure", "cell", "angle").mapInArrow(run, BANK)


def raster(ring: list[Vertex], scale: float, degrees: float, cell: int, dx: int = 0, dy: int = 0) -> np.ndarray:
    """A figure over the lattice of `cell`, its origin at (dx, dy) of a cell."""
    figure = placed(ring, scale, degrees, dx, dy)
    lo, hi = bounds(figure)
    c0, r0 = (int(math.floor(v)) for v in lo / cell)
    c1, r1 = (int(math.floor(v)) + 1 for v in hi / cell)
    return classify(figure, c0 * cell, r0 * cell, c1 - c0, r1 - r0, cell, cell)


def unique(entries: DataFrame) -> DataFrame:
    """Entries with the id of their stored raster: equal canonical codes share the least key."""
    codes = entries.groupBy("code").agg(F.min(F.struct("figure", "scale", "cell", "angle", "dx", "dy")).alias("stored"))
    return entries.join(codes, "code").withColumn("tid", F.xxhash64("code"))


def bank_statistics(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.countDistinct("code").alias("stored"), F.sum(F.length("code")).alias("bytes"))


# Rasters in long form: plain column work.

def aggregate(cells: DataFrame, fx: int, fy: int, tid: str = "tid") -> DataFrame:
    """Cells merged fx by fy: inside if all are, outside if all are, else cut; absent cells are outside."""
    g = cells.groupBy(tid, F.floor(F.col("col") / fx).cast("int").alias("col"), F.floor(F.col("row") / fy).cast("int").alias("row"))
    merged = g.agg(F.min("state").alias("a"), F.max("state").alias("z"), F.count("*").alias("n"))
    full = F.col("n") == fx * fy
    return merged.select(tid, "col", "row", F.when((F.col("a") == IN) & full, IN).when(F.col("z") == OUT, OUT).otherwise(MAYBE).cast("int").alias("state"))


def look_up(points: DataFrame, cells: DataFrame, x: Column, y: Column, cell_w: float, cell_h: float, tid: str = "tid") -> DataFrame:
    """Points with the state of their cell; outside where there is none."""
    at = points.withColumns({"col": F.floor(x / cell_w).cast("int"), "row": F.floor(y / cell_h).cast("int")})
    return at.join(cells, [tid, "col", "row"], "left").withColumn("state", F.coalesce("state", F.lit(OUT)))


def classify_region(cells: DataFrame, lo: tuple[int, int], hi: tuple[int, int], tid: str = "tid") -> DataFrame:
    """(tid, state) of an inclusive range of cells."""
    n = (hi[0] - lo[0] + 1) * (hi[1] - lo[1] + 1)
    part = cells.where(F.col("col").between(lo[0], hi[0]) & F.col("row").between(lo[1], hi[1])).groupBy(tid).agg(F.min("state").alias("a"), F.max("state").alias("z"), F.count("*").alias("n"))
    state = F.when((F.col("a") == IN) & (F.col("n") == n), IN).when(F.coalesce("z", F.lit(OUT)) == OUT, OUT).otherwise(MAYBE)
    return cells.select(tid).distinct().join(part, tid, "left").select(tid, state.cast("int").alias("state"))


def resolve(placements: DataFrame, entries: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """Placements joined with the bank entry of their offset within a cell."""
    at = placements.withColumns({"dx": F.pmod(F.col(x).cast("int"), F.col("cell")), "dy": F.pmod(F.col(y).cast("int"), F.col("cell"))})
    return at.join(entries, ["figure", "scale", "cell", "angle", "dx", "dy"])


def resolve_scaled(placements: DataFrame, entries: DataFrame, factor: int) -> DataFrame:
    """A figure `factor` times as large over cells `factor` times as wide is the stored one; only exact fits."""
    fits = placements.where((F.col("cell") % factor == 0) & (F.col("px") % factor == 0) & (F.col("py") % factor == 0))
    small = fits.withColumns({"cell": (F.col("cell") / factor).cast("int"), "scale": F.col("scale") / factor, "px": (F.col("px") / factor).cast("int"), "py": (F.col("py") / factor).cast("int")})
    return resolve(small, entries)


CELL_CENTRE, CELL_CORNER = (0.5, 0.5, 0.5), (0.0, 0.0, 0.0)


def stencil(spark: SparkSession, radius: float, phase: tuple[float, float, float] = CELL_CENTRE) -> DataFrame:
    """Unit cells of a sphere by row: (dy, dz, touch0, touch1, full0, full1), empty full runs null.

    ``phase`` is where the centre lies in its cell.
    """
    n = math.ceil(radius) + 1
    span = spark.range(-n, n + 1).select(F.col("id").cast("int").alias("v"))
    cells = span.select(F.col("v").alias("dy")).crossJoin(span.select(F.col("v").alias("dz"))).withColumn("dx", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    near, far = F.lit(0.0), F.lit(0.0)
    for c, e in zip(("dx", "dy", "dz"), phase):
        lo, hi = F.col(c) - F.lit(float(e)), F.col(c) + F.lit(1.0 - e)
        gap, reach = F.greatest(lo, F.lit(0.0), -hi), F.greatest(F.abs(lo), F.abs(hi))
        near, far = near + gap * gap, far + reach * reach
    r2 = float(radius) * float(radius)
    full = F.when(far <= r2, F.col("dx"))
    return cells.where(near <= r2).groupBy("dy", "dz").agg(F.min("dx").alias("touch0"), F.max("dx").alias("touch1"), F.min(full).alias("full0"), F.max(full).alias("full1"))


def voxels(spark: SparkSession, shape, origin: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(ix, iy, iz, state) of the unit cells of a box for any 3D shape; outside cells are left out."""
    axes = [spark.range(o, o + s).select(F.col("id").alias(n)) for o, s, n in zip(origin, size, ("ix", "iy", "iz"))]
    cells = axes[0].crossJoin(axes[1]).crossJoin(axes[2])
    lo = [F.col(c).cast("double") for c in ("ix", "iy", "iz")]
    return cells.withColumn("state", shape.classify(lo, [v + 1.0 for v in lo]).cast("int")).where(F.col("state") > OUT)
