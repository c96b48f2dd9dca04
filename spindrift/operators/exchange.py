"""Rasters in their exchange format, their fingerprint, and the reuse of stored ones over coarser cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rasters import FIGURES, FINGERPRINT_ANGLES, aggregate, bounds, classify, placed, resolve

# Cells of the fingerprint (width, height), and its scale.
FINGERPRINT_GRIDS = ((1, 1), (8, 8), (16, 16), (8, 16))
FINGERPRINT_SCALE = 32.0


def bin_code(m: np.ndarray) -> bytes:
    """Width and height in a byte each, then 2 bits a cell in row order, first cell highest.

    Fixed format: cells after the last full byte are left out, and sizes wrap at 256.
    """
    rows, cols = m.shape
    full = m.ravel()[: m.size // 4 * 4].reshape(-1, 4).astype(np.uint8)
    return bytes((cols & 255, rows & 255)) + (full << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def decode_binary(b: bytes) -> np.ndarray:
    """The raster of a `bin_code`; cells that the format leaves out are outside.

    Fewer than two bytes, or fewer than the full bytes of the header's size, are an error.
    """
    if len(b) < 2:
        raise ValueError("too short for a raster header")
    cols, rows = b[0], b[1]
    n = rows * cols // 4
    if len(b) < 2 + n:
        raise ValueError("truncated raster")
    body = np.frombuffer(b, np.uint8, count=n, offset=2)
    out = np.zeros(rows * cols, np.uint8)
    out[: n * 4] = ((body[:, None] >> np.array([6, 4, 2, 0])) & 3).ravel()
    return out.reshape(rows, cols)


def fingerprint(spark: SparkSession, angles: list[float] = FINGERPRINT_ANGLES, grids=FINGERPRINT_GRIDS) -> DataFrame:
    """(figure, scale, angle, cell_w, cell_h, ox, oy, code): every offset of every figure, the code in hexadecimal.

    One task row a column of offsets; the rasters are computed where it lands.
    """
    work = [(f, float(a), w, h, x) for f in sorted(FIGURES) for a in angles for w, h in grids for x in range(w)]
    tasks = spark.createDataFrame(work, "figure string, angle double, cell_w int, cell_h int, ox int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {n: [] for n in ("figure", "scale", "angle", "cell_w", "cell_h", "ox", "oy", "code")}
            for t in b.to_pylist():
                w, h = t["cell_w"], t["cell_h"]
                for oy in range(h):
                    ring = placed(FIGURES[t["figure"]], FINGERPRINT_SCALE, t["angle"], t["ox"], oy)
                    lo, hi = bounds(ring)
                    (c0, r0), (c1, r1) = np.floor(lo / (w, h)).astype(int), np.ceil(hi / (w, h)).astype(int)
                    m = classify(ring, c0 * w, r0 * h, c1 - c0, r1 - r0, w, h)
                    for n, v in zip(out, (t["figure"], FINGERPRINT_SCALE, t["angle"], w, h, t["ox"], oy, bin_code(m).hex())):
                        out[n].append(v)
            types = (pa.string(), pa.float64(), pa.float64(), *[pa.int32()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), types)], list(out))

    schema = "figure string, scale double, angle double, cell_w int, cell_h int, ox int, oy int, code string"
    return tasks.repartition("figure", "angle", "cell_w", "cell_h", "ox").mapInArrow(run, schema)


def translated(cells: DataFrame, cols: int, rows: int) -> DataFrame:
    """A raster in long form, moved by whole cells."""
    return cells.withColumns({"col": F.col("col") + cols, "row": F.col("row") + rows})


def boxes(cells: DataFrame, cell_w: float, cell_h: float, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """Cells with their boxes in the world: a raster placed at (x, y) and scaled to cells of that size."""
    lo_x, lo_y = F.col("col") * cell_w + x, F.col("row") * cell_h + y
    return cells.withColumns({"lo_x": lo_x, "lo_y": lo_y, "hi_x": lo_x + cell_w, "hi_y": lo_y + cell_h})


def largest_divisor(cell: int, stored: list[int]) -> int | None:
    """The largest stored cell size that divides `cell`, itself included."""
    return max((s for s in stored if s > 0 and cell % s == 0), default=None)


def resolve_or_aggregated(placements: DataFrame, entries: DataFrame, cells: DataFrame, stored: list[int], cell: int) -> DataFrame:
    """(pid, col, row, state) of placements over cells of size `cell`, anchored to the lattice of the world.

    placements: pid, figure, scale, angle, px, py (whole numbers).  cells: the rasters of
    `entries` by tid, columns and rows counted from the cell that holds the figure's origin.
    Where `cell` itself is not stored, the set of its largest divisor is merged; without one
    the result has no rows.
    """
    size = largest_divisor(cell, stored)
    at = placements.withColumn("cell", F.lit(size or cell))
    found = resolve(at, entries.where(F.col("cell") == (size or cell))).select("pid", "px", "py", "tid")
    step = size or cell
    world = found.join(cells, "tid").select("pid", *((F.floor(F.col(p) / step) + F.col(c)).cast("int").alias(c) for p, c in (("px", "col"), ("py", "row"))), "state")
    return world if step == cell else aggregate(world, cell // step, cell // step, tid="pid")


def point_raster(placements: DataFrame, entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Placements over cells of one unit: what a figure says of every whole point."""
    return resolve_or_aggregated(placements, entries, cells, [1], 1)
