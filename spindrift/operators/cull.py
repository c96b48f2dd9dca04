"""Range queries: points inside regions, for one shape or for a table of shapes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import IN, MAYBE, Shape, ball_contains, capsule_distance2
from ..plans import planner
from ..sources.points import PointFrame


def cull(points: PointFrame, shape: Shape, where: Column | None = None) -> DataFrame:
    """Points inside one shape: a filter whose bounding box reaches the scan."""
    found = points.df.where(shape.contains(*points.coords[: shape.dims]))
    return found if where is None else found.where(where)


def cull_layered(points: PointFrame, shape: Shape, levels: int, shift: int = 2, most_cells: int = 100_000) -> DataFrame:
    """The same answer through a coarse tier.

    The coarse cells that the shape's box meets are classified once each; points
    join their cell, those of cells inside pass and only those of cut cells are
    tested.  The box reaches the scan.  The cells are broadcast: a coarser tier is
    taken while there would be more than `most_cells`.
    """
    def span(level: int) -> list[tuple[int, int]]:
        index = lambda v, w, size: max(0, min((1 << level) - 1, math.floor((v - w[0]) / size)))
        return [(index(lo, w, size), index(hi, w, size)) for (lo, hi), w, size in zip(shape.bounds(), points.world, points.cell_sizes(level))]

    coarse = max(1, levels - shift)
    while coarse > 1 and math.prod(z - a + 1 for a, z in span(coarse)) > most_cells:
        coarse -= 1
    many, below = span(coarse), F.col("id")
    indices, lo, hi = [], [], []
    for (a, z), w, size in zip(many, points.world, points.cell_sizes(coarse)):
        i = below % (z - a + 1) + a
        below = F.floor(below / (z - a + 1))
        indices.append(i)
        lo.append(i * size + w[0])
        hi.append((i + 1) * size + w[0])
    names = [f"__i{k}" for k in range(len(many))]
    grid = points.df.sparkSession.range(math.prod(z - a + 1 for a, z in many)).select(*(i.cast("long").alias(n) for i, n in zip(indices, names)), shape.classify(lo, hi).alias("__state"))
    near = points.df.where(shape.in_bounds(*points.coords[: shape.dims])).withColumns(dict(zip(names, points.cell_indices(coarse))))
    sure = F.col("__state") == IN
    for c, (a, z) in zip(points.coords, points.world):
        sure = sure & (F.col(c) >= a) & (F.col(c) < z)
    found = near.join(F.broadcast(grid.where(F.col("__state").isin(IN, MAYBE))), names)
    return found.where(sure | shape.contains(*points.coords[: shape.dims])).select(*points.df.columns)


def cull_canonical(points: PointFrame, shape: Shape) -> DataFrame:
    """``cull`` in the one order that no layout changes: by id."""
    return cull(points, shape).orderBy(points.id)


def cull_walk(points: PointFrame, shape: Shape, seed: tuple[float, ...]) -> DataFrame:
    """Flood fill from a seed: the plain answer if the seed lies in the world, else nothing."""
    inside = all(lo <= s < hi for s, (lo, hi) in zip(seed, points.world))
    return cull(points, shape) if inside else points.df.limit(0)


@dataclass(frozen=True)
class Batch:
    """A table of shapes: how a row bounds space and what it contains."""

    df: DataFrame
    lo: tuple[Column, ...]
    hi: tuple[Column, ...]
    test: object  # (point columns) -> Column


def balls(df: DataFrame, centre=("qx", "qy"), radius: str = "r") -> Batch:
    return Batch(df, tuple(F.col(c) - F.col(radius) for c in centre), tuple(F.col(c) + F.col(radius) for c in centre), lambda p: ball_contains(p, list(centre), F.col(radius)))


def capsules(df: DataFrame, a=("ax", "ay"), b=("bx", "by"), radius: str = "r") -> Batch:
    return Batch(
        df, tuple(F.least(x, y) - F.col(radius) for x, y in zip(a, b)), tuple(F.greatest(x, y) + F.col(radius) for x, y in zip(a, b)),
        lambda p: capsule_distance2(p, list(a), list(b)) <= F.col(radius) * F.col(radius),
    )


def boxes(df: DataFrame, lo=("x0", "y0"), hi=("x1", "y1")) -> Batch:
    def test(p):
        out = F.lit(True)
        for v, a, z in zip(p, lo, hi):
            out = out & (v >= F.col(a)) & (v < F.col(z))
        return out

    return Batch(df, tuple(map(F.col, lo)), tuple(map(F.col, hi)), test)


def cull_many(points: PointFrame, batch: Batch, cell: float | None = None, strategy: str = "auto", most_cells: int = 4096) -> DataFrame:
    """Every (shape, point) pair with the point inside the shape; all columns of both.

    nested: the shapes are broadcast (their number is checked).  cells: both sides
    are keyed by grid cell and joined on the key, then tested; a shape over more
    than `most_cells` cells goes to the nested arm if few do, else it is cut by
    a coarser grid.
    """
    dims = len(batch.lo)
    p = [F.col(c) for c in points.coords[:dims]]
    if strategy == "auto":
        few = planner.counted(batch.df, planner.BROADCAST_QUERIES)
        strategy = "nested" if few <= planner.BROADCAST_QUERIES and few * points.df.count() <= planner.NESTED_PAIRS else "cells"
    box = F.lit(True)
    for v, a, z in zip(p, batch.lo, batch.hi):
        box = box & (v >= a) & (v <= z)
    exact = box & batch.test(p)
    if strategy == "nested":
        shapes = batch.df
        if planner.counted(shapes, planner.BROADCAST_QUERIES) <= planner.BROADCAST_QUERIES:
            shapes = F.broadcast(shapes)
        return points.df.join(shapes, exact)
    if cell is None:
        # As wide as a typical shape: a point then meets few candidates and a shape few cells.
        extent = batch.df.select(F.greatest(*((z - a) for a, z in zip(batch.lo, batch.hi))).alias("e")).agg(F.percentile_approx("e", 0.5)).first()[0]
        cell = float(extent) if extent and extent > 0 else 1.0
    spans = F.lit(1.0)
    for a, z in zip(batch.lo, batch.hi):
        spans = spans * (F.floor(z / cell) - F.floor(a / cell) + 1)
    shapes = batch.df.withColumn("__spans", spans)
    small = shapes.where(F.col("__spans") <= most_cells)
    keyed = small
    for i, (a, z) in enumerate(zip(batch.lo, batch.hi)):
        keyed = keyed.withColumn(f"__k{i}", F.explode(F.sequence(F.floor(a / cell), F.floor(z / cell))))
    keys = [f"__k{i}" for i in range(dims)]
    celled = points.df.withColumns({k: F.floor(v / cell) for k, v in zip(keys, p)})
    found = celled.join(keyed, keys).where(exact).drop(*keys, "__spans")
    large = shapes.where(F.col("__spans") > most_cells).drop("__spans")
    if not large.take(1):
        return found
    wide = Batch(large, batch.lo, batch.hi, batch.test)
    few = planner.counted(large, planner.BROADCAST_QUERIES) <= planner.BROADCAST_QUERIES
    rest = cull_many(points, wide, strategy="nested") if few else cull_many(points, wide, cell * math.ceil(most_cells ** (1 / dims)), "cells", most_cells)
    return found.unionByName(rest.select(*found.columns))


def cull_count(points: PointFrame, batch: Batch, qid: str = "qid", **how) -> DataFrame:
    """(qid, n) of every shape, those without points included."""
    counts = cull_many(points, batch, **how).groupBy(qid).agg(F.count("*").alias("n"))
    return batch.df.select(qid).distinct().join(counts, qid, "left").select(qid, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def cull_best(points: PointFrame, batch: Batch, score: Column, qid: str = "qid", **how) -> DataFrame:
    """The point of the largest score in each shape, the least id among equals."""
    found = cull_many(points, batch, **how)
    return found.groupBy(qid).agg(F.max(F.struct(score.alias("score"), (-F.col(points.id)).alias("less"))).alias("b")).select(qid, (-F.col("b.less")).alias(points.id), F.col("b.score").alias("score"))


def shapes_with(points: PointFrame, batch: Batch, qid: str = "qid", present: bool = True, **how) -> DataFrame:
    """Shapes that hold a point (or none)."""
    hit = cull_many(points, batch, **how).select(qid).distinct()
    return batch.df.join(hit, qid, "left_semi" if present else "left_anti")


def covered(points: PointFrame, batch: Batch, present: bool = True, **how) -> DataFrame:
    """Points in at least one shape (or in none)."""
    hit = cull_many(points, batch, **how).select(points.id).distinct()
    return points.df.join(hit, points.id, "left_semi" if present else "left_anti")


def accumulate(points: PointFrame, batch: Batch, amount: Column, threshold: float, **how) -> DataFrame:
    """Points whose amounts from all shapes around them add up to the threshold: (id, total)."""
    return cull_many(points, batch, **how).groupBy(points.id).agg(F.sum(amount).alias("total")).where(F.col("total") >= threshold)


def extended(objects: PointFrame, spheres: DataFrame, arm: str = "tiered", radius: str = "radius", centre=("qx", "qy"), r: str = "r", tiers: tuple[float, ...] = (5.0, 20.0)) -> DataFrame:
    """Objects with a radius whose hull meets a sphere: distance <= r + radius.

    enlarged: one search by the largest radius; tiered: one per size class, each
    with its own reach; hybrid: the small by cells, the large by a nested loop;
    centre: by the object's centre alone, which misses hulls.
    """
    p = [F.col(c) for c in objects.coords]
    meets = ball_contains(p, list(centre), F.col(r) + F.col(radius))
    if arm == "centre":
        return cull_many(objects, balls(spheres, centre, r), strategy="cells")

    def reach(part: DataFrame, strategy: str = "cells") -> DataFrame:
        top = part.agg(F.max(radius)).first()[0] or 0.0
        grown = balls(spheres.withColumn("__reach", F.col(r) + F.lit(float(top))), centre, "__reach")
        return cull_many(objects.using(part), grown, strategy=strategy).drop("__reach").where(meets)

    if arm == "enlarged":
        return reach(objects.df)
    cuts = (-math.inf, *tiers, math.inf)
    parts = [objects.df.where((F.col(radius) > a) & (F.col(radius) <= z)) for a, z in zip(cuts[:-1], cuts[1:])]
    if arm == "hybrid":
        return reach(parts[0]).unionByName(reach(objects.df.where(F.col(radius) > tiers[0]), "nested"))
    out = reach(parts[0])
    for part in parts[1:]:
        out = out.unionByName(reach(part))
    return out
