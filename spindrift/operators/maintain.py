"""Batches of inserts, removes and moves, with a report of what crossed a cell or left the world."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import PointFrame


def insert(points: PointFrame, rows: DataFrame) -> PointFrame:
    """Rows outside the world are rejected."""
    fresh = PointFrame.of(rows, points.coords, points.world, points.id)
    return points.using(points.df.unionByName(fresh.df, allowMissingColumns=True))


def remove(points: PointFrame, ids: DataFrame) -> PointFrame:
    """Absent ids are no-ops."""
    return points.using(points.df.join(ids.select(points.id).distinct(), points.id, "left_anti"))


def update(points: PointFrame, moves: DataFrame, new: str = "new_") -> PointFrame:
    """Moved points take their new place; those that leave the world are dropped."""
    moved = points.df.join(moves.select(points.id, *(f"{new}{c}" for c in points.coords)), points.id, "left")
    at = {c: F.coalesce(f"{new}{c}", c) for c in points.coords}
    out = moved.withColumns(at).drop(*(f"{new}{c}" for c in points.coords)).select(*points.df.columns)
    return PointFrame.of(out, points.coords, points.world, points.id)


def crossings(points: PointFrame, moves: DataFrame, levels: int, new: str = "new_") -> DataFrame:
    """(id, outcome, cell_from, cell_to) of every move: Stayed, Moved, Left or Missing."""
    fresh = points.using(moves)
    inside = F.lit(True)
    for c, (lo, hi) in zip(points.coords, points.world):
        inside = inside & (F.col(f"{new}{c}") >= lo) & (F.col(f"{new}{c}") < hi)
    target = PointFrame(moves.select(points.id, *(F.col(f"{new}{c}").alias(c) for c in points.coords)), points.coords, points.world, points.id)
    to = fresh.df.select(points.id, inside.alias("inside")).join(target.df.select(points.id, target.cell_key(levels).alias("cell_to")), points.id)
    at = points.df.select(points.id, points.cell_key(levels).alias("cell_from"))
    both = to.join(at, points.id, "left")
    outcome = F.when(F.col("cell_from").isNull(), "Missing").when(~F.col("inside"), "Left").when(F.col("cell_from") == F.col("cell_to"), "Stayed").otherwise("Moved")
    return both.select(points.id, outcome.alias("outcome"), "cell_from", F.when(outcome.isin("Stayed", "Moved"), F.col("cell_to")).alias("cell_to"))


def relocate(points: PointFrame, moves: DataFrame, old: str = "old_", new: str = "new_") -> PointFrame:
    """Moves named by exact position; of several points there, the least id moves."""
    named = points.df.join(moves, [F.col(c) == F.col(f"{old}{c}") for c in points.coords])
    first = named.groupBy(*(f"{old}{c}" for c in points.coords)).agg(F.min_by(F.struct(points.id, *(f"{new}{c}" for c in points.coords)), points.id).alias("m")).select("m.*")
    return update(points, first, new)


def changed(old: PointFrame, new: PointFrame) -> DataFrame:
    """Rows of a new version of the population that are not as they were: the moved-only sync."""
    was = old.df.select(old.id, *(F.col(c).alias(f"was_{c}") for c in old.coords))
    both = new.df.join(was, new.id, "left")
    same = F.lit(True)
    for c in new.coords:
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return both.where(~same).drop(*(f"was_{c}" for c in old.coords))
