"""Point frames: a DataFrame, the names of its coordinates and id, and the world they live in."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys

FORMAT = {"kind": "spindrift-points", "version": 1}


@dataclass(frozen=True)
class PointFrame:
    """Rows with coordinates inside a half-open world.

    ``out_of_world``: drop (default), clamp (to the edge cells) or keep rows
    outside.  Rows with a null or NaN coordinate are never points.
    """

    df: DataFrame
    coords: tuple[str, ...]
    world: tuple[tuple[float, float], ...]
    id: str = "id"

    @classmethod
    def of(cls, df: DataFrame, coords, world, id: str = "id", out_of_world: str = "drop") -> PointFrame:
        sound = None
        for c in coords:
            one = F.col(c).isNotNull() & ~F.isnan(F.col(c))
            sound = one if sound is None else sound & one
        df = df.where(sound)
        if out_of_world == "drop":
            for c, (lo, hi) in zip(coords, world):
                df = df.where((F.col(c) >= lo) & (F.col(c) < hi))
        elif out_of_world == "clamp":
            df = df.withColumns({c: F.greatest(F.lit(lo), F.least(F.lit(math.nextafter(hi, lo)), F.col(c))) for c, (lo, hi) in zip(coords, world)})
        elif out_of_world != "keep":
            raise ValueError(f"out_of_world is drop, clamp or keep, not {out_of_world!r}")
        return cls(df, tuple(coords), tuple(world), id)

    def using(self, df: DataFrame) -> PointFrame:
        return replace(self, df=df)

    def cell_sizes(self, levels: int) -> list[float]:
        return [(hi - lo) / (1 << levels) for lo, hi in self.world]

    def cell_indices(self, levels: int) -> list[Column]:
        return [keys.cell_index(c, lo, size, 1 << levels) for c, (lo, _), size in zip(self.coords, self.world, self.cell_sizes(levels))]

    def cell_key(self, levels: int) -> Column:
        return keys.morton(self.cell_indices(levels))


def levels_for_cell_size(world, target: float, most: int = 21) -> int:
    """Largest level, at least 1, whose cell is still `target` or more on the longest axis."""
    side = max(hi - lo for lo, hi in world)
    return max((n for n in range(1, most + 1) if side / (1 << n) >= target), default=1)


def levels_for_density(world, extent: float, hits: float, per_cell: float, most: int = 21) -> int | None:
    """Level whose cells hold about `per_cell` items at the density that queries meet:
    `hits` in a ball of diameter `extent`.  None when there is nothing to work from.
    """
    dims = len(world)
    volume = math.prod(hi - lo for lo, hi in world)
    if min(extent, hits, per_cell, volume) <= 0:
        return None
    ball = (math.pi if dims == 2 else 4 / 3 * math.pi) * (extent / 2) ** dims
    per_axis = (volume * hits / ball / per_cell) ** (1 / dims)
    return max(1, min(most, round(math.log2(per_axis)))) if math.isfinite(per_axis) and per_axis >= 1 else 1


def save(points: PointFrame, path: str, levels: int) -> None:
    """Parquet sorted by cell key, so that key ranges prune row groups, and a manifest."""
    keyed = points.df.withColumn("cell", points.cell_key(levels))
    keyed.repartitionByRange("cell").sortWithinPartitions("cell", points.id).write.mode("overwrite").parquet(f"{path}/rows")
    manifest = FORMAT | {"coords": points.coords, "world": points.world, "id": points.id, "levels": levels}
    spark = points.df.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[PointFrame, int]:
    """The saved frame (with its ``cell`` column) and its levels; another format or version is refused."""
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if {k: m.get(k) for k in FORMAT} != FORMAT:
        raise ValueError("not a point store of this version")
    return PointFrame(spark.read.parquet(f"{path}/rows"), tuple(m["coords"]), tuple(tuple(w) for w in m["world"]), m["id"]), m["levels"]


# Views over the star schema's tables.
EVENTS_WORLD = ((0.0, 512.0), (0.0, 1024.0), (0.0, 256.0))
ORDERS_WORLD = ((0.0, 512.0), (0.0, 4096.0))
PARTS_WORLD = ((0.0, 64.0), (0.0, 1024.0))


def _micros(column: str, since: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(since).cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the SQL view of events: it bounds x alone, so y and z may lie outside the world or be null."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("value").alias("x"),
        (_micros("ts", "2024-01-01 00:00:00").cast("double") / F.lit(3600000000.0)).alias("y"),
        F.col("user_id").cast("double").alias("z"), F.col("event_type").alias("cls"),
    )
    return df.where((F.col("x") >= EVENTS_WORLD[0][0]) & (F.col("x") < EVENTS_WORLD[0][1]))


def events(spark: SparkSession, sf_dir: str, dims: int = 2) -> PointFrame:
    return PointFrame.of(event_rows(spark, sf_dir), ("x", "y", "z")[:dims], EVENTS_WORLD[:dims])


def orders(spark: SparkSession, sf_dir: str) -> PointFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x"),
        (_micros("o_orderdate", "1995-01-01 00:00:00").cast("double") / F.lit(86400000000.0)).alias("y"), F.col("o_orderpriority").alias("cls"),
    )
    return PointFrame.of(df, ("x", "y"), ORDERS_WORLD)


def parts(spark: SparkSession, sf_dir: str) -> PointFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"),
        F.when(F.col("p_size") <= 45, F.col("p_size") % 5 + 1).otherwise(F.when(F.col("p_size") <= 49, 20).otherwise(60)).cast("double").alias("radius"),
    )
    return PointFrame.of(df, ("x", "y"), PARTS_WORLD)


#: The same views in DuckDB SQL.
SQL = {
    "events": "select event_id as id, value as x, cast(epoch_us(ts) - 1704067200000000 as double) / cast(3600000000 as double) as y, cast(user_id as double) as z, event_type as cls from events where value >= 0 and value < 512",
    "orders": "select o_orderkey as id, o_totalprice / 1000 as x, cast(epoch_us(o_orderdate) - 788918400000000 as double) / cast(86400000000 as double) as y, o_orderpriority as cls from orders where o_totalprice < 512000",
    "parts": "select p_partkey as id, cast(p_size as double) as x, p_retailprice as y, cast(case when p_size <= 45 then p_size % 5 + 1 when p_size <= 49 then 20 else 60 end as double) as radius from part where p_size < 64",
}
