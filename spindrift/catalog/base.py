"""How queries are registered: a Spark callable and, beside it, brute-force SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, view: str | None = None):
    """Register a function under its name; `view` puts a point view before the SQL as ``p``."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            head = f"with p as ({points.SQL[view]}) " if view else ""
            # Further common tables follow the view in one list.
            body = oracle.strip()
            if head and body.startswith("with recursive "):
                head, body = head.replace("with p", "with recursive p", 1), "with " + body[15:]
            ORACLES[f.__name__] = head[:-1] + ", " + body[5:] if head and body.startswith("with ") else head + body
        return f

    return put


def circles(spark: SparkSession, n: int = 64, w: int = 500, h: int = 720) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.alias("qid"), ((i * 37) % w).cast("double").alias("qx"), ((i * 53) % h).cast("double").alias("qy"), (F.lit(3) + (i % 7) * 2).cast("double").alias("r"))


CIRCLES = "q as (select i as qid, cast((i * 37) % 500 as double) as qx, cast((i * 53) % 720 as double) as qy, cast(3 + (i % 7) * 2 as double) as r from range(64) t(i))"


def rays(spark: SparkSession, n: int = 32) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        i.alias("ray_id"), ((i * 11) % 200).cast("double").alias("ox"), ((i * 67) % 700).cast("double").alias("oy"),
        ((i % 5) - 2).cast("double").alias("dx"), ((i % 3) - 1).cast("double").alias("dy"), (F.lit(60) + (i % 4) * 20).cast("double").alias("reach"), (F.lit(1) + (i % 3)).cast("double").alias("r"),
    )


RAYS = """q as (select i as ray_id, cast((i * 11) % 200 as double) as ox, cast((i * 67) % 700 as double) as oy, cast((i % 5) - 2 as double) as dx, cast((i % 3) - 1 as double) as dy,
  cast(60 + (i % 4) * 20 as double) as reach, cast(1 + (i % 3) as double) as r from range(32) t(i)),
u as (select *, dx / sqrt(dx * dx + dy * dy) as ux, dy / sqrt(dx * dx + dy * dy) as uy from q where dx * dx + dy * dy > 0),
s as (select *, ox + ux * reach as ex, oy + uy * reach as ey from u),
c as (select s.*, p.id, p.x, p.y, p.cls, ((p.x - ox) * (ex - ox) + (p.y - oy) * (ey - oy)) / ((ex - ox) * (ex - ox) + (ey - oy) * (ey - oy)) as k0 from s, p),
d as (select *, greatest(0.0, least(1.0, k0)) as k from c),
h as (select ray_id, id, cls, greatest(0.0, least(reach, (x - ox) * ux + (y - oy) * uy)) as t, x, y, ox, oy, ex, ey from d
  where ((x - ox) - k * (ex - ox)) * ((x - ox) - k * (ex - ox)) + ((y - oy) - k * (ey - oy)) * ((y - oy) - k * (ey - oy)) <= r * r)"""


def solids(spark: SparkSession, n: int = 24) -> DataFrame:
    """Axis-parallel boxes as plane arrays."""
    i = F.col("id")
    lo = [((i * 29) % 400).cast("double"), ((i * 41) % 650).cast("double"), ((i * 13) % 90).cast("double")]
    size = F.lit(30.0)
    planes = []
    for k in range(3):
        axis = [F.lit(1.0 if j == k else 0.0) for j in range(3)]
        for sign, d in ((1.0, lo[k] + size), (-1.0, -lo[k])):
            planes.append(F.struct(*((a * sign).alias(m) for a, m in zip(axis, ("nx", "ny", "nz"))), d.alias("d")))
    return spark.range(n).select(i.alias("sid"), F.array(*planes).alias("planes"))


def segments(spark: SparkSession, n: int = 200) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        i.alias("seg_id"), *(((i * a) % m).cast("double").alias(c) for c, a, m in (("ax", 7, 430), ("ay", 19, 690), ("az", 5, 120), ("bx", 31, 430), ("by", 43, 690), ("bz", 23, 120))),
    )


#: Slab test of the same boxes: per axis the entering and leaving parameter.
SEGMENT_HITS = """with s as (select i as seg_id, cast((i * 7) % 430 as double) as ax, cast((i * 19) % 690 as double) as ay, cast((i * 5) % 120 as double) as az,
  cast((i * 31) % 430 as double) as bx, cast((i * 43) % 690 as double) as by_, cast((i * 23) % 120 as double) as bz from range(200) t(i)),
b as (select i as sid, cast((i * 29) % 400 as double) as x0, cast((i * 41) % 650 as double) as y0, cast((i * 13) % 90 as double) as z0 from range(24) t(i)),
k as (select seg_id, sid, unnest([{'p': ax, 'v': bx - ax, 'l': x0}, {'p': ay, 'v': by_ - ay, 'l': y0}, {'p': az, 'v': bz - az, 'l': z0}]) as a from s, b),
m as (select seg_id, sid,
  case when abs(a.v) < 1e-12 then (case when a.p < a.l or a.p > a.l + 30 then 2.0 else 0.0 end) else least((a.l - a.p) / a.v, (a.l + 30 - a.p) / a.v) end as t0,
  case when abs(a.v) < 1e-12 then 1.0 else greatest((a.l - a.p) / a.v, (a.l + 30 - a.p) / a.v) end as t1 from k),
g as (select seg_id, sid, greatest(0.0, max(t0)) as t0, least(1.0, min(t1)) as t1 from m group by seg_id, sid),
h as (select seg_id, sid, t0 as t from g where t0 <= t1)"""
