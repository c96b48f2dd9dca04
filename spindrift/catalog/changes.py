"""Maintenance, policy and rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import exchange, maintain, rasters
from ..plans import planner
from ..sources import points
from .base import query

_MOVES = "m as (select id, x + cast((id % 7) * 30 as double) as new_x, y - cast((id % 5) * 40 as double) as new_y from p union all select 1000000000 + i, 5.0, 5.0 from range(5) t(i))"


def _moves(spark, p):
    own = p.df.select("id", (F.col("x") + ((F.col("id") % 7) * 30).cast("double")).alias("new_x"), (F.col("y") - ((F.col("id") % 5) * 40).cast("double")).alias("new_y"))
    return own.unionByName(spark.range(5).select((F.col("id") + 1000000000).alias("id"), F.lit(5.0).alias("new_x"), F.lit(5.0).alias("new_y")))


@query(f"with {_MOVES} select p.id, coalesce(new_x, x) as x, coalesce(new_y, y) as y from p left join m on p.id = m.id where coalesce(new_x, x) >= 0 and coalesce(new_x, x) < 512 and coalesce(new_y, y) >= 0 and coalesce(new_y, y) < 1024", "events")
def apply_updates(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return maintain.update(p, _moves(spark, p)).df.select("id", "x", "y")


@query(f"""with {_MOVES} select m.id, case when p.id is null then 'Missing' when not (new_x >= 0 and new_x < 512 and new_y >= 0 and new_y < 1024) then 'Left'
 when floor(x / 8) = floor(new_x / 8) and floor(y / 16) = floor(new_y / 16) then 'Stayed' else 'Moved' end as outcome from m left join p on p.id = m.id""", "events")
def crossings(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return maintain.crossings(p, _moves(spark, p), 6).select("id", "outcome")


@query("select id from p where cls <> 'error'", "events")
def remove_ids(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return maintain.remove(p, p.df.where("cls = 'error'").select("id")).df.select("id")


@query("select id from p", "events")
def stale_handle_noop(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return maintain.remove(p, spark.range(2_000_000_000, 2_000_000_010)).df.select("id")


@query("select id, x, y from p union all select 3000000000 + i, cast(i * 100 as double), cast(i * 10 as double) from range(10) t(i) where i * 100 < 512", "events")
def insert_rows(spark, sf_dir):
    p = points.events(spark, sf_dir)
    new = spark.range(10).select((F.col("id") + 3000000000).alias("id"), (F.col("id") * 100).cast("double").alias("x"), (F.col("id") * 10).cast("double").alias("y"))
    return maintain.insert(p, new).df.select("id", "x", "y")


@query("with f as (select x, y, min(id) as id from p group by x, y) select id, case when id in (select id from f) then x + 1 else x end as x from p", "parts")
def relocate_by_position(spark, sf_dir):
    p = points.parts(spark, sf_dir)
    first = p.df.groupBy("x", "y").agg(F.min("id").alias("id"))
    moves = first.select(F.col("x").alias("old_x"), F.col("y").alias("old_y"), (F.col("x") + 1).alias("new_x"), F.col("y").alias("new_y"))
    return maintain.relocate(p, moves).df.select("id", "x")


@query(f"with {_MOVES} select id from m join p using (id) where new_x < 512 and new_y >= 0 and (new_x <> x or new_y <> y)", "events")
def moved_only(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return maintain.changed(p, maintain.update(p, _moves(spark, p))).select("id")


_TICKS = """t as (select user_id as item, row_number() over (partition by user_id order by ts, event_id) as tick, (event_id % 900) + 100 as items, event_id % 4 as moves, event_id % 3 as relocations, event_id % 11 as queries from events)"""


def _ticks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    tick = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("item"), tick.alias("tick"), (i % 900 + 100).alias("items"), (i % 4).alias("moves"), (i % 3).alias("relocations"), (i % 11).alias("queries"))


_PROFILE = f"""with recursive {_TICKS},
s as (select item, tick, items, case when moves > 0 then relocations / moves::double else 0.0::double end as r, case when moves > 0 then queries / moves::double else queries::double end as q, case when moves = 0 then 1 else 0 end as z from t),
f as (select item, tick, items, r as rate, q as per_move, z::bigint as still from s where tick = 1
  union all select s.item, s.tick, s.items, f.rate + 0.1::double * (s.r - f.rate), f.per_move + 0.1::double * (s.q - f.per_move), case when s.z = 1 then f.still + 1 else 0 end from f join s on s.item = f.item and s.tick = f.tick + 1)"""


@query(_PROFILE + " select item, tick, rate, per_move, still from f")
def profile_ema(spark, sf_dir):
    return planner.profile(_ticks(spark, sf_dir)).select("item", "tick", "rate", "per_move", "still")


@query(_PROFILE + " select item, tick, case when items < 512 then 'Brute' when still >= 30 then 'Static' when rate > 0.30 then 'CoarserOrRebuild' else 'KeepIndex' end as advice from f")
def advisor_recommend(spark, sf_dir):
    """What the observed profile of every tick advises."""
    t = planner.profile(_ticks(spark, sf_dir))
    return t.select("item", "tick", planner.recommendation(F.col("items"), F.col("still"), F.col("rate")).alias("advice"))


@query("""with a as (select i - 7 as v from range(14) t(i)), c as (select x.v as dx, y.v as dy, z.v as dz from a x, a y, a z),
k as (select dx, dy, dz, power(greatest(dx - 0.5, 0, -(dx + 0.5)), 2) + power(greatest(dy - 0.5, 0, -(dy + 0.5)), 2) + power(greatest(dz - 0.5, 0, -(dz + 0.5)), 2) as near,
 power(greatest(abs(dx - 0.5), abs(dx + 0.5)), 2) + power(greatest(abs(dy - 0.5), abs(dy + 0.5)), 2) + power(greatest(abs(dz - 0.5), abs(dz + 0.5)), 2) as far from c)
select dy::int as dy, dz::int as dz, min(dx)::int as touch0, max(dx)::int as touch1, (min(dx) filter (where far <= 30.25))::int as full0, (max(dx) filter (where far <= 30.25))::int as full1 from k where near <= 30.25 group by dy, dz""")
def stencil_rows(spark, sf_dir):
    return rasters.stencil(spark, 5.5)


@query("""with a as (select i from range(12) t(i)), c as (select x.i as ix, y.i as iy, z.i as iz from a x, a y, a z),
k as (select *, power(greatest(ix - 6.0, 0, 6.0 - (ix + 1)), 2) + power(greatest(iy - 6.0, 0, 6.0 - (iy + 1)), 2) + power(greatest(iz - 6.0, 0, 6.0 - (iz + 1)), 2) as near,
 power(greatest(abs(ix - 6.0), abs(ix + 1 - 6.0)), 2) + power(greatest(abs(iy - 6.0), abs(iy + 1 - 6.0)), 2) + power(greatest(abs(iz - 6.0), abs(iz + 1 - 6.0)), 2) as far from c)
select ix, iy, iz, case when far <= 16 then 2 else 1 end as state from k where near <= 16""")
def voxel_raster(spark, sf_dir):
    return rasters.voxels(spark, shapes.Ball((6.0, 6.0, 6.0), 4.0), (0, 0, 0), (12, 12, 12))


#: A ring-shaped raster over 32 x 32 cells: inside between two distances of the middle.
_CELLS = "r as (select 1 as tid, c::int as col, r::int as row, case when d < 36 then 0 when d < 64 then 1 when d < 144 then 2 when d < 196 then 1 else 0 end as state from (select c, r, (c - 16) * (c - 16) + (r - 16) * (r - 16) as d from range(32) a(c), range(32) b(r)))"


def _cells(spark):
    c, r = F.col("id") % 32, F.floor(F.col("id") / 32)
    d = (c - 16) * (c - 16) + (r - 16) * (r - 16)
    state = F.when(d < 36, 0).when(d < 64, 1).when(d < 144, 2).when(d < 196, 1).otherwise(0)
    return spark.range(1024).select(F.lit(1).alias("tid"), c.cast("int").alias("col"), r.cast("int").alias("row"), state.alias("state"))


@query(f"with {_CELLS} select tid, floor(col / 4)::int as col, floor(row / 4)::int as row, case when min(state) = 2 and count(*) = 16 then 2 when max(state) = 0 then 0 else 1 end as state from r group by 1, 2, 3")
def template_aggregate(spark, sf_dir):
    return rasters.aggregate(_cells(spark), 4, 4)


@query(f"with {_CELLS} select id, coalesce(state, 0) as state from p left join r on floor(x / 10)::int = col and floor(y / 10)::int = row", "events")
def template_lookup(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return rasters.look_up(p.df.withColumn("tid", F.lit(1)), _cells(spark), F.col("x"), F.col("y"), 10.0, 10.0).select("id", "state")


@query(f"with {_CELLS} select tid, case when min(state) = 2 and count(*) = 12 then 2 when max(state) = 0 then 0 else 1 end as state from r where col between 14 and 17 and row between 5 and 7 group by tid")
def template_region(spark, sf_dir):
    return rasters.classify_region(_cells(spark), (14, 5), (17, 7))


@query()
def template_bank(spark, sf_dir):
    """Statistics of a generated bank."""
    tasks = rasters.subtasks(spark, sorted(rasters.FIGURES), [16.0, 32.0], [4, 8], 45.0)
    return rasters.bank_statistics(rasters.bank(tasks))


@query()
def template_resolve(spark, sf_dir):
    """Figures placed at lattice points, with the stored raster of their offset."""
    entries = rasters.unique(rasters.bank(rasters.subtasks(spark, ["drop", "box"], [16.0], [2], 90.0)))
    i = F.col("id")
    placements = spark.range(100).select(i.alias("pid"), F.when(i % 2 == 0, "drop").otherwise("box").alias("figure"), F.lit(16.0).alias("scale"), F.lit(2).alias("cell"), ((i % 4) * 90.0).alias("angle"), (i * 7 - 50).cast("int").alias("px"), (i * 3 - 20).cast("int").alias("py"))
    return rasters.resolve(placements, entries).select("pid", "dx", "dy", "tid", "op")


@query()
def template_fingerprint(spark, sf_dir):
    """Every raster of the fingerprint's figures, angles, cells and offsets, for comparison between builds."""
    return exchange.fingerprint(spark)


@query("""with s as (select f, s, c, a from (values ('box'), ('circle')) f(f), (values (1.0), (2.0)) s(s), (values (1), (2)) c(c), (select i * 30.0 as a from range(12) t(i)))
select f as figure, s::double as scale, c as cell, a::double as angle, floor((sum(c * c) over (partition by f, s, c order by a) - 1) / 20)::int as task from s""")
def template_subtasks(spark, sf_dir):
    return rasters.subtasks(spark, ["box", "circle"], [1.0, 2.0], [1, 2], 30.0, most=20)


@query()
def policy_ticks(spark, sf_dir):
    """Backend in force after every tick of every workload."""
    from ..streaming.ticks import policy_table

    return policy_table(_ticks(spark, sf_dir)).select("item", "tick", "still", "backend", "switched")
