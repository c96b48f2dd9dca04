"""Nearest neighbours, rays, lines of sight and the questions built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import cull, kernel, knn, ray
from ..sources import points
from .base import CIRCLES, RAYS, SEGMENT_HITS, circles, query, rays, segments, solids

_D2 = "(x - qx) * (x - qx) + (y - qy) * (y - qy)"
_KNN = f"n as (select qid, id, cls, x, y, qx, qy, d2, rank from (select *, {_D2} as d2, row_number() over (partition by qid order by {_D2}, id) as rank from q, p) where rank <= 8)"


@query("select id, sqrt((x - 40.0) * (x - 40.0) + (y - 300.0) * (y - 300.0)) as dist from p order by (x - 40.0) * (x - 40.0) + (y - 300.0) * (y - 300.0), id limit 12", "events")
def knn_single(spark, sf_dir):
    return knn.knn(points.events(spark, sf_dir), (40.0, 300.0), 12).select("id", "dist")


@query(f"with {CIRCLES}, {_KNN} select qid, id, d2, rank::int as rank from n", "events")
def knn_many(spark, sf_dir):
    return knn.knn_many(points.events(spark, sf_dir), circles(spark), 8).select("qid", "id", "d2", "rank")


@query(f"with {CIRCLES}, {_KNN} select qid, id, d2, rank::int as rank from n", "events")
def knn_many_cells(spark, sf_dir):
    return knn.knn_many(points.events(spark, sf_dir), circles(spark), 8, strategy="cells").select("qid", "id", "d2", "rank")


@query(f"""with {CIRCLES}, k as (select qid, id, {_D2} as d2, row_number() over (partition by qid order by {_D2}, id) as r from q, p where cls = 'purchase')
select qid, id, d2 from k where r = 1""", "events")
def knn_enemy(spark, sf_dir):
    """Filter before k: the nearest point of a class."""
    return knn.knn_many(points.events(spark, sf_dir), circles(spark), 1, extra=F.col("cls") == "purchase").select("qid", "id", "d2")


@query(f"with {CIRCLES}, {_KNN} select qid, arg_min(id, rank) as id from n where cls = 'purchase' group by qid", "events")
def knn_then_filter(spark, sf_dir):
    """Filter after k: the nearest of the k that is of the class; none if no one is."""
    near = knn.knn_many(points.events(spark, sf_dir), circles(spark), 8)
    return knn.first_matching(near, F.col("cls") == "purchase").select("qid", "id")


@query("""with k as (select a.id as qid, b.id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) as d2 from p a, p b where a.id <> b.id),
r as (select *, row_number() over (partition by qid order by d2, id) as rank from k) select qid, max(d2) as d2 from r where rank <= 6 group by qid""", "parts")
def knn_self_density(spark, sf_dir):
    """Squared distance to the sixth neighbour: the reciprocal of local density."""
    return knn.kth_distance2(points.parts(spark, sf_dir), 6)


@query(f"""with {CIRCLES}, k as (select qid, id, {_D2} as d2, row_number() over (partition by qid order by {_D2}, id) as r from q, p)
select qid, id, d2 from k where r = 1 and d2 <= 36.0""", "events")
def nn1_within(spark, sf_dir):
    return knn.nearest_within(points.events(spark, sf_dir), circles(spark), 6.0, strategy="cells", cell=12.0)


@query(f"""with {CIRCLES}, {_KNN}, c as (select qid, id, row_number() over (partition by qid order by rank) as link from n where cls <> 'view')
select qid, id, link::int as link from c where link <= 4""", "events")
def knn_chain(spark, sf_dir):
    near = knn.knn_many(points.events(spark, sf_dir), circles(spark), 8)
    return knn.chain(near, F.col("cls") != "view", 4).select("qid", "id", "link")


@query(f"""with {CIRCLES}, {_KNN} select qid, round(avg(x), 6) as cx, round(avg(y), 6) as cy, round(sum(case when d2 > 0 and d2 < 25 then (qx - x) / sqrt(d2) else 0.0 end), 6) as sx, count(*) filter (where cls = 'click') as mates
from n group by qid""", "events")
def flock_aggregates(spark, sf_dir):
    """Cohesion, separation and class mates from one neighbour list."""
    near = knn.knn_many(points.events(spark, sf_dir), circles(spark), 8)
    push = F.when((F.col("d2") > 0) & (F.col("d2") < 25), (F.col("qx") - F.col("x")) / F.sqrt("d2")).otherwise(0.0)
    return near.groupBy("qid").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.sum(push), 6).alias("sx"), F.count(F.when(F.col("cls") == "click", 1)).alias("mates"))


def _hits(spark, sf_dir):
    return ray.raycast(points.events(spark, sf_dir), rays(spark), strategy="cells", cell=40.0)


@query(f"with {RAYS} select ray_id, id, round(t, 9) as t from h", "events")
def raycast_all(spark, sf_dir):
    return _hits(spark, sf_dir).select("ray_id", "id", F.round("t", 9).alias("t"))


@query(f"with {RAYS} select ray_id, id from (select *, row_number() over (partition by ray_id order by t, id) as r from h) where r = 1", "events")
def raycast_first(spark, sf_dir):
    return ray.first_hit(_hits(spark, sf_dir)).select("ray_id", "id")


@query(f"with {RAYS} select ray_id, count(*) as n from h where cls = 'purchase' group by ray_id", "events")
def raycast_piercing(spark, sf_dir):
    return _hits(spark, sf_dir).where("cls = 'purchase'").groupBy("ray_id").agg(F.count("*").alias("n"))


@query(f"with {RAYS} select ray_id, id, cls = 'purchase' as foe from (select *, row_number() over (partition by ray_id order by t, id) as r from h) where r = 1", "events")
def raycast_first_body(spark, sf_dir):
    """The first body decides: whether it is a foe."""
    return ray.first_hit(_hits(spark, sf_dir), keep=("cls",)).select("ray_id", "id", (F.col("cls") == "purchase").alias("foe"))


def _bits(v: str, n: int, dims: int, lane: int) -> str:
    return " | ".join(f"((({v} >> {b}) & 1) << {b * dims + lane})" for b in range(n))


_SLAB = """, g as (select *, floor(x / 8) * 8 as lx, floor(y / 16) * 16 as ly from h),
w as (select ray_id, id,
  case when abs(ex - ox) < 1e-12 then (case when ox < lx or ox > lx + 8 then 2.0 else 0.0 end) else least((lx - ox) / (ex - ox), (lx + 8 - ox) / (ex - ox)) end as a0,
  case when abs(ex - ox) < 1e-12 then 1.0 else greatest((lx - ox) / (ex - ox), (lx + 8 - ox) / (ex - ox)) end as a1,
  case when abs(ey - oy) < 1e-12 then (case when oy < ly or oy > ly + 16 then 2.0 else 0.0 end) else least((ly - oy) / (ey - oy), (ly + 16 - oy) / (ey - oy)) end as b0,
  case when abs(ey - oy) < 1e-12 then 1.0 else greatest((ly - oy) / (ey - oy), (ly + 16 - oy) / (ey - oy)) end as b1 from g)
select ray_id, id from w where greatest(0.0, a0, b0) <= least(1.0, a1, b1)"""


@query(f"with {RAYS}{_SLAB}", "events")
def raycast_corridor(spark, sf_dir):
    return ray.corridor(points.events(spark, sf_dir), rays(spark), 6).select("ray_id", "id")


_LEAF_HITS = f"""with {RAYS}, m as materialized (select id, (({_bits('floor(x / 8)::bigint', 6, 2, 0)}) | ({_bits('floor(y / 16)::bigint', 6, 2, 1)})) as cell, floor(x / 8)::bigint as i, floor(y / 16)::bigint as j from p),
f as materialized (select cell, count(*) as n from m group by 1), n as materialized (select 6 - v as lev, cell >> (v * 2)::bigint as key, sum(n)::bigint as n from f, range(7) t(v) group by 1, 2),
e as (select a.lev, a.key from n a left join n b on b.lev = a.lev - 1 and b.key = a.key >> 2 where (a.n <= 100 or a.lev = 6) and (a.lev = 0 or b.n > 100)),
b as (select m.id, power(2, 6 - lev) as size, (i >> (6 - lev)) * power(2, 6 - lev) as i0, (j >> (6 - lev)) * power(2, 6 - lev) as j0 from m join e on m.cell >> ((6 - lev) * 2)::bigint = e.key),
g as (select h.*, i0 * 8 as lx, (i0 + size) * 8 as hx, j0 * 16 as ly, (j0 + size) * 16 as hy from h join b using (id)),
w as (select ray_id, id, t,
  case when abs(ex - ox) < 1e-12 then (case when ox < lx or ox > hx then 2.0 else 0.0 end) else least((lx - ox) / (ex - ox), (hx - ox) / (ex - ox)) end as a0,
  case when abs(ex - ox) < 1e-12 then 1.0 else greatest((lx - ox) / (ex - ox), (hx - ox) / (ex - ox)) end as a1,
  case when abs(ey - oy) < 1e-12 then (case when oy < ly or oy > hy then 2.0 else 0.0 end) else least((ly - oy) / (ey - oy), (hy - oy) / (ey - oy)) end as b0,
  case when abs(ey - oy) < 1e-12 then 1.0 else greatest((ly - oy) / (ey - oy), (hy - oy) / (ey - oy)) end as b1 from g),
k as (select ray_id, id, t from w where greatest(0.0, a0, b0) <= least(1.0, a1, b1))"""


def _leaf_hits(spark, sf_dir):
    return ray.leaf_corridor(points.events(spark, sf_dir), rays(spark), 100, 6)


@query(f"{_LEAF_HITS} select ray_id, id from k", "events")
def raycast_leaf_corridor(spark, sf_dir):
    return _leaf_hits(spark, sf_dir).select("ray_id", "id")


@query(f"{_LEAF_HITS} select ray_id, id from (select *, row_number() over (partition by ray_id order by t, id) as r from k) where r = 1", "events")
def raycast_leaf_first(spark, sf_dir):
    return ray.first_hit(_leaf_hits(spark, sf_dir)).select("ray_id", "id")


@query(f"{SEGMENT_HITS} select seg_id, sid, round(t, 9) as t from h")
def segment_hit(spark, sf_dir):
    return ray.blocked_rays(segments(spark), solids(spark)).select("seg_id", "sid", F.round("t", 9).alias("t"))


@query(f"{SEGMENT_HITS} select seg_id from s where seg_id not in (select seg_id from h where t < 1)")
def line_of_sight(spark, sf_dir):
    return ray.visible(segments(spark), solids(spark)).select("seg_id")


@query(f"{SEGMENT_HITS}, v as (select id, x as bx, y as by_, z as bz from ({points.SQL['events']}) where y >= 50 and y <= 450 and 10 * x + y >= 450 and 10 * x - y <= 550 and 10 * z + y >= 650 and 10 * z - y <= 750), "
       """vk as (select id, sid, unnest([{'p': 50.0, 'v': bx - 50.0, 'l': x0}, {'p': 40.0, 'v': by_ - 40.0, 'l': y0}, {'p': 70.0, 'v': bz - 70.0, 'l': z0}]) as a from v, b),
vm as (select id, sid, case when abs(a.v) < 1e-12 then (case when a.p < a.l or a.p > a.l + 30 then 2.0 else 0.0 end) else least((a.l - a.p) / a.v, (a.l + 30 - a.p) / a.v) end as t0,
  case when abs(a.v) < 1e-12 then 1.0 else greatest((a.l - a.p) / a.v, (a.l + 30 - a.p) / a.v) end as t1 from vk),
vg as (select id, sid, greatest(0.0, max(t0)) as t0, least(1.0, min(t1)) as t1 from vm group by id, sid)
select id from v where id not in (select id from vg where t0 <= t1 and t0 < 1)""")
def vision_cone(spark, sf_dir):
    """Points in a viewer's frustum that no solid hides from its eye."""
    from .ranges import _CORNERS

    seen = cull.cull(points.events(spark, sf_dir, 3), shapes.Polyhedron.from_corners(_CORNERS))
    sight = seen.select(F.col("id").alias("seg_id"), F.lit(50.0).alias("ax"), F.lit(40.0).alias("ay"), F.lit(70.0).alias("az"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    return ray.visible(sight, solids(spark)).select(F.col("seg_id").alias("id"))


@query("""with s as (select id, x as bx, y as by_, greatest(cast(ceil(sqrt((x - 20.0) * (x - 20.0) + (y - 100.0) * (y - 100.0)) / 5.0) as int), 1) as n from p),
k as (select id, 20.0 + (bx - 20.0) * (i / n::double) as sx, 100.0 + (by_ - 100.0) * (i / n::double) as sy from (select *, unnest(range(1, n + 1)) as i from s))
select id from k group by id having count(*) filter (where (sx - 30.0) * (sx - 30.0) + (sy - 250.0) * (sy - 250.0) <= 400.0) = 0""", "events")
def los_sampled(spark, sf_dir):
    """Sight sampled every 5 units against a round cover."""
    p = points.events(spark, sf_dir).df
    cover = lambda x, y: (x - 30.0) * (x - 30.0) + (y - 250.0) * (y - 250.0) <= 400.0
    return p.where(ray.sampled_clear((F.lit(20.0), F.lit(100.0)), (F.col("x"), F.col("y")), cover)).select("id")


@query("""with k as (select a.id, 64.0 - ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as w from p a, p b where b.x between a.x - 8 and a.x + 8 and b.y between a.y - 8 and a.y + 8)
select id, round(sum(w * w * w), 3) as density, count(*) as n from k where w >= 0 group by id""", "events")
def sph_density(spark, sf_dir):
    """Poly6-shaped kernel sum over neighbours within 8, itself included."""
    return kernel.poly6(points.event_rows(spark, sf_dir), 8.0).select("id", F.round("density", 3).alias("density"), "n")


@query("select id, case when abs(x - 40 + 0.5 * (y - 300)) >= abs(y - 300 - 0.5 * (x - 40)) then (case when x - 40 + 0.5 * (y - 300) >= 0 then 'front' else 'rear' end) else (case when y - 300 - 0.5 * (x - 40) > 0 then 'left' else 'right' end) end as side from p", "events")
def sector_classify(spark, sf_dir):
    p = points.events(spark, sf_dir)
    return p.df.select("id", shapes.sector(F.lit(1.0), F.lit(0.5), F.col("x") - 40.0, F.col("y") - 300.0).alias("side"))


@query("select id, round(case when atan2(y - 300.0, x - 40.0) < 0 then atan2(y - 300.0, x - 40.0) + 2 * pi() else atan2(y - 300.0, x - 40.0) end, 6) as a from p", "events")
def angle_about(spark, sf_dir):
    return points.events(spark, sf_dir).df.select("id", F.round(shapes.angle_about("x", "y", 40.0, 300.0), 6).alias("a"))


@query("""with k as (select id, (x - 40.0) as dx, (y - 300.0) as dy from p), l as (select id, dx * dx + dy * dy as a, 2 * (20.0 * dx + 60.0 * dy) as b, 20.0 * 20.0 + 60.0 * 60.0 - 900.0 as c from k)
select id, round((-b - sqrt(b * b - 4 * a * c)) / (2 * a), 6) as t0, round((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 6) as t1 from l where b * b - 4 * a * c >= 0 and a > 0""", "events")
def line_circle(spark, sf_dir):
    """Where the line from a place to each point meets a circle."""
    t0, t1 = shapes.line_circle((40.0, 300.0), (F.col("x"), F.col("y")), (20.0, 240.0), 30.0)
    return points.events(spark, sf_dir).df.select("id", F.round(t0, 6).alias("t0"), F.round(t1, 6).alias("t1")).where("t0 is not null")


@query(f"""with {CIRCLES}, m as (select qid, id from q, p where cls = 'purchase' and {_D2} <= r * r)
select p.id, p.id in (select m.id from m) as in_aura from p where cls = 'purchase'""", "events")
def aura_regiments(spark, sf_dir):
    """Units of a class and whether a leader's aura covers them."""
    p = points.events(spark, sf_dir)
    own = p.using(p.df.where("cls = 'purchase'"))
    lit = cull.covered(own, cull.balls(circles(spark)), cell=16.0, strategy="cells").select("id", F.lit(True).alias("in_aura"))
    return own.df.select("id").join(lit, "id", "left").select("id", F.coalesce("in_aura", F.lit(False)).alias("in_aura"))


@query(f"""with {CIRCLES}, m as (select qid, {_D2} as d2, id, row_number() over (partition by qid order by {_D2}, id) as k from q, p where cls = 'error' and {_D2} <= 900.0)
select q.qid, round(coalesce(sum(1 / (1 + d2)) filter (where k <= 12), 0.0), 9) as fear from q left join m on q.qid = m.qid group by q.qid""", "events")
def morale_routers(spark, sf_dir):
    """Fear from at most the 12 nearest of a class within 30."""
    p = points.events(spark, sf_dir)
    near = cull.cull_many(p.using(p.df.where("cls = 'error'")), cull.balls(circles(spark).withColumn("r", F.lit(30.0))), cell=32.0, strategy="cells").withColumn("d2", knn.distance2(["x", "y"], ["qx", "qy"]))
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))).where("k <= 12")
    fear = top.groupBy("qid").agg(F.sum(1 / (1 + F.col("d2"))).alias("f"))
    return circles(spark).select("qid").join(fear, "qid", "left").select("qid", F.round(F.coalesce("f", F.lit(0.0)), 9).alias("fear"))


@query(f"with {CIRCLES}, d as (select qid, id, {_D2} as d2, row_number() over (partition by qid order by {_D2}, id) as k from q, p where cls = 'purchase' and {_D2} <= (r + 2.5) * (r + 2.5)) select qid, id from d where k = 1", "events")
def predator_vision(spark, sf_dir):
    """The nearest prey whose body of radius 2.5 the viewer's disc meets."""
    p = points.events(spark, sf_dir)
    near = cull.cull_many(p.using(p.df.where("cls = 'purchase'")), cull.balls(circles(spark).withColumn("r", F.col("r") + 2.5)), cell=16.0, strategy="cells").withColumn("d2", knn.distance2(["x", "y"], ["qx", "qy"]))
    return near.groupBy("qid").agg(F.min_by("id", F.struct("d2", "id")).alias("id"))


@query("""select 1::bigint as fid, id from p where (x - 60.0) * (x - 60.0) + (y - 300.0) * (y - 300.0) <= 1600.0
union all select 2::bigint, id from p where y > 570 and (x - 100.0) * (x - 100.0) + (y - 570.0) * (y - 570.0) <= 900.0
union all select 2::bigint, id from p where y <= 570 and 70 * abs(x - 100) <= 30 * (y - 500)""", "events")
def figure_attack(spark, sf_dir):
    """Points in figures with arc edges: a disc and a drop."""
    from ..functions.figures import points_in_figures
    from ..operators import rasters

    figures = {1: rasters.placed(rasters.circle(4.0), 10.0, 0.0, 60.0, 300.0), 2: rasters.placed(rasters.drop(3.0, 7.0), 10.0, 0.0, 100.0, 500.0)}
    return points_in_figures(points.events(spark, sf_dir).df, figures)


@query(f"with {CIRCLES}, c as (select qid, qx as ax, qy as ay, qx + 20 as bx, qy + 40 as by_, r from q), k as (select c.*, p.id, p.x, p.y, greatest(0.0, least(1.0, ((p.x - ax) * 20 + (p.y - ay) * 40) / 2000.0::double)) as t from c, p) select qid, id from k where ((x - ax) - t * 20) * ((x - ax) - t * 20) + ((y - ay) - t * 40) * ((y - ay) - t * 40) <= r * r", "events")
def cull_many_capsule(spark, sf_dir):
    q = circles(spark).select("qid", F.col("qx").alias("ax"), F.col("qy").alias("ay"), (F.col("qx") + 20).alias("bx"), (F.col("qy") + 40).alias("by"), "r")
    return cull.cull_many(points.events(spark, sf_dir), cull.capsules(q), cell=40.0, strategy="cells").select("qid", "id")


@query(f"with {CIRCLES} select qid, id from q, p where x >= qx and x < qx + r and y >= qy and y < qy + 2 * r", "events")
def cull_many_box(spark, sf_dir):
    q = circles(spark).select("qid", F.col("qx").alias("x0"), F.col("qy").alias("y0"), (F.col("qx") + F.col("r")).alias("x1"), (F.col("qy") + 2 * F.col("r")).alias("y1"))
    return cull.cull_many(points.events(spark, sf_dir), cull.boxes(q), cell=16.0, strategy="cells").select("qid", "id")


@query("select id, round(abs(80.0::double * (y - 20) - 580.0::double * (x - 10)) / sqrt(80.0::double * 80 + 580.0::double * 580), 6) as d from p", "events")
def line_distance(spark, sf_dir):
    """Distance of every point from the line through (10, 20) and (90, 600)."""
    d = shapes.line_distance(("x", "y"), (F.lit(10.0), F.lit(20.0)), (F.lit(90.0), F.lit(600.0)))
    return points.events(spark, sf_dir).df.select("id", F.round(d, 6).alias("d"))


def _walls(spark):
    i = F.col("id")
    return spark.range(40).select(i.alias("wall_id"), *(((i * a) % m).cast("double").alias(c) for c, a, m in (("cx", 13, 430), ("cy", 61, 690), ("dx", 97, 430), ("dy", 17, 690))))


_WALLS = """w as (select i as wall_id, cast((i * 13) % 430 as double) as cx, cast((i * 61) % 690 as double) as cy, cast((i * 97) % 430 as double) as dx, cast((i * 17) % 690 as double) as dy from range(40) t(i)),
g as (select i as seg_id, cast((i * 7) % 430 as double) as ax, cast((i * 19) % 690 as double) as ay, cast((i * 31) % 430 as double) as bx, cast((i * 43) % 690 as double) as by_ from range(200) t(i))"""


@query(f"""with {_WALLS}, k as (select *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as s1, (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) as s2,
  (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) as s3, (dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx) as s4 from g, w)
select seg_id, wall_id, round(ax + s3 / (s3 - s4) * (bx - ax), 6) as x, round(ay + s3 / (s3 - s4) * (by_ - ay), 6) as y from k where s1 * s2 < 0 and s3 * s4 < 0""")
def segment_meeting(spark, sf_dir):
    """Where segments cross walls."""
    a, b, c, d = (tuple(map(F.col, v)) for v in (("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy")))
    x, y = shapes.segments_meet(a, b, c, d)
    pairs = segments(spark).join(F.broadcast(_walls(spark)), shapes.segments_cross(a, b, c, d))  # forty walls
    return pairs.select("seg_id", "wall_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"""with {_WALLS}, q as (select seg_id, ax - 200 as fx, ay - 300 as fy, bx - ax as ux, by_ - ay as uy from g),
c as (select *, ux * ux + uy * uy as qa, 2 * (fx * ux + fy * uy) as qb, fx * fx + fy * fy - 22500.0::double as qc from q),
r as (select *, unnest([-1, 1]) as side from c where qa > 0 and qb * qb - 4 * qa * qc >= 0),
t as (select *, (-qb + side * sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) as t from r),
o as (select seg_id, side, t, atan2(fy + t * uy, fx + t * ux) as turn from t)
select seg_id, side, round(t, 6) as t from o where (case when turn < 0 then turn + 2 * pi() else turn end) between 0.5 and 2.75""")
def line_arc_hits(spark, sf_dir):
    """Where the lines of segments meet an arc of radius 150 about (200, 300)."""
    near, far = shapes.line_arc((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.lit(200.0), F.lit(300.0)), F.lit(150.0), F.lit(0.5), F.lit(2.25))
    both = segments(spark).select("seg_id", F.explode(F.array(F.struct(F.lit(-1).alias("side"), near.alias("t")), F.struct(F.lit(1).alias("side"), far.alias("t")))).alias("h"))
    return both.where("h.t is not null").select("seg_id", "h.side", F.round("h.t", 6).alias("t"))
