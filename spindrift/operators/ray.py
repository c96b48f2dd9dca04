"""Rays, corridors of cells, and lines of sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.shapes import PARALLEL, capsule_distance2
from ..sources.points import PointFrame
from . import cells
from .cull import capsules, cull_many


def _unit(direction: tuple) -> list[Column]:
    """Direction columns divided by their length; null for a zero direction."""
    d = [F.col(c) for c in direction]
    n2 = d[0] * d[0]
    for v in d[1:]:
        n2 = n2 + v * v
    return [v / F.when(n2 > 0, F.sqrt(n2)) for v in d]


def along(p: list[Column], origin: tuple, direction: tuple, reach: Column) -> Column:
    """Position of a point's projection on a ray, held in [0, reach]."""
    t = None
    for v, o, u in zip(p, origin, _unit(direction)):
        one = (v - F.col(o)) * u
        t = one if t is None else t + one
    return F.greatest(F.lit(0.0), F.least(reach, t))


def raycast(points: PointFrame, rays: DataFrame, origin=("ox", "oy"), direction=("dx", "dy"), reach: str = "reach", radius: str = "r", **how) -> DataFrame:
    """Every (ray, point) with the point within ``radius`` of the ray, and its ``t``.

    A ray of no direction meets nothing.
    """
    ends = [f"__e{i}" for i in range(len(origin))]
    unit = _unit(direction)
    cast = rays.withColumns({e: F.col(o) + u * F.col(reach) for e, o, u in zip(ends, origin, unit)}).where(F.col(ends[0]).isNotNull())
    hit = cull_many(points, capsules(cast, origin, tuple(ends), radius), **how)
    return hit.withColumn("t", along([F.col(c) for c in points.coords], origin, direction, F.col(reach))).drop(*ends)


def first_hit(hits: DataFrame, id: str = "id", ray: str = "ray_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The nearest point of each ray: (ray_id, id, t)."""
    b = hits.groupBy(ray).agg(F.min(F.struct("t", id, *keep)).alias("b"))
    return b.select(ray, F.col(f"b.{id}").alias(id), F.col("b.t").alias("t"), *(F.col(f"b.{c}").alias(c) for c in keep))


def slab(a: list[Column], b: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Whether a segment meets a box (closed)."""
    t0, t1, miss = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q, l, h in zip(a, b, lo, hi):
        d = q - p
        flat = F.abs(d) < PARALLEL
        s = F.when(flat, F.lit(1.0)).otherwise(d)
        x, y = (l - p) / s, (h - p) / s
        miss = miss | (flat & ((p < l) | (p > h)))
        t0 = F.when(flat, t0).otherwise(F.greatest(t0, F.least(x, y)))
        t1 = F.when(flat, t1).otherwise(F.least(t1, F.greatest(x, y)))
    return ~miss & (t0 <= t1)


def _crossed(points: PointFrame, rays: DataFrame, levels: int, origin, direction, reach: str) -> tuple[DataFrame, list[str], list[str]]:
    """(rays with one row a grid cell that the centre line crosses, names of the end columns, of the cell columns)."""
    ends = [f"__e{i}" for i in range(len(origin))]
    cast = rays.withColumns({e: F.col(o) + u * F.col(reach) for e, o, u in zip(ends, origin, _unit(direction))}).where(F.col(ends[0]).isNotNull())
    names = [f"__i{k}" for k in range(len(points.coords))]
    lo, hi = [], []
    for n, o, e, (w, _), size in zip(names, origin, ends, points.world, points.cell_sizes(levels)):
        # One cell to spare on either side: a segment along a cell's face touches both cells.
        first = F.greatest(F.floor((F.least(o, e) - w) / size) - 1, F.lit(0).cast("long"))
        last = F.least(F.floor((F.greatest(o, e) - w) / size) + 1, F.lit((1 << levels) - 1).cast("long"))
        cast = cast.where(first <= last).withColumn(n, F.explode(F.sequence(first, last)))
        lo.append(F.col(n) * size + w)
        hi.append((F.col(n) + 1) * size + w)
    return cast.where(slab([F.col(o) for o in origin], [F.col(e) for e in ends], lo, hi)), ends, names


def corridor(points: PointFrame, rays: DataFrame, levels: int, origin=("ox", "oy"), direction=("dx", "dy"), reach: str = "reach", radius: str = "r") -> DataFrame:
    """Ray hits among the points of grid cells that the centre line crosses; a subset of ``raycast``.

    Each ray lists the cells of its box that it crosses, points join their cell,
    and only they are measured.  In two or three dimensions.
    """
    crossed, ends, names = _crossed(points, rays, levels, origin, direction, reach)
    placed = points.df.withColumns(dict(zip(names, points.cell_indices(levels))))
    p = [F.col(c) for c in points.coords]
    hit = placed.join(crossed, names).where(capsule_distance2(p, list(origin), ends) <= F.col(radius) * F.col(radius))
    return hit.withColumn("t", along(p, origin, direction, F.col(reach))).drop(*ends, *names)


def leaf_corridor(points: PointFrame, rays: DataFrame, capacity: int, max_depth: int, origin=("ox", "oy"), direction=("dx", "dy"), reach: str = "reach", radius: str = "r", ray: str = "ray_id") -> DataFrame:
    """Ray hits among the points of adaptive leaves that the centre line crosses, with ``t``.

    A leaf is crossed when one of its finest cells is.  Rays carry their crossed
    cells up to the leaves that hold them, once a leaf, and points join by leaf.
    """
    leaves = cells.adaptive_leaves(points, capacity, max_depth).select("code")
    crossed, ends, names = _crossed(points, rays, max_depth, origin, direction, reach)
    key = keys.morton([F.col(n) for n in names])
    up = crossed.select(ray, F.explode(cells.ancestors(key, max_depth, len(names))).alias("code")).distinct()
    met = up.join(leaves, "code").join(crossed.drop(*names).dropDuplicates([ray]), ray)
    placed = points.df.join(cells.locate(points, leaves, max_depth), points.id)
    p = [F.col(c) for c in points.coords]
    hit = placed.join(met, "code").where(capsule_distance2(p, list(origin), ends) <= F.col(radius) * F.col(radius))
    return hit.withColumn("t", along(p, origin, direction, F.col(reach))).drop(*ends, "code")


def _box_of(planes: str) -> list[tuple[Column, Column]]:
    """Bounds of a solid by axis, from its planes that are parallel to the axes; null where it has none."""
    out = []
    for k, n in enumerate(("nx", "ny", "nz")):
        def facing(sign: float, k: int = k, n: str = n) -> Column:
            flat = lambda p: F.forall(F.array(*(p[m] for i, m in enumerate(("nx", "ny", "nz")) if i != k)), lambda v: v == 0) & (p[n] * sign > 0)
            return F.array_min(F.transform(F.filter(planes, flat), lambda p: p.d / F.abs(p[n])))

        out.append((-facing(-1.0), facing(1.0)))
    return out


def _near_pairs(segments: DataFrame, solids: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """Segments and boxed solids whose boxes meet, by grid cells of the first two axes."""
    boxed = solids.withColumns({f"__{e}{k}": v for k, (lo, hi) in enumerate(_box_of("planes")) for e, v in (("l", lo), ("h", hi))})
    free = boxed.where(F.col("__l0").isNull() | F.col("__h0").isNull() | F.col("__l1").isNull() | F.col("__h1").isNull())
    if free.limit(FEW_SOLIDS + 1).count() > FEW_SOLIDS:
        raise ValueError("too many solids without a box; give them planes that bound x and y")
    wide = segments.withColumns({f"__{e}{k}s": f(a[k], b[k]) for k in range(3) for e, f in (("l", F.least), ("h", F.greatest))})
    boxed = boxed.join(free.select("sid"), "sid", "left_anti")
    side = max((v or 0.0) for v in boxed.agg(*(F.avg(F.col(f"__h{k}") - F.col(f"__l{k}")) for k in range(2))).first())
    reach = max((v or 0.0) for v in wide.agg(*(F.avg(F.col(f"__h{k}s") - F.col(f"__l{k}s")) for k in range(2))).first())
    cell = max(side, reach / 8, 1e-9)
    first = {f"__c{k}{e}": F.floor(F.col(f"__l{k}{e}") / cell) for k in range(2) for e in ("", "s")}

    def over(df: DataFrame, e: str) -> DataFrame:
        df = df.withColumns({n: v for n, v in first.items() if n.endswith("s") == bool(e)})
        for k in range(2):
            df = df.withColumn(f"__g{k}", F.explode(F.sequence(F.col(f"__c{k}{e}"), F.floor(F.col(f"__h{k}{e}") / cell))))
        return df

    pairs = over(wide, "s").join(over(boxed, ""), ["__g0", "__g1"])
    # A pair meets in many cells; it counts in the least that both have.
    for k in range(2):
        pairs = pairs.where(F.col(f"__g{k}") == F.greatest(f"__c{k}", f"__c{k}s"))
    for k in range(3):
        pairs = pairs.where((F.col(f"__l{k}s") <= F.coalesce(f"__h{k}", F.lit(float("inf")))) & (F.col(f"__h{k}s") >= F.coalesce(f"__l{k}", F.lit(float("-inf")))))
    columns = [*segments.columns, *solids.columns]
    return pairs.select(*columns).unionByName(segments.join(F.broadcast(free.select(*solids.columns)), F.lit(True)).select(*columns))


#: So many solids are broadcast and tested against every segment; more are joined by cell.
FEW_SOLIDS = 10_000


def blocked_rays(segments: DataFrame, solids: DataFrame, a=("ax", "ay", "az"), b=("bx", "by", "bz"), few: int = FEW_SOLIDS) -> DataFrame:
    """(seg_id, sid, t): where segments enter convex solids.

    solids: sid and ``planes``, an array of (nx, ny, nz, d) with n.p <= d inside.
    The solids of a scene are few and are broadcast; more than `few` meet the
    segments by grid cell first.
    """
    def clip(acc: Column, p: Column) -> Column:
        slope = (F.col(b[0]) - F.col(a[0])) * p.nx + (F.col(b[1]) - F.col(a[1])) * p.ny + (F.col(b[2]) - F.col(a[2])) * p.nz
        gap = p.d - (F.col(a[0]) * p.nx + F.col(a[1]) * p.ny + F.col(a[2]) * p.nz)
        flat = F.abs(slope) < PARALLEL
        t = gap / F.when(flat, F.lit(1.0)).otherwise(slope)
        return F.struct(
            F.when(~flat & (slope < 0), F.greatest(acc.t0, t)).otherwise(acc.t0).alias("t0"),
            F.when(flat & (gap < 0), F.lit(-1.0)).when(~flat & (slope > 0), F.least(acc.t1, t)).otherwise(acc.t1).alias("t1"),
        )

    pairs = segments.join(F.broadcast(solids), F.lit(True)) if solids.limit(few + 1).count() <= few else _near_pairs(segments, solids, a, b)
    span = F.aggregate("planes", F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")), clip)
    return pairs.withColumn("__s", span).where(F.col("__s.t0") <= F.col("__s.t1")).withColumn("t", F.col("__s.t0")).drop("__s", "planes")


def visible(segments: DataFrame, solids: DataFrame, seg_id: str = "seg_id", **ends) -> DataFrame:
    """Segments that no solid blocks before their end."""
    return segments.join(blocked_rays(segments, solids, **ends).where("t < 1").select(seg_id).distinct(), seg_id, "left_anti")


def sampled_clear(a: tuple[Column, Column], b: tuple[Column, Column], covered, step: float = 5.0) -> Column:
    """Whether samples every `step` along a-b all avoid cover; covered: (x, y) -> Column."""
    length = F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))
    n = F.greatest(F.ceil(length / step).cast("int"), F.lit(1))
    return ~F.exists(F.sequence(F.lit(1), n), lambda i: covered(a[0] + (b[0] - a[0]) * (i / n), a[1] + (b[1] - a[1]) * (i / n)))


def distance2_to_segment(p: list[Column], a: tuple, b: tuple) -> Column:
    return capsule_distance2(p, list(a), list(b))
