"""Cells, leaves and keys: layouts as columns, and what can be read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..plans.lineage import cut as settled
from ..sources.points import PointFrame


def with_cell(points: PointFrame, levels: int, name: str = "cell") -> DataFrame:
    return points.df.withColumn(name, points.cell_key(levels))


def occupancy(points: PointFrame, levels: int) -> DataFrame:
    """One row: occupied cells, items, mean and largest items a cell."""
    cells = points.df.select(points.cell_key(levels).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return cells.agg(F.count("*").alias("cells"), F.sum("n").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def region(points: PointFrame, prefix: int, digits: int, levels: int) -> DataFrame:
    """Points under a key prefix: one contiguous key range."""
    a, z = keys.prefix_range(prefix, digits, levels, len(points.coords))
    return with_cell(points, levels).where(F.col("cell").between(a, z))


def roll_up(points: PointFrame, levels: int, steps: int) -> DataFrame:
    """(prefix, n): points by the cell `steps` levels up."""
    return with_cell(points, levels).groupBy(keys.coarser("cell", steps, len(points.coords)).alias("prefix")).agg(F.count("*").alias("n"))


def leaf_table(points: PointFrame, levels: int) -> DataFrame:
    """(cell, n, lo_*, hi_*): occupied cells with their boxes."""
    idx = points.cell_indices(levels)
    names = [f"i_{c}" for c in points.coords]
    cells = points.df.select(points.cell_key(levels).alias("cell"), *(i.alias(n) for i, n in zip(idx, names))).groupBy("cell", *names).agg(F.count("*").alias("n"))
    boxes = []
    for c, n, (lo, _), size in zip(points.coords, names, points.world, points.cell_sizes(levels)):
        boxes += [(F.col(n) * size + lo).alias(f"lo_{c}"), ((F.col(n) + 1) * size + lo).alias(f"hi_{c}")]
    return cells.select("cell", "n", *boxes)


def children(leaves: DataFrame, coords=("x", "y")) -> DataFrame:
    """(cell, child, lo_*, hi_*): the boxes of each cell's children; bit i of `child` is the upper half of axis i."""
    child = F.explode(F.sequence(F.lit(0), F.lit((1 << len(coords)) - 1))).alias("child")
    out = leaves.select("cell", *(F.col(f"{e}_{c}") for c in coords for e in ("lo", "hi")), child)
    boxes = []
    for i, c in enumerate(coords):
        middle = (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2
        upper = F.col("child").bitwiseAND(1 << i) != 0
        boxes += [F.when(upper, middle).otherwise(F.col(f"lo_{c}")).alias(f"lo_{c}"), F.when(upper, F.col(f"hi_{c}")).otherwise(middle).alias(f"hi_{c}")]
    return out.select("cell", "child", *boxes)


def in_key_order(points: PointFrame, levels: int) -> DataFrame:
    """All points along the space-filling curve, ties by id: a range-partitioned sort, no task holds all."""
    return with_cell(points, levels).orderBy("cell", points.id)


def at_code(points: PointFrame, code: int, levels: int) -> DataFrame:
    """Points of the cell that a location code names (a leading one, then its digits)."""
    dims = len(points.coords)
    digits = (code.bit_length() - 1) // dims
    return region(points, code ^ (1 << (digits * dims)), digits, levels)


def adaptive_leaves(points: PointFrame, capacity: int, max_depth: int) -> DataFrame:
    """(code, level, n): leaves of the linear quad- or octree that splits cells over `capacity`.

    A leaf is an occupied cell within capacity (or at full depth) whose parent
    is over capacity.  One pass over the points counts the finest cells; the
    coarser counts come from those.  The shape depends on the points alone, not
    on the order of inserts and removes.
    """
    dims = len(points.coords)
    fine = points.df.select(points.cell_key(max_depth).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    by_level = fine.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_depth)), lambda d: F.struct(d.alias("level"), F.call_function("shiftright", F.col("cell"), ((F.lit(max_depth) - d) * dims).cast("int")).alias("key")))).alias("c"))
    counts = by_level.groupBy("c.level", "c.key").agg(F.sum("n").alias("n"))
    parents = counts.where(F.col("n") > capacity).select((F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
    fits = counts.where((F.col("n") <= capacity) | (F.col("level") == max_depth)).withColumn("parent", F.shiftright("key", dims))
    below = fits.where("level > 0").join(parents, ["level", "parent"], "left_semi")
    leaves = below.unionByName(fits.where("level = 0").select(*below.columns))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("level") * dims).cast("int"))
    return leaves.select(one.bitwiseOR(F.col("key")).alias("code"), F.col("level").cast("int").alias("level"), "n")


def ancestors(key: Column, max_depth: int, dims: int) -> Column:
    """Location codes of a finest cell and of all cells above it, coarsest first."""
    one = lambda d: F.call_function("shiftleft", F.lit(1).cast("long"), (d * dims).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(max_depth)), lambda d: one(d).bitwiseOR(F.call_function("shiftright", key, ((F.lit(max_depth) - d) * dims).cast("int"))))


def locate(points: PointFrame, leaves: DataFrame, max_depth: int) -> DataFrame:
    """(id, code): the leaf that holds each point; all ancestors of a cell are looked up at once, once a cell.

    The points themselves are joined by their finest cell and not multiplied.
    """
    cell = points.df.select(points.id, points.cell_key(max_depth).alias("cell"))
    up = cell.select("cell").distinct().withColumn("code", F.explode(ancestors(F.col("cell"), max_depth, len(points.coords))))
    return cell.join(up.join(leaves.select("code"), "code"), "cell").select(points.id, "code")


def neighbours(leaves: DataFrame, coords=("x", "y")) -> DataFrame:
    """(cell, other, side): boxes that share an edge or face, with open overlap across it.

    The shared coordinate is the join key, so there is no pairwise comparison.
    """
    out = None
    b = leaves.select(*(F.col(c).alias(f"b_{c}") for c in leaves.columns))
    for c in coords:
        on = F.col(f"hi_{c}") == F.col(f"b_lo_{c}")
        for o in coords:
            if o != c:
                on = on & (F.col(f"lo_{o}") < F.col(f"b_hi_{o}")) & (F.col(f"hi_{o}") > F.col(f"b_lo_{o}"))
        pairs = leaves.join(b, on)
        one = pairs.select("cell", F.col("b_cell").alias("other"), F.lit(f"+{c}").alias("side")).unionByName(pairs.select(F.col("b_cell").alias("cell"), F.col("cell").alias("other"), F.lit(f"-{c}").alias("side")))
        out = one if out is None else out.unionByName(one)
    return out


def overlap(boxes: DataFrame, coords=("x", "y"), cell: float = 64.0) -> DataFrame:
    """One row: pairs of boxes that overlap openly and the volume that they share (nothing for a partition of space).

    Boxes (cell, lo_*, hi_*) meet by grid cells of side `cell` over the first two axes; a pair counts in the
    least cell that both have.
    """
    grid = [(c, f"__g{k}") for k, c in enumerate(coords[:2])]
    a = boxes.select("cell", *(F.col(f"{e}_{c}") for c in coords for e in ("lo", "hi")))
    for c, g in grid:
        a = a.withColumn(g, F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / cell), F.floor(F.col(f"hi_{c}") / cell))))
    b = a.select(*(F.col(n).alias(n if n.startswith("__g") else f"b_{n}") for n in a.columns))
    pairs = a.join(b, [g for _, g in grid]).where("cell < b_cell")
    shared = F.lit(1.0)
    for c in coords:
        side = F.least(f"hi_{c}", f"b_hi_{c}") - F.greatest(f"lo_{c}", f"b_lo_{c}")
        pairs, shared = pairs.where(side > 0), shared * side
    for c, g in grid:
        pairs = pairs.where(F.col(g) == F.floor(F.greatest(f"lo_{c}", f"b_lo_{c}") / cell))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.coalesce(F.sum(shared), F.lit(0.0)), 6).alias("shared"))


def quality(points: PointFrame, levels: int, capacity: int = 8) -> DataFrame:
    """One row of index quality: dead volume, margin, fill, balance (max over mean)."""
    cell = points.cell_key(levels).alias("cell")
    tight = points.df.select(cell, *points.coords).groupBy("cell").agg(F.count("*").alias("n"), *(a for c in points.coords for a in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"z_{c}"))))
    volume, margin, whole = F.lit(1.0), F.lit(0.0), 1.0
    for c, size in zip(points.coords, points.cell_sizes(levels)):
        volume, margin, whole = volume * (F.col(f"z_{c}") - F.col(f"a_{c}")), margin + (F.col(f"z_{c}") - F.col(f"a_{c}")), whole * size
    return tight.agg(
        F.count("*").alias("leaves"), F.round(1 - F.avg(volume / whole), 9).alias("dead"), F.round(F.avg(margin), 6).alias("margin"),
        F.round(F.avg(F.least(F.col("n") / capacity, F.lit(1.0))), 9).alias("fill"), F.round(F.max("n") / F.avg("n"), 9).alias("balance"),
    )


def curve_shards(points: PointFrame, levels: int, shards: int) -> DataFrame:
    """(cell, n, shard): cells in key order, filled into shards of equal quota by a running sum."""
    cells = points.df.select(points.cell_key(levels).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return by_quota(cells, "cell", "n", shards)


def by_quota(cells: DataFrame, key: str, n: str, shards: int) -> DataFrame:
    """Running sum over ordered cells in two steps: within blocks of keys, then over block totals."""
    top = cells.agg(F.min(key).alias("a"), F.max(key).alias("z"), F.sum(n).alias("all"))
    blocked = cells.crossJoin(F.broadcast(top)).withColumn("__b", F.floor((F.col(key) - F.col("a")) * 256.0 / (F.col("z") - F.col("a") + 1)))
    sums = blocked.groupBy("__b").agg(F.sum(n).alias("s"))  # at most 256 rows
    before = sums.select("__b", (F.sum("s").over(Window.orderBy("__b")) - F.col("s")).alias("before"))
    upto = F.sum(n).over(Window.partitionBy("__b").orderBy(key)) - F.col(n)
    placed = blocked.join(F.broadcast(before), "__b").withColumn("at", F.col("before") + upto)
    return placed.select(key, n, F.least(F.lit(shards - 1), F.floor(F.col("at") * shards / F.col("all"))).cast("int").alias("shard"))


def key_filter(points: PointFrame, lo: tuple[float, ...], hi: tuple[float, ...], levels: int, most: int = 64) -> Column:
    """Predicate on ``cell`` that covers a box: ranges for the scan, a superset of the exact test."""
    sizes = points.cell_sizes(levels)
    index = lambda v, w, s: max(0, min((1 << levels) - 1, int((v - w[0]) // s)))
    a = tuple(index(v, w, s) for v, w, s in zip(lo, points.world, sizes))
    z = tuple(index(v, w, s) for v, w, s in zip(hi, points.world, sizes))
    return keys.in_ranges("cell", keys.box_ranges(a, z, levels, most))


def tight_leaves(points: PointFrame, levels: int) -> DataFrame:
    """(cell, n, lo_*, hi_*) with the tight boxes of the points in each cell."""
    return points.df.select(points.cell_key(levels).alias("cell"), *points.coords).groupBy("cell").agg(F.count("*").alias("n"), *(a for c in points.coords for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))))


def longest_first(cells: DataFrame, n: str, shards: int, key: str = "cell") -> list[tuple[int, int]]:
    """(key, shard) by greedy packing, largest cell first onto the lightest shard.

    The greedy is sequential; it runs on the driver over cells, whose number is
    that of the grid, not of the points; a table of more than 100 000 is refused.
    """
    import heapq

    rows = cells.select(key, n).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many cells to pack on the driver; use a coarser grid or curve_shards")
    heap = [(0, s) for s in range(shards)]
    out = []
    for k, size in sorted(((r[0], r[1]) for r in rows), key=lambda r: (-r[1], r[0])):
        load, s = heapq.heappop(heap)
        out.append((k, s))
        heapq.heappush(heap, (load + size, s))
    return out


def median_leaves(points: PointFrame, capacity: int, total: int) -> DataFrame:
    """(id, leaf): leaves of a k-d partition with at most about `capacity` points.

    Every level cuts each node at the median of the longest axis of its tight
    box; points at the median go low, so nodes of inseparable points stay whole.
    The cut table has one row a node and is broadcast while it is small (its size
    is 2 ** depth, which is known beforehand).  Lineage is cut at every level, so
    a level's plan is one aggregate and one join whatever the depth.
    """
    depth = max(0, (max(total, 1) - 1).bit_length() - max(capacity, 1).bit_length() + 1)
    df = settled(points.df.select(points.id, *points.coords).withColumn("leaf", F.lit(1).cast("long")))
    for level in range(depth):
        boxes = df.groupBy("leaf").agg(*(a for c in points.coords for a in ((F.max(c) - F.min(c)).alias(f"e_{c}"), F.percentile_approx(c, 0.5, 1000).alias(f"m_{c}"))))
        longest = F.greatest(*(F.col(f"e_{c}") for c in points.coords))
        axis, cut = F.lit(None).cast("string"), F.lit(None).cast("double")
        for c in reversed(points.coords):
            axis = F.when(F.col(f"e_{c}") == longest, F.lit(c)).otherwise(axis)
            cut = F.when(F.col(f"e_{c}") == longest, F.col(f"m_{c}")).otherwise(cut)
        cuts = boxes.select("leaf", axis.alias("axis"), cut.alias("cut"))
        at = F.lit(None).cast("double")
        for c in points.coords:
            at = F.when(F.col("axis") == c, F.col(c)).otherwise(at)
        joined = df.join(F.broadcast(cuts) if level < 16 else cuts, "leaf")
        df = joined.withColumn("leaf", F.col("leaf") * 2 + F.when(at > F.col("cut"), 1).otherwise(0)).drop("axis", "cut")
        df = settled(df) if level + 1 < depth else df
    return df.select(points.id, "leaf")
