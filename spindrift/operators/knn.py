"""Nearest neighbours; ties are broken by id, so the answer does not depend on the strategy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shapes import square
from ..plans import planner
from ..plans.lineage import cut as settled
from ..sources.points import PointFrame
from .cull import balls, cull_many


def distance2(p: list, q: list) -> Column:
    total = None
    for a, b in zip(p, q):
        a, b = (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b))
        one = square(a - b)
        total = one if total is None else total + one
    return total


def knn(points: PointFrame, q: tuple[float, ...], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest points to one place, with ``dist``, nearest first."""
    df = points.df if where is None else points.df.where(where)
    return df.withColumn("__d2", distance2(list(points.coords), list(q))).orderBy("__d2", points.id).limit(k).withColumn("dist", F.sqrt("__d2")).drop("__d2")


def _rank(pairs: DataFrame, k: int, qid: str, id: str) -> DataFrame:
    w = Window.partitionBy(qid).orderBy("d2", id)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sure_radius(points: PointFrame, queries: DataFrame, k: int, qid: str, centre) -> DataFrame:
    """queries with ``__r2``: a squared distance within which k points surely lie.

    One pass counts the points of coarse cells (at most 4096) and their tight
    boxes; by query, cells are taken in order of their farthest corner until they
    hold k points.
    """
    p = list(points.coords)
    many = max(1, planner.counted(queries, planner.BROADCAST_QUERIES))
    level = max(1, min(12 // len(p), int(math.log2(max(2.0, planner.NESTED_PAIRS / many)) / len(p))))
    cells = points.df.select(points.cell_key(level).alias("__cell"), *p).groupBy("__cell").agg(F.count("*").alias("__n"), *(a for c in p for a in (F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__z_{c}"))))
    far = None
    for c, q in zip(p, centre):
        one = square(F.greatest(F.abs(F.col(q) - F.col(f"__a_{c}")), F.abs(F.col(q) - F.col(f"__z_{c}"))))
        far = one if far is None else far + one
    met = queries.select(qid, *centre).join(F.broadcast(cells), F.lit(True)).select(qid, far.alias("__far"), "__n")
    upto = met.withColumn("__upto", F.sum("__n").over(Window.partitionBy(qid).orderBy("__far")))
    sure = upto.where(F.col("__upto") >= k).groupBy(qid).agg((F.min("__far") * (1 + 1e-9) + 1e-300).alias("__r2"))
    return queries.join(sure, qid, "left").withColumn("__r2", F.coalesce("__r2", F.lit(float("inf"))))


def _dealt(df: DataFrame) -> DataFrame:
    """df over all cores, where its source has fewer splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def knn_many(points: PointFrame, queries: DataFrame, k: int, qid: str = "qid", centre=("qx", "qy"), extra: Column | None = None, strategy: str = "auto", rounds: int = 12) -> DataFrame:
    """k nearest points of every query row: columns of both, ``d2`` and ``rank``.

    nested: broadcast queries, each with a radius that surely holds k points by
    coarse cell counts, and a ranking of the few pairs within it, whose group
    limit runs before the shuffle.  cells: a radius is estimated from the density; queries whose k-th
    neighbour lies within the searched radius are done, the others search on
    with twice the radius; the last ones go to the nested arm.
    ``extra`` restricts the pairs before the k are taken.
    """
    if k <= 0:
        return points.df.crossJoin(queries.limit(0)).limit(0).withColumns({"d2": F.lit(0.0), "rank": F.lit(0)})
    p = list(points.coords)
    d2 = distance2(p, list(centre))
    if strategy == "auto":
        few = planner.counted(queries, planner.BROADCAST_QUERIES)
        strategy = planner.join_strategy(points.df.count(), few)
    if strategy == "nested":
        few = planner.counted(queries, planner.BROADCAST_QUERIES) <= planner.BROADCAST_QUERIES
        if extra is not None or not few:
            pairs = points.df.join(F.broadcast(queries) if few else queries, extra if extra is not None else F.lit(True))
            return _rank(pairs.withColumn("d2", d2), k, qid, points.id)
        bounded = F.broadcast(_sure_radius(points, queries, k, qid, centre))
        pairs = _dealt(points.df).join(bounded, d2 <= F.col("__r2")).drop("__r2")
        return _rank(pairs.withColumn("d2", d2), k, qid, points.id)
    extent = points.df.agg(F.count("*"), *(F.max(c) - F.min(c) for c in p)).first()
    n, volume = extent[0], 1.0
    for e in extent[1:]:
        volume *= max(float(e or 0), 1e-9)
    radius = (2.0 * k * volume / max(n, 1)) ** (1 / len(p))
    done, todo = None, queries
    for _ in range(rounds):
        found = cull_many(points, balls(todo.withColumn("__r", F.lit(radius)), centre, "__r"), cell=radius, strategy="cells").drop("__r")
        if extra is not None:
            found = found.where(extra)
        ranked = _rank(found.withColumn("d2", d2), k, qid, points.id).persist()
        full = ranked.groupBy(qid).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(qid)
        part = ranked.join(full, qid, "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = todo.join(full, qid, "left_anti")
        if planner.counted(todo, 256) <= 256:
            break
        radius *= 2
    return done.unionByName(knn_many(points, todo, k, qid, centre, extra, "nested").select(*done.columns)) if todo.take(1) else done


def knn_self(points: PointFrame, k: int, strategy: str = "auto", extra: Column | None = None) -> DataFrame:
    """k nearest other points of every point: (qid, id, d2, rank)."""
    q = points.df.select(F.col(points.id).alias("qid"), *(F.col(c).alias(f"q{c}") for c in points.coords))
    other = F.col(points.id) != F.col("qid")
    out = knn_many(points, q, k, "qid", tuple(f"q{c}" for c in points.coords), other if extra is None else other & extra, strategy)
    return out.select("qid", points.id, "d2", "rank")


def kth_distance2(points: PointFrame, k: int) -> DataFrame:
    """(qid, d2): squared distance of every point to its k-th nearest other one, or to the farthest if there are fewer; none for a lone point.

    Points at one place have one answer: places with their numbers of points are
    searched, and only those of at most k points.  Ids that repeat name one point
    in several places; such a table is searched point by point.
    """
    df = points.df.where(F.col(points.id).isNotNull())
    if not df.groupBy(points.id).count().where("count > 1").isEmpty():
        return knn_self(points.using(df), k, strategy="cells").groupBy("qid").agg(F.max("d2").alias("d2"))
    p = list(points.coords)
    places = settled(df.groupBy(*p).agg(F.min(points.id).alias(points.id), F.count("*").alias("__many")))
    searched = places.where(F.col("__many") <= k).select(F.col(points.id).alias("qid"), F.col("__many").alias("__own"), *(F.col(c).alias(f"q{c}") for c in p))
    near = knn_many(points.using(places), searched, k, "qid", tuple(f"q{c}" for c in p), F.col(points.id) != F.col("qid"), "cells")
    # A place has at least one point, so k places hold enough.
    upto = F.col("__own") - 1 + F.sum("__many").over(Window.partitionBy("qid").orderBy("rank"))
    kth = near.withColumn("__upto", upto).groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("__upto") >= k, F.col("d2"))), F.max("d2")).alias("d2"))
    kth = places.join(kth.withColumnRenamed("qid", points.id), points.id, "left")
    # Enough points at the place itself, or none elsewhere.
    kth = kth.select(*p, F.when((F.col("__many") > k) | F.col("d2").isNull() & (F.col("__many") > 1), F.lit(0.0)).otherwise(F.col("d2")).alias("d2")).where("d2 is not null")
    return df.select(F.col(points.id).alias("qid"), *p).join(kth, p).select("qid", "d2")


def nearest_within(points: PointFrame, queries: DataFrame, reach: float, qid: str = "qid", centre=("qx", "qy"), extra: Column | None = None, **how) -> DataFrame:
    """The nearest point within `reach` of each query that has one: (qid, id, d2)."""
    near = cull_many(points, balls(queries.withColumn("__r", F.lit(float(reach))), centre, "__r"), **how)
    if extra is not None:
        near = near.where(extra)
    best = near.groupBy(qid).agg(F.min(F.struct(distance2(list(points.coords), list(centre)).alias("d2"), points.id)).alias("b"))
    return best.select(qid, F.col(f"b.{points.id}").alias(points.id), F.col("b.d2").alias("d2"))


def first_matching(neighbours: DataFrame, condition: Column, qid: str = "qid") -> DataFrame:
    """Filter after k: the nearest of the k that meets the condition; a query may have none."""
    w = Window.partitionBy(qid).orderBy("rank")
    return neighbours.where(condition).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def chain(neighbours: DataFrame, condition: Column, links: int, qid: str = "qid") -> DataFrame:
    """Up to `links` of the k neighbours that meet the condition, renumbered as ``link``."""
    w = Window.partitionBy(qid).orderBy("rank")
    return neighbours.where(condition).withColumn("link", F.row_number().over(w)).where(F.col("link") <= links)
