"""Choice of physical strategy, and the policy that adapts it to a workload.

Answers never depend on the strategy: it only decides between a plain filter,
a broadcast nested loop and a cell join.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A query table is broadcast up to this many rows (some tens of MB).
BROADCAST_QUERIES = 100_000
#: Pairs that a nested loop may test before a cell join is planned.
NESTED_PAIRS = 50_000_000


@dataclass(frozen=True)
class Thresholds:
    """Limits of the policy; the file form is ``name = value`` lines with ``#`` comments."""

    brute_max: int = 64
    high_churn: float = 0.30
    rebuild_query_ratio: float = 0.2
    grid_min_hits: float = 9.0
    scan_budget: int = 60
    static_ticks: int = 30
    margin: float = 0.25
    hold_ticks: int = 30
    cooldown: int = 120
    decisive_factor: float = 4.0
    detector_alpha: float = 0.1
    warm_start: bool = True

    @classmethod
    def parse(cls, text: str) -> Thresholds:
        known = {f.name: f.type for f in fields(cls)}
        out = {}
        for line in text.splitlines():
            name, eq, value = line.partition("#")[0].partition("=")
            name, value = name.strip(), value.strip()
            if eq and name in known:
                out[name] = value.lower() == "true" if known[name] == "bool" else int(value) if known[name] == "int" else float(value)
        return cls(**out)

    def emit(self) -> str:
        return "".join(f"{k} = {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in asdict(self).items())


def join_strategy(points: int, queries: int) -> str:
    """nested or cells."""
    return "nested" if queries <= BROADCAST_QUERIES and points * queries <= NESTED_PAIRS else "cells"


def counted(df: DataFrame, most: int) -> int:
    """Rows of a table, counted no further than `most` + 1."""
    return df.limit(most + 1).count()


# Advisor: constants of the recommendation.
SMALL, STILL, CHURN = 512, 30, 0.30


def recommendation(items: Column, still: Column, relocation_rate: Column) -> Column:
    return F.when(items < SMALL, "Brute").when(still >= STILL, "Static").when(relocation_rate > CHURN, "CoarserOrRebuild").otherwise("KeepIndex")


def profile(ticks: DataFrame, key: str = "item", alpha: float = 0.1) -> DataFrame:
    """Exponential means of relocation rate and queries per move, and still ticks, by tick.

    ticks: key, tick, items, moves, relocations, queries.  The first tick sets
    a mean, later ones move it by alpha; a tick without moves has rate 0 and
    counts its queries whole.  The fold runs over the ticks of one key, which are
    one workload's history.
    """
    def per_move(a: Column, b: Column, still: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(still).cast("double")

    history = ticks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tick", "items", "moves", "relocations", "queries"))).alias("h"))
    start = F.struct(F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("per_move"), F.lit(0).cast("long").alias("still"), F.array().cast("array<struct<tick:bigint,items:bigint,rate:double,per_move:double,still:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        rate, per = per_move(x.relocations, x["moves"], F.lit(0.0)), per_move(x.queries, x["moves"], x.queries)
        r = F.when(acc.rate.isNull(), rate).otherwise(acc.rate + alpha * (rate - acc.rate))
        p = F.when(acc.per_move.isNull(), per).otherwise(acc.per_move + alpha * (per - acc.per_move))
        s = F.when(x["moves"] == 0, acc.still + 1).otherwise(F.lit(0)).cast("long")
        one = F.struct(x.tick.cast("long").alias("tick"), x["items"].cast("long").alias("items"), r.alias("rate"), p.alias("per_move"), s.alias("still"))
        return F.struct(r.alias("rate"), p.alias("per_move"), s.alias("still"), F.concat(acc.out, F.array(one)).alias("out"))

    return history.select(key, F.explode(F.aggregate("h", start, step, lambda a: a.out)).alias("t")).select(key, "t.*")


BRUTE, STATIC, GRID, TREE = "brute", "static", "grid", "tree"
#: Culls after which their mean result is trusted over geometry.
HITS_KNOWN = 8
#: Factor of population drift after which a grid's cells are sized anew.
GRID_DRIFT = 4.0


def hits_mean_q10(previous: int | None, hits: int) -> int:
    """Mean of hits in fixed point with 10 fraction bits; a tenth of the gap, cut towards zero."""
    now = hits << 10
    return now if previous is None else max(0, previous + int((now - previous) / 10))


def expected_hits(n: float, live: int, mean: float, samples: int, volume: float, extent: float) -> float:
    """Points that a cull should return at population n.

    The observed mean once there are enough samples; before that the density of
    the world times a sphere of the mean extent; unknown is infinite, for it must
    veto nothing.
    """
    if samples >= HITS_KNOWN:
        return mean * n / max(live, 1)
    if volume <= 0 or extent <= 0:
        return float("inf")
    return n / volume * 4 / 3 * math.pi * (extent / 2) ** 3


@dataclass
class Policy:
    """Which backend a workload should have, with hysteresis over ticks.

    Means are per item and start at 0.  Every boundary is widened by the margin
    in the direction of travel; a change waits until it was wanted `hold_ticks`
    times in a row and the last change is `cooldown` ticks old, unless the numbers
    are decisive.  A frozen policy observes but does not change.
    """

    backend: str = TREE
    queries: float = 0.0
    moves: float = 0.0
    still: int = 0
    wanted: str = ""
    held: int = 0
    cooling: int = 0
    near_misses: int = 0
    migrations: int = 0
    grid_for: int = 0
    frozen: bool = False

    def wants(self, n: float, hits: float, th: Thresholds) -> str:
        def edge(limit: float, at: str, enter: int) -> float:
            """The limit, moved so that what is in force stays in force longer."""
            return limit * (1 + th.margin * (-enter if self.backend == at else enter))

        scan = self.moves * th.scan_budget
        rules = (
            (BRUTE, n <= edge(th.brute_max, BRUTE, -1) or self.queries * n < edge(scan, BRUTE, -1)),
            (STATIC, self.still >= th.static_ticks),
            (GRID, self.queries > edge(th.rebuild_query_ratio, GRID, 1) and hits >= edge(th.grid_min_hits, GRID, 1)),
        )
        return next((backend for backend, holds in rules if holds), TREE)

    def decisive(self, want: str, n: float, th: Thresholds) -> bool:
        """Whether the numbers lie so far beyond the boundary that there is nothing to wait for."""
        f, scan = th.decisive_factor, self.moves * th.scan_budget
        return {
            BRUTE: n * f <= th.brute_max or self.queries * n * f <= scan,
            GRID: self.queries >= th.rebuild_query_ratio * f,
            TREE: self.queries * n >= scan * f and n >= th.brute_max * f,
            STATIC: self.still >= th.static_ticks * f,
        }[want]

    def tick(self, live: int, moves: int, queries: int, hits: float = float("inf"), th: Thresholds = Thresholds()) -> bool:
        """Close a tick: whether the backend changed."""
        per = (queries / live, moves / live) if live else (0.0, 0.0)
        self.queries += th.detector_alpha * (per[0] - self.queries)
        self.moves += th.detector_alpha * (per[1] - self.moves)
        self.still = 0 if moves else self.still + 1
        self.cooling = max(0, self.cooling - 1)
        if self.backend == GRID and self.grid_for and not 1 / GRID_DRIFT <= max(live, 1) / self.grid_for <= GRID_DRIFT:
            self.grid_for = live
        want = self.wants(live, hits, th)
        if want == self.backend:
            self.wanted, self.held = "", 0
            return False
        self.held = self.held + 1 if want == self.wanted else 1
        self.wanted = want
        ready = self.decisive(want, live, th) or self.held >= th.hold_ticks and self.cooling == 0
        if self.frozen or not ready:
            self.near_misses += 1
            return False
        self.backend, self.wanted, self.held, self.cooling = want, "", 0, th.cooldown
        self.migrations += 1
        self.grid_for = live if want == GRID else 0
        return True


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
