"""Structured Streaming: a workload's ticks advance the policy; positions give crossings per window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.planner import Policy, Thresholds
from ..sources.points import PointFrame

OUTPUT = "item long, tick long, items long, queries_per_item double, moves_per_item double, still long, backend string, switched boolean, near_misses long"
STATE = "backend string, queries double, moves double, still long, wanted string, held long, cooling long, near_misses long, migrations long, grid_for long, frozen boolean"


def policy_stream(ticks: DataFrame, thresholds: Thresholds = Thresholds(), expected_hits: float = float("inf")) -> DataFrame:
    """One row a tick with the means and the backend in force after it.

    ticks (stream or table): item, tick, items, moves, relocations, queries.
    State is a few numbers an item.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = _fold(key, pd.concat(list(frames)), state.get if state.exists else None, thresholds, expected_hits)
        state.update(now)
        yield out

    return ticks.groupBy("item").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def policy_table(ticks: DataFrame, thresholds: Thresholds = Thresholds(), expected_hits: float = float("inf")) -> DataFrame:
    """The same over a table: the ticks of one workload are folded in order, in one task an item."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _fold(key, rows, None, thresholds, expected_hits)[0]

    return ticks.groupBy("item").applyInPandas(fold, OUTPUT)


def _fold(key: tuple, rows: pd.DataFrame, before: tuple | None, th: Thresholds, expected_hits: float) -> tuple[pd.DataFrame, tuple]:
    """Advance a workload's state over its ticks: the output rows and the new state."""
    p = Policy(*before) if before else Policy()
    out = []
    for t in rows.sort_values("tick").itertuples():
        switched = p.tick(int(t.items), int(t.moves), int(t.queries), expected_hits, th)
        out.append((key[0], t.tick, t.items, p.queries, p.moves, p.still, p.backend, switched, p.near_misses))
    return pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")]), astuple(p)


def crossing_counts(positions: DataFrame, points: PointFrame, levels: int, every: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(window, cell, n): visits of cells by event-time window; rows later than `late` are dropped."""
    keyed = positions.withColumn("cell", points.using(positions).cell_key(levels)).withWatermark(time, late)
    return keyed.groupBy(F.window(time, every), "cell").agg(F.count("*").alias("n"))
