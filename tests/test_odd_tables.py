"""Queries against their SQL on small tables with rows that the given tables at sf0.001 lack."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest

from spindrift import registry
from spindrift.operators import kernel, rasters

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PARTS = "p_partkey long, p_size int, p_retailprice double"


def both(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    ours = registry.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(sorted(ours.columns))
    theirs = con.execute(f"select {columns} from ({registry.ORACLES[name]})").fetchall()
    return sorted((tuple(r) for r in ours.select(*sorted(ours.columns)).collect()), key=repr), sorted(theirs, key=repr)


@pytest.mark.parametrize("name", ["morton3", "demorton3", "hilbert3"])
def test_keys_of_rows_outside_the_world(spark, tmp_path, name):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, at(h), u, "view", x, None) for i, (h, u, x) in enumerate([(5.5, 3, 7.0), (5.5, 256, 7.0), (700.25, 1499, 511.99), (1024, 90_000, 100.5), (30_000.5, 9_000_000, 0.0), (3, -1, 9.0), (-20.5, 10, 8.0), (1, None, 8.0), (1, 2, None), (1, 2, 512.0), (1, 2, -0.5)])]
    rows.append((99, None, 5, "view", 3.0, None))
    ours, theirs = both(spark, tmp_path, name, "events", rows, EVENTS)
    assert ours == theirs and len(ours) == 9


def test_figure_holds_the_chord_of_its_arcs(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, "view", x, None) for i, (x, h) in enumerate([(60.0, 333.5), (60.0, 300.0), (60.0, 341.0), (60.0, 259.0), (100.0, 570.0), (129.0, 570.0), (131.0, 570.0), (71.0, 570.0), (59.0, 300.0), (61.0, 300.0)])]
    ours, theirs = both(spark, tmp_path, "figure_attack", "events", rows, EVENTS)
    assert ours == theirs
    # Either turn, and chords of any direction.
    for turn in (1, -1):
        for degrees in (0, 30, 45, 90, 135, 180, 211, 270, 300):
            ring = rasters.placed([(0, -4, 0, 0, turn), (0, 4, 0, 0, turn)], 1.0, degrees, 3.0, -2.0)
            t = np.linspace(-5, 5, 101)
            a = np.radians(degrees)
            x, y = 3 - np.sin(a) * t, -2 + np.cos(a) * t
            assert (rasters.inside(ring, x, y) == (np.abs(t) < 4 + 1e-9)).all()


@pytest.mark.parametrize("copies", [1, 3, 9])
def test_sixth_neighbour_where_points_share_places(spark, tmp_path, copies):
    rng = random.Random(copies)
    rows = [(i, rng.randint(1, 9), 900 + rng.randint(0, 9) / 10) for i in range(40)]
    rows = [(i + 100 * c, s, p) for c in range(copies) for i, s, p in rows]
    ours, theirs = both(spark, tmp_path, "knn_self_density", "part", rows, PARTS)
    assert ours == theirs and len(ours) == 40 * copies


@pytest.mark.parametrize("rows", [[(1, 4, 900.0)], [(1, 4, 900.0), (2, 4, 900.0)], [(1, 4, 900.0), (2, 4, 901.0), (3, 5, 901.0)], [(1, 4, 900.0), (1, 5, 900.5), (2, 7, 950.0), (3, 4, 900.0)]])
def test_sixth_neighbour_of_few_points(spark, tmp_path, rows):
    ours, theirs = both(spark, tmp_path, "knn_self_density", "part", rows, PARTS)
    assert ours == theirs


def test_density_in_blocks(spark, tmp_path, monkeypatch):
    """Places shared, dense cells over several blocks, neighbours at exactly the reach."""
    monkeypatch.setattr(kernel, "PAIRS", 64)
    rng = random.Random(3)
    spots = [(rng.randint(0, 60) / 2, rng.randint(0, 60) / 2) for _ in range(150)] * 2 + [(100.0, 100.0), (108.0, 100.0), (100.0, 108.0), (300.0, 5000.0)]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, "view", x, None) for i, (x, h) in enumerate(spots)]
    ours, theirs = both(spark, tmp_path, "sph_density", "events", rows, EVENTS)
    assert ours == theirs and len(ours) == len(spots)
