"""The corpus queries against brute-force SQL, on the whole small tables."""

import duckdb
import pytest

from spindrift.llm import queries

TABLES = ("documents", "embeddings", "benchmark")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert sorted(map(tuple, ours[columns].values.tolist()), key=repr) == sorted(map(tuple, theirs[columns].values.tolist()), key=repr)
