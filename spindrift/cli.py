"""Command line: ``spark-submit spindrift/cli.py ...`` or ``python -m spindrift.cli ...``.

query NAME --data DIR [--out DIR]   run a registered query, show or write it
explain NAME --data DIR             its physical plan
compare NAME... --data DIR          its oracle in DuckDB beside it
generate --out DIR                  a bank of rasters
fingerprint                         the rasters of a small bank as text
calibrate --data DIR                time the nested loop against the cell join
"""

from __future__ import annotations

import argparse
import glob
import json
import platform
import time

from pyspark.sql import SparkSession


def _calibrate(spark: SparkSession, data: str) -> dict:
    from .catalog.base import circles
    from .operators import cull
    from .sources import points

    p, rows = points.events(spark, data), []
    n = p.df.count()
    for queries in (16, 256, 4096):
        took = {}
        for strategy in ("nested", "cells"):
            began = time.perf_counter()
            cull.cull_many(p, cull.balls(circles(spark, queries)), cell=16.0, strategy=strategy).write.format("noop").mode("overwrite").save()
            took[strategy] = round(time.perf_counter() - began, 3)
        rows.append({"points": n, "queries": queries, **took})
    return {"machine": f"{platform.system()}/{platform.machine()} {spark.sparkContext.defaultParallelism} tasks", "runs": rows}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("query", "explain", "compare", "generate", "fingerprint", "calibrate"))
    parser.add_argument("names", nargs="*")
    parser.add_argument("--data", default="/root/testdata/sf0.01")
    parser.add_argument("--out")
    a = parser.parse_args(argv)
    from . import registry
    from .operators import rasters

    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    if a.command in ("query", "explain"):
        df = registry.QUERIES[a.names[0]](spark, a.data)
        if a.command == "explain":
            df.explain("formatted")
        elif a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(truncate=False)
    elif a.command == "compare":
        import duckdb

        con = duckdb.connect()
        for path in glob.glob(f"{a.data}/*.parquet"):
            con.sql(f"create view {path.rsplit('/', 1)[1].removesuffix('.parquet')} as select * from '{path}'")
        for name in a.names or sorted(registry.ORACLES):
            print(name, registry.QUERIES[name](spark, a.data).count(), len(con.sql(registry.ORACLES[name]).fetchall()))
    elif a.command == "generate":
        tasks = rasters.subtasks(spark, sorted(rasters.FIGURES), [16.0, 32.0], [1, 2, 4, 8], 15.0)
        rasters.unique(rasters.bank(tasks)).write.mode("overwrite").parquet(a.out)
    elif a.command == "fingerprint":
        for r in registry.QUERIES["template_fingerprint"](spark, a.data).orderBy("figure", "angle", "cell", "dx", "dy").toLocalIterator():
            print(*r)
    else:
        print(json.dumps(_calibrate(spark, a.data)))


if __name__ == "__main__":
    main()
