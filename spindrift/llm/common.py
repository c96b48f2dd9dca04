"""Shared plumbing of the training-data operators: tables, checkpoints, work sizes."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, for texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def free_name(name: str, taken) -> str:
    """A column name that no input column has, whatever the case of its letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this process keeps for an operator from task to task.

    Python workers serve the tasks of all operators of a session.  The operator
    that asks takes the place of the others: what they keep goes, and its memory
    returns to the system, so a worker holds the tables of one operator at most.
    """
    others = [k for k in _kept if k != owner]
    for k in others:
        del _kept[k]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)
    return _kept.setdefault(owner, {})


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` is used; only a session that
    names none (tests on one machine) gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Give back the shuffle files and checkpoints that no table refers to any more.

    Spark removes them when the driver's JVM collects what named them, which a
    job of many short steps may not see for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def groups_for(df: DataFrame, text: str, mb: float = 14.0, least: int = 8, most: int = 1 << 20) -> int:
    """How many memory-sized groups the words of a text column need: it grows with the input."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(min(most, max(least, round(total / (mb * 1e6)))))


#: Bits of the filter of ``may_hold``: at most 2**19 rows of 64 bits are broadcast, whatever the input.
FILTER_BITS = 1 << 25


def may_hold(df: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """df with a boolean column: whether its hash value `column` may be one of the keys'.

    One bit by hash value: where it is not set the value is no key's.  Rows can
    so be told apart where they are read, before any is shuffled.
    """
    at = F.pmod(column, F.lit(FILTER_BITS))
    word, bit, bits = (free_name(n, [*df.columns, name]) for n in ("word", "bit", "bits"))
    rows = keys.select((at / 64).cast("int").alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias(bit))
    words = F.broadcast(rows.groupBy(word).agg(F.bit_or(bit).alias(bits)))
    joined = df.withColumn(word, (at / 64).cast("int")).join(words, word, "left")
    mark = F.coalesce(F.call_function("getbit", F.col(bits), (at % 64).cast("int")) == 1, F.lit(False))
    return joined.withColumn(name, mark).select(*(F.col(f"`{c}`") for c in df.columns), name)


def apart(df: DataFrame, keys: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose values of the columns `on` are surely none of the keys', and the others (few more than match)."""
    maybe = free_name("maybe", df.columns)
    marked = may_hold(df, keys, F.xxhash64(*on), maybe)
    return marked.where(~F.col(maybe)).drop(maybe), marked.where(maybe).drop(maybe)


def rest_of(df: DataFrame, away: DataFrame, *on: str) -> DataFrame:
    """The rows of df whose values of the columns `on` are none of `away`'s; nulls are equal here.

    Only rows that ``apart`` cannot tell from those of `away` are shuffled: texts stay where they are read.
    """
    sure, maybe = apart(df, away, *on)
    names = {c: free_name(f"{c}_away", df.columns) for c in on}
    other = away.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return sure.unionByName(maybe.join(other, same, "left_anti"))


#: Groups that hold more than this share of the crowded rows are broadcast: fewer than so many can.
HOT_GROUPS = 10_000


def split_groups(df: DataFrame, keys: list[str], by: str, size: int, name: str) -> DataFrame:
    """df with `name`, the part of its group that a row falls in (by a hash of `by`), and `name`_parts.

    Groups of more than `size` rows have parts of about that size.  The largest
    groups are told by broadcast, so no task takes all rows of one.
    """
    many = free_name("many", df.columns)
    crowded = cut(df.groupBy(*keys).agg(F.count("*").alias(many)).where(F.col(many) > size))
    total = crowded.agg(F.sum(many)).first()[0]
    if total is None:
        return df.withColumns({name: F.lit(0), f"{name}_parts": F.lit(1)})
    hot = F.broadcast(crowded.where(F.col(many) * HOT_GROUPS > total))
    here = df.join(hot, keys).select(*df.columns, many)
    rest = df.join(hot.drop(many), keys, "left_anti").join(crowded.where(F.col(many) * HOT_GROUPS <= total), keys, "left").select(*df.columns, many)
    parts = F.ceil(F.coalesce(many, F.lit(1)) / size).cast("int")
    return here.unionByName(rest).withColumn(f"{name}_parts", parts).withColumn(name, F.pmod(F.xxhash64(by, F.lit(23)), F.col(f"{name}_parts")).cast("int")).drop(many)
