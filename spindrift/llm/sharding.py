"""Sharding by sampled splitters.

A size-weighted sample of bounded expected size gives quantile boundaries of
the sort key (hash of the text, then the id), records are range-partitioned by
them, ranges that hold far more than their share are subdivided by the id, and
a running sum over the ordered ranges cuts the sequence into shards of nearly
equal bytes.  Equal texts are neighbours in the key, so a group of copies stays
together unless it crosses a cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _range_of(key, bounds: list[int]):
    """Index of a key among sorted bounds, by a fixed tree of comparisons (depth log2)."""
    def pick(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds)) if bounds else F.lit(0)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2_000_000, overfull: float = 2.0) -> DataFrame:
    """One row per record under the law ``bytes``: every shard holds total / shards
    bytes give or take one record.

    Defined cases: a null text has size 1 and the crc32 of the empty text; a
    null id sorts first, but for overfull ranges, where null ids are dealt out;
    repeated rows and ties are records of their own, in an arbitrary but gapless
    order; a record larger than a shard's share fills one by itself; texts are
    never cut; an empty table gives no row; other columns of the input are not
    read.  ``grown_shard`` belongs to the law ``key`` and is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    ))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = int(min(1024, max(64, count // rows_per_range)))  # fuller ones are subdivided below, whatever their number of rows
    sample_rows = 128 * ranges
    # Size-weighted draw: a record of share s is taken with chance s * sample_rows.
    # Repeated rows are one draw of their joint size, so the sample is bounded whatever repeats.
    u = (F.pmod(F.xxhash64("doc_id", "key", F.lit(17)), F.lit(1 << 30)) / float(1 << 30))
    drawn = rows.groupBy("key", "doc_id").agg(F.sum("size").alias("size")).where(u < F.col("size") * (sample_rows / max(total, 1))).select("key", "doc_id", "size")
    sample = sorted(((r[0], r[1] if r[1] is not None else -1, r[2]) for r in drawn.collect()))
    bounds: list[int] = []
    if sample:
        # A record larger than total / sample_rows is drawn for certain, so it counts by its size.
        weight = np.cumsum(np.maximum([s for _, _, s in sample], total / sample_rows))
        at = np.searchsorted(weight, np.arange(1, ranges) * weight[-1] / ranges)
        picked = [sample[min(int(i), len(sample) - 1)][0] for i in at]
        # A key picked twice fills ranges alone: it gets a range of its own, to be subdivided.
        bounds = sorted({*picked, *(k + 1 for k in picked if picked.count(k) > 1)})
    placed = rows.withColumn("range", _range_of(F.col("key"), bounds).cast("int"))
    # Ranges over their share are subdivided by id: a group of copies has one key but many ids.
    load = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    parts, low, width, salted = F.lit(1), F.lit(0), F.lit(1.0), F.lit(False)
    for r in load:
        k = int(max(np.ceil(r.b * ranges / max(total, 1)), np.ceil(r.n / rows_per_range)))
        if r.n > 1 and (r.b > overfull * total / ranges or r.n > overfull * rows_per_range):
            here, by_id = F.col("range") == r.range, r.hi is not None and r.hi > r.lo
            parts, salted = F.when(here, k).otherwise(parts), F.when(here, not by_id).otherwise(salted)
            if by_id:
                low, width = F.when(here, F.lit(r.lo)).otherwise(low), F.when(here, F.lit((r.hi - r.lo + 1) / k)).otherwise(width)
    # Within an overfull range the sub-range by id is the major key; rows of one id, or of none, are dealt out.
    by_row = F.floor(F.rand(29) * parts)
    within = F.when(salted | F.col("doc_id").isNull(), by_row).otherwise(F.floor((F.col("doc_id") - low) / width))
    sub = F.when(parts > 1, F.least(parts - 1, within).cast("int")).otherwise(F.lit(0))
    placed = cut(placed.withColumn("sub", F.greatest(sub, F.lit(0)).cast("int")))
    sums = placed.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("range", "sub").collect()
    bytes_before, rows_before, seen_b, seen_n = [], [], 0, 0
    for r in sums:
        bytes_before.append((r["range"], r["sub"], seen_b, seen_n))
        seen_b, seen_n = seen_b + r.b, seen_n + r.n
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(bytes_before or [(0, 0, 0, 0)], "range int, sub int, b0 long, n0 long"))  # at most ranges * ranges rows
    w = Window.partitionBy("range", "sub").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offsets, ["range", "sub"]).select(
        "doc_id", "size", "text_crc32",
        (F.sum("size").over(w) + F.col("b0")).alias("upto"),
        (F.count("*").over(w) - 1 + F.col("n0")).alias("rank"),
    )
    middle = F.col("upto") * 2 - F.col("size")
    ranked = cut(ranked.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2.0 * max(total, 1)))).cast("int")))
    firsts = F.broadcast(ranked.groupBy("shard").agg(F.min("rank").alias("r0")))  # one row per shard
    return ranked.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("r0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
