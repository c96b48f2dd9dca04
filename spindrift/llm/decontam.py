"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. Every whole text is read word by word.  A window as long as some item is a
   candidate if so many of its shingles occur in items of that length, in
   whichever of them, that the similarity can be reached; of all others it is
   proven that it cannot.
2. Equal candidate windows are one; each gets a 64-bit SimHash of its words.
3. Items are indexed by the values of BLOCKS blocks of their fingerprint, with
   up to ITEM_FLIPS bits of a block flipped; windows probe with up to
   WINDOW_FLIPS bits flipped.  Fingerprints that differ by at most `radius` bits
   differ by at most radius // BLOCKS in some block, so all of them meet.
4. Exact weighted-shingle similarity decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Item shingles, and index rows, up to this many are broadcast (about 50 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
BLOCKS, WIDTH = 4, 16
ITEM_FLIPS, WINDOW_FLIPS = 3, 1
#: Widest radius that four blocks with so many flips guarantee: 4 * (3 + 1) + 3.
RADIUS = BLOCKS * (ITEM_FLIPS + WINDOW_FLIPS) + BLOCKS - 1


def words_column(text: Column) -> Column:
    """Lower-case words, split at ASCII white space; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")


def _gram(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(k)))


def _grams(w: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; empty when there are fewer words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: _gram(w, i, k))).otherwise(F.array().cast("array<bigint>"))


def simhash(w: Column) -> Column:
    """64-bit SimHash of an array of words."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def flips(most: int) -> list[int]:
    """Block masks of at most so many bits."""
    return [sum(1 << b for b in some) for m in range(most + 1) for some in combinations(range(WIDTH), m)]


def _keys(sim: Column, most: int) -> Column:
    """Index keys of a fingerprint: block number above block value, with up to `most` bits flipped."""
    masks = F.array(*(F.lit(m) for m in flips(most)))
    blocks = [F.shiftrightunsigned(sim, WIDTH * b).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").bitwiseOR(F.lit(b << WIDTH)) for b in range(BLOCKS)]
    return F.flatten(F.array(*(F.transform(masks, lambda m, x=x: x.bitwiseXOR(m)) for x in blocks)))


def _shingles(w: str, most: int) -> Column:
    """Sorted hashes of the k-word shingles of a words column; a shorter text is one shingle."""
    out = F.lit(None)
    for g in range(1, most + 1):
        out = F.when(F.col("k") == g, F.when(F.size(w) >= g, _grams(F.col(w), g)).otherwise(F.array(F.xxhash64(F.col(w))))).otherwise(out)
    return F.sort_array(out)


def _weighted(grams: str) -> Column:
    """The sorted multiset of a column as a set: (shingle, how many of it came before)."""
    return F.transform(F.col(grams), lambda x, i: F.struct(x.alias("x"), (i + 1 - F.array_position(F.col(grams), x)).alias("n")))


#: Buckets of row hashes by which texts are told apart where they are read, before any is shuffled.
BUCKETS = 1 << 20
NO_ID = -(1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(did, row, text, ...): did and row tell rows apart by id, null ids included, and text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("did"), F.xxhash64(doc_id.isNull(), text).alias("row"), text.alias("text"), *more)


def _candidates(rows: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """(did, row, n, start): windows that the shingles of all items of their size allow, for items of k-word shingles.

    A window of n words has m = n - k + 1 shingles (a shorter text has fewer);
    with `need` of them in items of n words, one is among its first m - need + 1,
    and the need-th of them from there lies in the window too.
    """
    keys = items.select("n", F.explode(_grams(F.col("iw"), k)).alias("gram")).distinct()
    if items.agg(F.sum("n")).first()[0] <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    worded = rows.select("did", "row", words_column(F.col("text")).alias("w")).where(F.size("w") >= k)
    grams = worded.select("did", "row", F.size("w").alias("size"), F.posexplode(_grams(F.col("w"), k)).alias("pos", "gram"))
    # Positions of one document, ascending: bounded by its words.
    sized = grams.join(keys, "gram").groupBy("did", "row", "size", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # An item longer than the text is compared with all of it.
    sized = sized.withColumn("m", F.least("n", "size") - (k - 1))
    need = F.ceil((F.col("m") + F.col("n") - (k - 1)) * similarity / (1 + similarity) - 1e-9).cast("int")
    sized = sized.withColumn("need", need).where((F.col("need") <= F.size("at")) & (F.col("need") <= F.col("m")))

    def span(j: Column) -> Column:
        first, last = F.get("at", j), F.get("at", j + F.col("need") - 1)
        low = F.greatest(F.lit(0), first - (F.col("m") - F.col("need")), F.coalesce(F.get("at", j - 1) + 1, F.lit(0)), last - F.col("m") + 1)
        return F.struct(low.alias("a"), F.least(first, F.col("size") - F.col("m") - (k - 1)).alias("z"))

    spans = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), span)
    spans = sized.select("did", "row", "n", F.explode(F.filter(spans, lambda x: x.a <= x.z)).alias("x"))
    return spans.select("did", "row", "n", F.explode(F.sequence("x.a", "x.z")).alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, similarity: float = 0.75, radius: int = RADIUS, keep_row: bool = False) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of each
    document for each item it resembles; the first of equals.

    Similarity is the weighted Jaccard of k-word shingles, weighted by their
    counts (an item of fewer words is one shingle).  Defined cases: null and
    wordless texts and items match nothing; null ids are kept in the result;
    repeated rows and items give one row, and so do rows of one id with
    different texts (the best of all their windows); a document shorter than an
    item is compared whole; texts of any length are read whole; empty tables
    give no row; other columns are not read.  With `keep_row` the result is
    (did, row) alone, the texts that hold an item (see ``drop_contaminated``).
    """
    spark = docs.sparkSession
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the index guarantees radii up to {RADIUS}")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(NO_ID)).alias("item_id"), words_column(F.col(item_text_col)).alias("iw")).where(F.size("iw") > 0).distinct()
    items = cut(items.withColumn("n", F.size("iw")).withColumn("k", F.least(F.lit(k), F.col("n"))).withColumn("isim", simhash(F.col("iw"))).withColumn("ig", _shingles("iw", k)))
    rows = _rows(docs, id_col, text_col)
    spots = None
    for g in sorted(r.k for r in items.select("k").distinct().collect()):  # at most k values
        own = _candidates(rows, items.where(F.col("k") == g), g, similarity).withColumn("k", F.lit(g))
        spots = own if spots is None else spots.unionByName(own)
    if spots is None:
        return spark.createDataFrame([], "did long, row long" if keep_row else "doc_id long, item_id long, start int, n_words int, similarity double")
    spots = cut(spots)
    # Positions alone were carried so far; only texts with a candidate give their words.
    named = spots.select("did", "row").distinct()
    bucket = F.pmod("row", F.lit(BUCKETS))
    near_rows = rows.withColumn("bucket", bucket).join(F.broadcast(named.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")  # at most BUCKETS rows
    some = cut(near_rows.join(named, ["did", "row"], "left_semi").dropDuplicates(["did", "row"]).select("did", "row", words_column(F.col("text")).alias("w")))
    placed = spots.join(some, ["did", "row"]).withColumn("v", F.slice("w", F.col("start") + 1, F.col("n")))
    placed = placed.select("did", "row", "start", "k", F.size("v").alias("m"), F.md5(F.concat_ws(" ", "v")).alias("key"), "v")
    windows = placed.groupBy("key", "k").agg(F.first("v").alias("v"))  # one of each text
    windows = cut(windows.select("key", "k", simhash(F.col("v")).alias("sim"), _shingles("v", k).alias("g")))
    index = items.select("item_id", "k", "isim", F.explode(_keys(F.col("isim"), ITEM_FLIPS)).alias("b"))
    if items.count() * BLOCKS * len(flips(ITEM_FLIPS)) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    probes = windows.select("key", "k", "sim", F.explode(_keys(F.col("sim"), WINDOW_FLIPS)).alias("b"))
    near = probes.join(index, ["k", "b"]).where(F.bit_count(F.col("sim").bitwiseXOR(F.col("isim"))) <= radius)
    # A pair meets in several blocks; it is verified once.
    near = near.select("key", "k", "item_id", "isim").distinct().join(windows.select("key", "k", "g"), ["key", "k"]).join(items.select("item_id", "k", "isim", "ig"), ["item_id", "k", "isim"])
    near = near.select("key", "k", "item_id", _weighted("g").alias("a"), _weighted("ig").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    scored = near.withColumn("similarity", both / (F.size("a") + F.size("b") - both)).where(F.col("similarity") >= similarity)
    scored = cut(scored.groupBy("key", "k", "item_id").agg(F.max("similarity").alias("similarity")))
    found = placed.drop("v").join(scored, ["key", "k"])
    if keep_row:
        return found.select("did", "row").distinct()
    best = found.groupBy("did", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start", F.col("m").alias("n_words"))).alias("m"))
    return best.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), F.when(F.col("item_id") != NO_ID, F.col("item_id")).alias("item_id"), F.col("m.start").alias("start"), F.col("m.n_words").alias("n_words"), (-F.col("m.less")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; null ids and rows that
    repeat an id are judged by their own text.  Cases as in ``contaminated``."""
    did, row = free_name("did", docs.columns), free_name("row", docs.columns)
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, keep_row=True, **options).withColumnsRenamed({"did": did, "row": row})
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keyed = docs.withColumns({did: F.coalesce(doc_id, F.lit(NO_ID)), row: F.xxhash64(doc_id.isNull(), text)})
    return keyed.join(found, [did, row], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
