"""Line dedup by winnowing, in DataFrame functions only.

Lines are hashed; every window of `run` consecutive lines selects its least
hash as a fingerprint, so two equal runs of that length share one at the same
place.  Fingerprint positions, with the hashes of the lines around them, are
joined with the first position of the same fingerprint in the same window; each
match is extended both ways, line by line, as far as the surroundings agree
(neighbouring fingerprints are at most `run` lines apart, so extensions meet),
and the lines of the later run are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: At most so many groups of positions are broadcast: those that hold more than this share of all positions.
HOT_GROUPS = 10_000


def _positions(docs: DataFrame, run: int, words: int = 0) -> DataFrame:
    """(doc_id, at, off, around): the fingerprint of each window of `run` lines that holds `words` words.

    `at` is the line selected (the rightmost least one), `off` its place in the
    window, `around` the hashes of the lines from at - run to at + run, null
    where the document ends.
    """
    lines = F.split("text", "\n")
    columns = {"h": F.transform(lines, lambda x: F.xxhash64(x))}
    if words:
        columns["c"] = F.transform(lines, lambda x: F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda y: y != "")))
    hashed = docs.where("doc_id is not null and text is not null").select("doc_id", *(x.alias(name) for name, x in columns.items())).where(F.size("h") >= run)
    n, edge = F.size("h"), F.array_repeat(F.lit(None).cast("bigint"), run)
    # One row by window: the lines from `run` before it to `run` after it.
    wide = F.concat(edge, "h", edge)
    slots = [*(F.slice(wide, k + 1, n - (run - 1)).alias(f"x{k}") for k in range(3 * run)), *(F.slice("c", k + 1, n - (run - 1)).alias(f"c{k}") for k in range(run) if words)]
    w = hashed.select("doc_id", F.inline(F.arrays_zip(F.sequence(F.lit(0), n - run).alias("s"), *slots)))
    if words:
        w = w.where(reduce(lambda a, b: a + b, (F.col(f"c{k}") for k in range(run))) >= words)
    own = [F.col(f"x{run + k}") for k in range(run)]
    least = F.least(*own) if run > 1 else own[0]
    off = reduce(lambda rest, k: F.when(own[k] == least, F.lit(k)).otherwise(rest), range(run), F.lit(0))
    w = w.withColumn("off", off)
    around = F.array(*(F.element_at(F.array(*(F.col(f"x{j}") for j in range(k, k + run))), F.col("off") + 1) for k in range(2 * run + 1)))
    return w.select("doc_id", (F.col("s") + F.col("off")).alias("at"), "off", around.alias("around"))


def _window(run: int) -> list[Column]:
    """The window that selected the position: the fingerprint and its place are part of it."""
    return [F.element_at("around", F.lit(run + 1) - F.col("off") + k).alias(f"k{k}") for k in range(run)]


def _extended(run: int) -> Column:
    """How many lines from the position on agree with the match, to the left and to the right."""
    def reach(step: int) -> Column:
        same = [F.get(F.col("around"), run + step * k).eqNullSafe(F.get(F.col("first.around"), run + step * k)) & F.get(F.col("around"), run + step * k).isNotNull() for k in range(1, run + 1)]
        far = F.lit(run)
        for k in range(run, 0, -1):
            far = F.when(~same[k - 1], F.lit(k - 1)).otherwise(far)
        return far

    return F.struct(reach(-1).alias("left"), reach(1).alias("right"))


def _hits(positions: DataFrame, run: int) -> DataFrame:
    """(doc_id, line): lines of the runs that occur earlier, found from the fingerprint positions."""
    keys = [f"k{k}" for k in range(run)]
    placed = positions.select("doc_id", "at", "off", "around", *_window(run))
    # The first position of every group; partial minima leave the map side, so no group is crowded.
    first = placed.groupBy("off", *keys).agg(F.min(F.struct("doc_id", "at", "around")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first)
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_GROUPS > total
    on = ["off", *keys]
    # At most HOT_GROUPS groups hold that share each: they are broadcast, and no task takes all of such a group.
    crowded = placed.join(F.broadcast(first.where(hot).drop("n")), on)
    rest = placed.join(F.broadcast(first.where(hot).select(*on)), on, "left_anti").join(first.where(~hot).drop("n"), on)
    later = crowded.unionByName(rest).where(F.struct("doc_id", "at") > F.struct("first.doc_id", "first.at"))
    runs = later.select("doc_id", "at", _extended(run).alias("e")).where(F.col("e.left") + 1 + F.col("e.right") >= run)
    # Positions of one run overlap: each line once a group of them.
    return runs.groupBy("doc_id", "at").agg(F.max("e.left").alias("l"), F.max("e.right").alias("r")).select("doc_id", F.explode(F.sequence(F.col("at") - F.col("l"), F.col("at") + F.col("r"))).alias("line"))


def later_lines(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc_id, gone): sorted positions of the lines that repeat an earlier run."""
    hit = _hits(cut(_positions(docs, run)), run)
    for short in range(1, run) if words is not None else ():
        hit = hit.unionByName(_hits(cut(_positions(docs, short, words)), short))
    # Bounded by the lines of one document.
    return hit.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, words: int | None = None) -> DataFrame:
    """docs with later repeated runs of `run` or more lines deleted, and the
    columns n_lines and n_removed.  With `words`, a run of fewer lines counts
    too if it holds that many words; the first place of every line stays.

    Order is by id, then line; a run may repeat within a document.  Defined
    cases: a null text stays null and has no line; an empty text is one empty
    line; fewer lines than `run` lose nothing; rows that repeat an id are one
    document and do not count against each other (if their texts differ, the
    line numbers found in any of them go from all); of equal runs the one of
    the least id and line stays, so ties cannot occur; a null id is left alone;
    very long texts are exploded to lines, never cut; an empty table gives no
    row; a column named n_lines or n_removed is replaced, other columns may
    have any name.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    taken = {*kept_columns, "n_lines", "n_removed"}
    doc, gone_name, lines_name = free_name("doc", taken), free_name("gone", taken), free_name("lines", taken)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Line numbers alone outlive the search: the result does not hold on to its shuffles.
    gone = cut(later_lines(slim, run, words)).withColumnsRenamed({"doc_id": doc, "gone": gone_name})
    joined = docs.select(*(F.col(f"`{c}`") for c in kept_columns)).join(gone, F.col(id_col).cast("long") == F.col(doc), "left")
    lines = F.split(F.col(text_col), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_name))
    text = F.when(F.col(gone_name).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col(lines_name), i)), "\n"))
    return joined.withColumn(lines_name, lines).select(
        *(text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in kept_columns),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines_name)).cast("long").alias("n_lines"),
        F.when(F.col(text_col).isNull() | F.col(gone_name).isNull(), 0).otherwise(F.size(gone_name)).cast("long").alias("n_removed"),
    )


def line_digest(docs: DataFrame, run: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256) of every row."""
    out = dedup_lines(docs.select("doc_id", "text"), run=run)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def oracle(run: int = 3) -> str:
    """The same result in DuckDB SQL, without hashes or fingerprints."""
    keys = ", ".join(f"w{k}" for k in range(run))
    leads = ", ".join(f"lead(line, {k}) over (partition by doc_id order by i) as w{k}" for k in range(run))
    return f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
  from documents where text is not null and doc_id is not null),
win as (select * from (select doc_id, i, {leads} from lines) where w{run - 1} is not null),
ranked as (select doc_id, i, row_number() over (partition by {keys} order by doc_id, i) as r from win),
gone as (select distinct doc_id, i + k as i from ranked, (select unnest(range({run})) as k) where r > 1),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) filter (where g.i is null) as text, count(*) as n_lines, count(g.i) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
  sha256(coalesce(k.text, '')) as text_sha256
from documents d left join kept k using (doc_id)"""
