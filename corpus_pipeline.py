"""From raw documents to packed training sequences.

Five stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontam, langid, linededup, ngramjoin, packing
from spindrift.llm.common import cut, release, rest_of, table
from spindrift.llm.queries import tokenizer_path

#: One shingle of the two stages after line dedup: shorter runs of one or two lines are trivial and stay.
RUN_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows taught; texts that are null, have no
    letter, or are long and no nearer to any learned language than chance go.
    """
    return langid.keep_told(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted; a document of which nothing is left goes.

    A run is three lines or more, or fewer that hold ``RUN_WORDS`` words.
    ``n_chars`` follows the text.
    """
    out = linededup.dedup_lines(docs, words=RUN_WORDS)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of similar documents stays.

    Documents that were similar before line dedup count too: what it leaves of
    a near copy no longer resembles the text that it was copied from.
    """
    release(spark)
    whole, ids = table(spark, sf_dir, "documents"), docs.select("doc_id").distinct()
    gone = cut(whole.select("doc_id").distinct().join(ids, "doc_id", "left_anti"))
    whole = rest_of(whole, gone, "doc_id")
    copies = cut(ngramjoin.shingle_components(whole).where("component_id <> doc_id").select("doc_id").distinct())
    del whole, ids, gone
    release(spark)  # what the first join wrote
    return ngramjoin.keep_one_of_each(rest_of(docs, copies, "doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    release(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenizer ids and hyperdimensional profiles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
