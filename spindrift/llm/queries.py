"""Queries of this subpackage: one opN_<name> by operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import ORACLES  # noqa: F401  (part of the registry)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nndescent import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import shingle_components

    return shingle_components(table(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "repeats")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (
    op1_nn_descent, op2_html_text, op3_ngram_join, op4_shards, op5_substrings, op6_decontamination, op7_secrets, op8_language, op9_line_dedup, op10_packing,
)}
