"""A cleaning pipeline over ``documents``: quality rules, near and substring deduplication, decontamination, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontaminate import drop_contaminated
from corpusloom.llm.near_dedup import keep_first
from corpusloom.llm.quality_rules import fit_ngram_model, keep_quality
from corpusloom.llm.sentence_pieces import encode_with_digests
from corpusloom.llm.substring_dedup import remove_repeats
from corpusloom.session import materialize, ship_package

NEAR_PERCENT = 85
"""Similarity of near duplicates. Stages on word shingles need 80 or more; this stage's test fixes 85."""


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the model reject; the model is fitted to the labelled rows of the input tables."""
    ship_package(spark)
    labelled, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return keep_quality(docs, fit_ngram_model(labelled, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates."""
    ship_package(spark)
    return keep_first(docs, percent=NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; ``n_chars`` follows the text."""
    ship_package(spark)
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark."""
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with hashes of them and of the text that they decode to."""
    ship_package(spark)
    return encode_with_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("sentence_pieces", sentence_pieces),
]

# The first stage's model has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
