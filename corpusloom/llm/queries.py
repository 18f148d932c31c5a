"""One query for each operator of this package, over the whole table that it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.byte_network import fit_network, score_quality
from corpusloom.llm.decontaminate import contamination_digests
from corpusloom.llm.fill_in_middle import middle_digests
from corpusloom.llm.filter_audit import audit_quality_filters
from corpusloom.llm.fingerprints import fingerprint_digests
from corpusloom.llm.line_blocks import extract_main_text
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.quality_rules import fit_ngram_model, judge_quality
from corpusloom.llm.quote_links import thread_messages, with_quotes
from corpusloom.llm.sentence_pieces import piece_digests
from corpusloom.llm.substring_dedup import repeat_digests
from corpusloom.llm.token_files import token_positions, write_token_files
from corpusloom.llm.url_rules import ALLOW, BLOCK, judge_urls, rule_table
from corpusloom.session import materialize, scratch_path

URL_RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread_messages(materialize(with_quotes(_table(spark, sf_dir, "conversations")), "messages"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return judge_quality(documents, fit_ngram_model(documents, _table(spark, sf_dir, "labels")))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), target)
    return token_positions(spark, target)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(_table(spark, sf_dir, "documents"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_quality(documents, fit_network(documents, _table(spark, sf_dir, "labels")))


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_digests(_table(spark, sf_dir, "documents"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(_table(spark, sf_dir, "documents"))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_quality_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": near_dedup,
    "op2_url_rules": url_rules,
    "op3_decontaminate": decontaminate,
    "op4_quote_links": quote_links,
    "op5_quality_rules": quality_rules,
    "op6_token_files": token_files,
    "op7_substring_dedup": substring_dedup,
    "op8_line_blocks": line_blocks,
    "op9_byte_network": byte_network,
    "op10_sentence_pieces": sentence_pieces,
    "op11_fingerprints": fingerprints,
    "op12_fill_in_middle": fill_in_middle,
    "op13_filter_audit": filter_audit,
}
