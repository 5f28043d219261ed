"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import bpe, covertree, langid, lines, minhash, packing, records, repetition, secrets, wrappers
from tarnwork.llm.common import table


def tokenizer_path(name: str) -> str:
    """Of a vocabulary file; TARNWORK_TOKENIZERS names another folder."""
    if folder := os.environ.get("TARNWORK_TOKENIZERS"):
        return os.path.join(folder, name)
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_apart(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern())


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_spread_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_removed")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read(records.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_wrappers": op3_html_wrappers,
    "op4_quality_rules": op4_quality_rules,
    "op5_superminhash": op5_superminhash,
    "op6_language_id": op6_language_id,
    "op7_cover_tree": op7_cover_tree,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_records": op9_token_records,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES = {"op8_line_dedup": lines.ORACLE}
