"""The corpus pipeline: documents go through STAGES in order, each written as Parquet and read again as the next one's input.

1. quality: rejected documents go. 2. lines: cross-site boilerplate lines go from every document but the first that has them.
3. near_duplicates: one document of each group of near copies stays. 4. secrets: spans become a mark. 5. packing: the rest is
packed into bins; this last stage returns a row for each piece. Stages 1 to 4 return the columns of documents.

Cases that every stage defines: a null or empty text has no words, so stage 1 rejects it; run alone, the other stages keep such a
row as it is, and stage 5 gives it no bin. A null source counts as one source of its own, a null lang or n_chars is passed on. Rows without an
id are kept by stage 2 as they are and packed like others. Repeated rows count as one document in stage 2. In stage 3, where ids are missing or
repeated, every row is a document of its own, and of a group of near copies one row stays, a missing id being the last. Very long texts are taken whole (stage 5 cuts them into pieces), ties go to the smallest id, an empty table gives an empty
one, and further columns pass through stages 1 to 4 whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import lines, minhash, packing, repetition, secrets
from tarnwork.llm.common import new_dir, remove, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_spread_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", boilerplate),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_spans),
    ("packing", pack),
]

#: Suffix arrays and best-fit packing have no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
