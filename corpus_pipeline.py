"""Corpus pipeline: quality rules, near copies, benchmark leaks, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet to the shared folder and read again as the next stage's ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumshift.llm import decontaminate, mixing, ngram_join, quality, token_files
from forumshift.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the quality rules (operator 9)."""
    model = quality.fit_line_model(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good_texts(docs, model)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 1)."""
    return ngram_join.drop_near_copies(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items (operator 7)."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 2)."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and every document's place and checksum read back from them (operator 6)."""
    files = token_files.write_token_files(docs, token_files.default_tokenizer())
    return token_files.read_documents(spark, files).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: the line field and the random mix have no SQL; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
