"""The training-data pipeline over documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is
written as Parquet and read again before the next. All but the last return the
columns of documents. Substring dedup keeps every row: a text that loses words
becomes its kept words joined by one space, and n_chars follows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import bpe, common, decontaminate, near_dedup, quality_rules, substring_dedup
from gavel.llm.queries import ranks_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns unchanged.

    A null or empty text goes (it has fewer than ten words), so does any other that fails; of equal rows all stay or go; a null doc_id or source is no matter, a null lang is compared with all languages together; an empty table gives none.
    """
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id, all columns unchanged.

    Texts without words and rows without doc_id stay; rows that repeat a doc_id stay or go together; an empty table gives none.
    """
    (gone,) = common.fresh(docs, "gone")
    # written down, so that the join with the texts knows how small it is
    dropped = common.cut(near_dedup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that begin in an earlier document too; n_chars, if there, follows the text, other columns are unchanged.

    Null and short texts and rows without doc_id stay as they are; a text that goes whole becomes empty and its row stays; an empty table gives none.
    """
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns unchanged.

    Null and empty texts hold none and stay; each of equal rows is judged alike; an empty table gives none.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids: doc_id, lang, source, n_tokens and ids, a row for each document.

    A null or empty text has no ids; nulls in other columns stay; other columns are left out; an empty table gives none.
    """
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks_path(), offsets=None)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near-dedup", near_duplicates), ("substring dedup", substrings), ("decontamination", decontamination), ("byte BPE", encoding)]

#: SQL can express neither the encoding nor the latent retrieval; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with common.scratch(), common.released_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
