"""The corpus pipeline: quality, language, near-duplicates, benchmark passages, packing, over the table `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents. No stage
changes the session. run() writes each stage's result as Parquet in the shared folder and removes what came before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, language, neardup, packing, quality, scratch
from sluice.llm._common import drop, free_name, read, scratch_path, staged

#: A document of several languages is kept from this share of letters in its main one.
LANGUAGE_SHARE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores at its threshold or above."""
    model = quality.train(docs.where(quality.learnable()), read(spark, sf_dir, "labels").where(quality.learnable()))
    mark = free_name(docs, "score")
    return docs.withColumn(mark, quality.score(F.col("text"), model)).where(F.col(mark) >= quality.THRESHOLD).drop(mark)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that has at least LANGUAGE_SHARE of their letters."""
    model = language.train(docs.where(language.learnable()))
    mark = free_name(docs, "language")
    found = docs.withColumn(mark, language.identify(F.col("text"), model))
    return found.where((F.col(mark)["lang"] != language.UNKNOWN) & (F.col(mark)["score"] >= LANGUAGE_SHARE)).drop(mark)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, with_ids=False)


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", keep_distinct), ("decontamination", keep_clean), ("packing", pack)]
#: Models, samplings and tokens are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, read from its table in the shared folder, the only one that stays."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark, f"stage-{name}"):
            docs = staged(stage(spark, docs, sf_dir), name, at)
        if last is not None:
            drop(last)
        last = docs
    return docs
