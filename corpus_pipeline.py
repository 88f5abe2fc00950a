"""The corpus pipeline: documents in, the words each kept document gives to the training mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, language, line_dedup, mixing, near_dedup
from cuesheet.session import bound_batches, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Documents whose language is less sure than this are rejected with those that have none.
SURE = 0.5


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; where ``lang`` is null the one found takes its place."""
    bound_batches(spark)
    model = language.learn(docs.select("doc_id", "text", "lang"))
    judged = language.predict(_columns(docs), model)
    sure = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return _columns(sure.withColumn("lang", F.coalesce("lang", "lang_pred")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines earlier ones have; emptied documents go."""
    bound_batches(spark)
    cut = line_dedup.drop_common_blocks(_columns(docs))
    left = cut.where("n_removed = 0 or length(trim(text)) > 0")
    return _columns(left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(_columns(docs))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no window of a benchmark item."""
    bound_batches(spark)
    return decontaminate.clean(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", remove_benchmarks),
    ("mix", mix),
]

# Learning a language model and aligning lines are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
