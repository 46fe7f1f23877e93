"""The corpus pipeline: documents through four stages of sparkward.llm, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkward.llm import lines, packing, quality, registry, simhash
from sparkward.plans.shared import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from every text."""
    return lines.without_boilerplate(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of token sequences."""
    return packing.pack(docs, registry.vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("line dedup", cut_boilerplate), ("near-dedup", keep_one), ("packing", pack)]
#: The model of the first stage and the tokenizer of the last can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole of what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
