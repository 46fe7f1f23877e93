"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, lines, neighbours, packing, quality, simhash, unigram, urls



def vocabulary(name: str) -> str:
    """A vocabulary file of the public tokenizers, from the folder that SPARKWARD_TOKENIZERS names or the installed package."""
    folder = os.environ.get("SPARKWARD_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoding_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.render(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_neighbours, op2_simhash, op3_quality, op4_packing, op5_lines, op6_urls, op7_token_counts, op8_licenses, op9_sentencepiece, op10_chat,
)}
ORACLES: dict[str, str] = {"op5_lines": lines.ORACLE, "op10_chat": chat.ORACLE}
