"""Documents through the operators of the subpackage ``llm``: each stage is written as Parquet and
read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwarden.llm.common import documents, durable
from docwarden.llm.op05_exact_dedup import drop_exact_duplicates
from docwarden.llm.op06_jaccard_join import drop_near_duplicates
from docwarden.llm.op08_mixing import label_domains, mix_documents
from docwarden.llm.op09_bpe import bpe_encode
from docwarden.llm.op10_quality_gam import keep_quality


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, _labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, similarity 0.8."""
    return drop_near_duplicates(docs, min_shared=80, width=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the domains ask for; clean ones all stay."""
    return mix_documents(docs, label_domains(_labels(spark, sf_dir)), keep="clean")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    return bpe_encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

#: SQL cannot say what the fitted models and the tokenizer do; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
