"""Repeated and missing ids, repeated labels and clashing names: no operator multiplies or loses rows."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm import linear, op01_sharding, op05_exact_dedup, op06_jaccard_join


def rows_of(df, columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("limit", [200, 1 << 20])
def test_every_row_is_written_once(spark, tmp_path, limit):
    rows = [(1, "a" * 50, 7), (1, "a" * 50, 7), (1, "b", 8), (2, None, 1), (None, "c" * 90, 2), (None, "c" * 90, 2), (None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _shard long").withColumns(
        {c: F.lit("same") for c in ("row", "code", "record", "parent")}).repartition(3)
    op01_sharding.write_shards(docs, str(tmp_path / "shards"), limit)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*docs.columns, "__shard"}
    assert rows_of(back, docs.columns) == rows_of(docs, docs.columns)
    sizes = back.groupBy("__shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n"), F.count("*").alias("k"))
    assert sizes.filter((F.col("n") > limit) & (F.col("k") > 1)).isEmpty()


def test_no_rows_write_no_shards(spark, tmp_path):
    op01_sharding.write_shards(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("_shard=*"))


@pytest.mark.parametrize("repeats", [1, 2])
@pytest.mark.parametrize("drop", [op05_exact_dedup.drop_exact_duplicates, op06_jaccard_join.drop_near_duplicates])
def test_kept_rows_with_clashing_names(spark, drop, repeats):
    texts = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "seven words that stand in no other text"), (4, None)]
    docs = spark.createDataFrame(texts * repeats, "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in ("_kept_id", "__KEPT_ID", "_kept_hash", "_id", "_mark", "_row", "mark")})
    kept = drop(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]


def training(docs, labels, limit):
    sample = linear.labelled_sample(docs, labels, limit)
    terms = linear.distinct_terms(sample)
    vocab = np.sort(linear.term_hashes([b"alpha beta gamma"])[1])
    return sample, linear.training_rows(sample, terms, vocab, ["toxic"])


def test_training_rows_are_one_a_text(spark):
    """An id of many texts gives each of them once, not each with every other's features."""
    texts = [(1, f"alpha number {i} of its own kind w{i * 7919 % 65537:x}") for i in range(60)] + [(1, "beta")] * 40 + [(2, "gamma"), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (9, 1)], "doc_id long, toxic int")
    sample, rows = training(docs, labels, 1000)
    assert sample.count() == 2 * 100 + 2
    assert rows.num_rows == 60 + 1 + 1
    x = linear.matrix(rows, np.sort(linear.term_hashes([b"alpha beta gamma"])[1]))
    assert (x[:, :3].sum(axis=1) == 1).all()


def test_training_rows_keep_their_bound(spark):
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("alpha "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    sample, rows = training(docs, labels, 50)
    assert sample.count() == 50 and rows.num_rows == 50
    again, _ = training(docs.repartition(7), labels, 50)
    assert rows_of(again, ["text"]) == rows_of(sample, ["text"])
