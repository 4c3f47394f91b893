"""Toxicity by classifier chains.

Categories are predicted one after another by linear models; each model sees the document's words and
the probabilities of the categories before it. While training, these are out-of-fold predictions: of a
model that has not seen the row, so a later model does not rely on an earlier one's overfit.

The labels table marks documents as toxic; the chain splits that into ``insult`` (toxic, with a word
for a person), ``contempt`` (toxic, with a word of contempt) and, last, ``toxic`` itself, which is
the decision and is learnt from the label alone. Features are words and parts of words: those that
deviate most in at most ``SAMPLE_ROWS`` labelled documents; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import blocks, documents, query, text_bytes
from docwarden.llm.linear import SAMPLE_ROWS, TERM_BLOCK_BYTES, distinct_terms, fit_logistic, hash_of, labelled_sample, matrix, predict, term_features, training_rows, vocabulary

CATEGORIES = ("insult", "contempt", "toxic")
FOLDS = 5
THRESHOLD = 0.5

# Words that name the first two categories.
WORDS = {
    "insult": "idiot moron loser scum clown fool jerk imbecile bastard dumbass coward liar freak creep pig rat",
    "contempt": "stupid worthless pathetic disgusting trash garbage filthy ugly dumb useless hate vile sick crap",
}


@dataclass
class Chain:
    """A vocabulary and one model per category, in order."""

    vocab: np.ndarray
    models: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """One column per category."""
        known = np.zeros((len(x), 0))
        for weights in self.models:
            known = np.column_stack([known, predict(weights, np.column_stack([x, known]))])
        return known


def fit_chain(vocab: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """``y`` has a column per category; ``fold`` gives each row's part."""
    known, models = np.zeros((len(x), 0)), []
    for k in range(y.shape[1]):
        inputs = np.column_stack([x, known])
        models.append(fit_logistic(inputs, y[:, k]))
        if k + 1 < y.shape[1]:
            out = np.zeros(len(x))
            for part in np.unique(fold):
                away = fold == part
                out[away] = predict(fit_logistic(inputs[~away], y[~away, k]), inputs[away])
            known = np.column_stack([known, out])
    return Chain(vocab, models)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = labelled_sample(docs, labels, sample_rows)
    terms = distinct_terms(sample)
    named = {name: F.arrays_overlap("words", F.array(*[F.lit(hash_of(w)) for w in text.split()])) for name, text in WORDS.items()}
    for c in CATEGORIES:
        terms = terms.withColumn(f"is_{c}", (F.col("toxic") == 1).cast("int") * (named[c].cast("int") if c in named else 1))
    targets = [f"is_{c}" for c in CATEGORIES]
    vocab = vocabulary(terms, [F.col(t) for t in targets])
    terms = terms.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS)
    rows = training_rows(sample, terms, vocab, [*targets, "fold"])
    y = np.column_stack([rows.column(t).to_numpy().astype(np.float64) for t in targets])
    return fit_chain(vocab, matrix(rows, vocab), y, rows.column("fold").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id, a
    probability per category, and ``toxic``: whether the last one reaches ``THRESHOLD``.

    A null or empty text has no words and gets the models' prior. Repeated rows are answered each; an
    empty table gives no rows. Without labels every probability is 0.5 and nothing counts as toxic."""
    chain = fit_toxicity(docs, labels, sample_rows)
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TERM_BLOCK_BYTES):
            p = chain.score(term_features(chain.vocab, text_bytes(block.column(1))))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))], names=names)

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, "doc_id long, " + ", ".join(f"{n} double" for n in names[1:]))
    return scored.withColumn("toxic", F.col("p_toxic") > THRESHOLD)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
