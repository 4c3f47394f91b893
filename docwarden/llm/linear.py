"""Linear models over the terms of labelled documents: vocabulary, features, fitting. Terms are words
and, since some languages compound them, all runs of ``GRAM`` bytes within words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docwarden.llm.common import ASCII_LOWER, blocks, bound_batches, durable, inside_table, joined, span_hashes, spans, text_bytes

SAMPLE_ROWS = 8_000
#: Bound of the labelled rows a model is fitted to, chosen by a hash of their id.
VOCABULARY = 256
GRAM = 6
TERM_BLOCK_BYTES = 1 << 18
#: Texts whose terms are looked up in one step: a block takes some 200 times its bytes in arrays.
MIN_DOCUMENTS = 5
EXTRA_VARIANCE, LEAST_SCORE = 4.0, 25.0

INSIDE = inside_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word (letters, digits and non-ASCII, A-Z in lower case) and of
    every run of ``GRAM`` bytes inside a longer word."""
    data, begins = joined([text.translate(ASCII_LOWER) for text in texts])
    starts, ends = spans(data, INSIDE)
    extra = np.maximum(ends - starts - GRAM + 1, 0) * (ends - starts > GRAM)
    base = np.repeat(starts - np.cumsum(extra) + extra, extra)
    grams = base + np.arange(extra.sum())
    starts, ends = np.concatenate([starts, grams]), np.concatenate([ends, grams + GRAM])
    return np.searchsorted(begins, starts, side="right") - 1, span_hashes(data, starts, ends)


def hash_of(word: str) -> int:
    return int(term_hashes([word.encode()])[1].view(np.int64)[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows with their text, numbered by ``sample_row``. The chosen labels are
    broadcast: ``limit`` rows bound their size. Where ids are repeated, in ``docs`` or ``labels``, the
    pairs may be more; a hash of the whole pair then chooses ``limit`` of them."""
    bound_batches(docs.sparkSession)
    chosen = labels.orderBy(F.xxhash64("doc_id"), *labels.columns).limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = durable(rows.join(F.broadcast(chosen), "doc_id").withColumn("sample_row", F.monotonically_increasing_id()), "llm-sample")
    if pairs.count() <= limit:
        return pairs
    order = F.xxhash64(*[c for c in pairs.columns if c != "sample_row"])
    some = pairs.select("sample_row", order.alias("order")).orderBy("order", "sample_row").limit(limit)
    return durable(pairs.join(F.broadcast(some.select("sample_row")), "sample_row", "left_semi"), "llm-sample")


def distinct_terms(sample: DataFrame) -> DataFrame:
    """The sample with ``words`` (distinct hashes) in place of its text, one row of each group of copies."""
    names = [c for c in sample.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TERM_BLOCK_BYTES):
            owner, hashes = term_hashes(text_bytes(block.column(block.schema.get_field_index("text"))))
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
            cuts = np.searchsorted(owner, np.arange(1, block.num_rows))
            words = [np.unique(part).view(np.int64).tolist() for part in np.split(hashes, cuts)]
            rest = [block.column(block.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(words, pa.list_(pa.int64()))], names=[*names, "words"])

    kinds = dict(sample.dtypes)
    return one_of_copies(durable(sample.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", words array<long>"), "llm-terms"))


def one_of_copies(words: DataFrame) -> DataFrame:
    """The sample with one row of each group of near copies, the smallest id: else the words of a text
    that is there ten times would look like evidence of ten; of a repeated id, the first row. Rows are copies when one of four runs of
    their sorted word hashes agrees; short rows when all words agree. The keys of at most the sample's
    bounded number of rows are compared on the driver."""
    size = F.size("words")
    runs = [F.slice("words", 1, 6), F.slice("words", 7, 6), F.slice("words", size - 5, 6), F.slice("words", size - 11, 6)]
    keys = [F.xxhash64(F.lit(i), F.when(size >= 24, run).otherwise(F.col("words"))).alias(f"k{i}") for i, run in enumerate(runs)]
    rows = words.select("doc_id", "sample_row", *keys).toArrow().to_pydict()
    order = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i], rows["sample_row"][i]))
    leader: dict[int, int] = {}
    kept = []
    for i in order:
        mine = {rows[f"k{k}"][i] for k in range(len(keys))}
        if not any(key in leader for key in mine):
            kept.append((rows["sample_row"][i],))
        for key in mine:
            leader.setdefault(key, i)
    chosen = words.sparkSession.createDataFrame(kept or [(None,)], "sample_row long")
    return words.join(F.broadcast(chosen), "sample_row", "left_semi")


def vocabulary(words: DataFrame, targets: list[Column], size: int = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the words that tell most about any target (0 or 1): by the squared deviation
    from the expected number over its variance, as in chi-square, with ``EXTRA_VARIANCE`` added so that
    words of a few documents do not win by chance, and of at least ``LEAST_SCORE``."""
    sums = [F.sum(t).alias(f"t{i}") for i, t in enumerate(targets)]
    all_rows = words.agg(F.count("*").alias("n"), *sums).first()
    total = all_rows["n"]
    counted = words.select(F.explode("words").alias("word"), *[t.alias(f"t{i}") for i, t in enumerate(targets)])
    counted = counted.groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(targets))])
    score = F.lit(0.0)
    for i in range(len(targets)):
        positive = all_rows[f"t{i}"] or 0
        if 0 < positive < total:
            expected = F.col("n") * positive / total
            spread = expected * (1 - positive / total) * (1 - F.col("n") / (total + 1)) + EXTRA_VARIANCE
            score = F.greatest(score, F.pow(F.col(f"t{i}") - expected, 2) / spread)
    top = counted.filter(F.col("n") >= MIN_DOCUMENTS).select("word", score.alias("score")).filter(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "word").limit(size)
    return np.sort(np.array([r["word"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def term_features(vocab: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """One row per text: for each term of the vocabulary whether the text has it, then the square roots
    of its occurrences per 1000 bytes."""
    counts = np.zeros((len(texts), len(vocab)), dtype=np.float32)
    owner, hashes = term_hashes(texts)
    if len(vocab):
        likely = np.zeros(1 << 16, dtype=bool)
        likely[vocab >> np.uint64(48)] = True
        some = np.flatnonzero(likely[hashes >> np.uint64(48)])
        owner, hashes = owner[some], hashes[some]
        at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
        hit = vocab[at] == hashes
        np.add.at(counts, (owner[hit], at[hit]), 1)
    size = np.array([max(len(t), 1) for t in texts], dtype=np.float32)[:, None]
    return np.hstack([counts > 0, np.sqrt(1000 * counts / size)]).astype(np.float32)


def training_rows(sample: DataFrame, terms: DataFrame, vocab: np.ndarray, columns: list[str]) -> pa.Table:
    """Features (``x``) and ``columns`` of the rows of ``terms``, one each, brought to the driver: at most
    as many as the sample's bound, each of twice the vocabulary's numbers."""
    width = 2 * len(vocab)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TERM_BLOCK_BYTES):
            x = term_features(vocab, text_bytes(block.column(1)))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["sample_row", "x"])

    made = sample.select("sample_row", "text").mapInArrow(work, "sample_row long, x array<float>")
    return made.join(terms.select("sample_row", *columns), "sample_row").toArrow()


def matrix(rows: pa.Table, vocab: np.ndarray) -> np.ndarray:
    return rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, 2 * len(vocab))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Weights and, last, the intercept, by damped Newton steps. One class or no rows: the prior alone."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    weights = np.zeros(x.shape[1] + 1)
    weights[-1] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return weights
    with_one = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    penalty = np.full(len(weights), ridge)
    penalty[-1] = 1e-3
    sign = 1 - 2 * y
    loss = lambda w: np.logaddexp(0, sign * (with_one @ w)).sum() + (penalty * w**2).sum() / 2
    now = loss(weights)
    for _ in range(steps):
        p = sigmoid(with_one @ weights)
        gradient = with_one.T @ (y - p) - penalty * weights
        hessian = (with_one * (p * (1 - p))[:, None]).T @ with_one + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        share = 1.0
        while (then := loss(weights + share * change)) > now and share > 1e-3:
            share /= 2
        if then >= now:
            break
        weights, gain, now = weights + share * change, now - then, then
        if gain < 1e-4:
            break
    return weights


def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ weights[:-1] + weights[-1])
