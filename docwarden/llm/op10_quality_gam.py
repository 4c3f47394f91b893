"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers (shares of character classes, repetition, word and line lengths).
Each number is cut into bins. Cyclic boosting visits the features round-robin; each visit fits a
shallow tree to the gradients summed per bin and adds it, damped, to the feature's lookup table. Then
the pairs of features whose residuals gain most from a joint split get tables of their own in the same
way. A score is the sigmoid of an intercept plus one table entry per feature and pair.

Texts are read once to make the narrow feature table. The model is fitted on the driver to at most
``SAMPLE_ROWS`` labelled rows of it, chosen by a hash of their id; scoring is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import blocks, bound_batches, documents, durable, inside_table, joined, query, span_hashes, spans, text_bytes

SAMPLE_ROWS = 20_000
#: Bound of the labelled rows a model is fitted to.
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "upper", "digits", "white", "stops", "bangs", "bars", "symbols", "foreign",
    "word_length", "long_words", "distinct_words", "words_per_line", "repeated_lines", "bare_words", "runs",
)
_NOT_WHITE = inside_table(b" \t\n\x0b\x0c\r\x00")
_NOT_BREAK = inside_table(b"\n\x00")


def _members(values: bytes) -> np.ndarray:
    return ~inside_table(values)


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_CLASSES = {
    "upper": _members(bytes(range(65, 91))),
    "letters": _members(_LETTERS),
    "digits": _members(b"0123456789"),
    "white": _members(b" \t\n\x0b\x0c\r"),
    "stops": _members(b".,;:?"),
    "bangs": _members(b"!"),
    "bars": _members(b"|"),
    "symbols": _members(b"#$%&*+<=>@[\\]^_`{}~/"),
    "foreign": _members(bytes(range(128, 256))),
}


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; zeros for an empty one."""
    n = len(texts)
    data, begins = joined(texts)
    size = np.diff(begins) - 1
    owner_sum = lambda flags: np.add.reduceat(flags, begins[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    count = {name: owner_sum(table[data]) for name, table in _CLASSES.items()}
    starts, ends = spans(data, _NOT_WHITE)
    owner = np.searchsorted(begins, starts, side="right") - 1
    lengths = ends - starts
    words = np.bincount(owner, minlength=n)
    per_word = lambda weights: np.bincount(owner, weights=weights, minlength=n) / np.maximum(words, 1)
    hashes = span_hashes(data, starts, ends)
    named = np.cumsum(np.concatenate([[0], (_CLASSES["letters"] | _CLASSES["foreign"])[data]]))
    bare = named[ends] == named[starts]
    line_starts, line_ends = spans(data, _NOT_BREAK)
    line_owner = np.searchsorted(begins, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    line_hashes = span_hashes(data, line_starts, line_ends)
    same = np.concatenate([[False], (data[1:] == data[:-1]) & ~_CLASSES["white"][data[1:]]])
    share = lambda name: count[name] / np.maximum(size, 1)
    columns = (
        np.log1p(size), np.log1p(words), count["upper"] / np.maximum(count["letters"], 1), share("digits"), share("white"),
        share("stops"), share("bangs"), share("bars"), share("symbols"), share("foreign"),
        per_word(lengths), per_word(lengths > 12), _distinct(owner, hashes, n) / np.maximum(words, 1), words / np.maximum(lines, 1),
        1 - _distinct(line_owner, line_hashes, n) / np.maximum(lines, 1) * (lines > 0) - (lines == 0), per_word(bare),
        owner_sum(same) / np.maximum(size, 1),
    )
    return np.column_stack(columns).astype(np.float64)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each owner."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(owner[new], minlength=n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _split(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins: the value of each bin's leaf."""
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad), np.cumsum(hess)
        left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
        gains = np.where((h[:-1] > 1) & (h[-1] - h[:-1] > 1), left + right, -1.0)
        cut = int(np.argmax(gains))
        if gains[cut] > g[-1] ** 2 / (h[-1] + 1) + 1e-9:
            return np.concatenate([_split(grad[: cut + 1], hess[: cut + 1], depth - 1), _split(grad[cut + 1 :], hess[cut + 1 :], depth - 1)])
    return np.full(len(grad), grad.sum() / (hess.sum() + 1))


def _split_grid(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid: one cut on one axis, then one cut on the other axis on each side."""
    best, value = -1.0, np.zeros_like(grad)
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        for cut in range(1, len(g)):
            leaves = [_split(part.sum(0), weight.sum(0), 1) for part, weight in ((g[:cut], h[:cut]), (g[cut:], h[cut:]))]
            gain = sum(float(leaf @ part.sum(0)) for leaf, part in zip(leaves, (g[:cut], g[cut:]), strict=True))
            if gain > best:
                best = gain
                table = np.vstack([np.tile(leaves[0], (cut, 1)), np.tile(leaves[1], (len(g) - cut, 1))])
                value = table if axis == 0 else table.T
    return value, best


@dataclass
class Gam:
    """Intercept, bin edges and lookup tables."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for a, b, _ in self.pairs for f in (a, b)}
        for a, b, table in self.pairs:
            total += table[coarse[a], coarse[b]]
        return _sigmoid(total)


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of shallow trees. Without rows, or with one class, the score is constant."""
    features = x.shape[1]
    cuts = lambda column, bins: np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.zeros(0)
    edges = [cuts(x[:, f], BINS) for f in range(features)]
    coarse = [cuts(x[:, f], PAIR_BINS) for f in range(features)]
    positive = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(positive / (1 - positive))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(features)]
    logit = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for f in range(features):
            p = _sigmoid(logit)
            size = len(edges[f]) + 1
            grad, hess = np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size)
            step = RATE * _split(grad, hess)
            model.tables[f] += step
            logit += step[bins[f]]
    grid = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(features)]
    p = _sigmoid(logit)
    gains = []
    for a in range(features):
        for b in range(a + 1, features):
            shape = len(coarse[a]) + 1, len(coarse[b]) + 1
            cell = grid[a] * shape[1] + grid[b]
            grad, hess = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            gains.append((_split_grid(grad.reshape(shape), hess.reshape(shape))[1], a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            p = _sigmoid(logit)
            cell = grid[a] * table.shape[1] + grid[b]
            grad, hess = np.bincount(cell, y - p, table.size), np.bincount(cell, p * (1 - p), table.size)
            step = RATE * _split_grid(grad.reshape(table.shape), hess.reshape(table.shape))[0]
            table += step
            logit += step.ravel()[cell]
    return model


def held_out(doc_id) -> F.Column:
    """A fifth of the ids, by crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def feature_table(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = text_features(text_bytes(block.column(1)))
            flat = pa.array(x.ravel())
            offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, "doc_id long, x array<double>")


def fit_quality(features: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """Fit to labelled rows that are not held out: at most ``sample_rows``, by a hash of their id."""
    labelled = labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    rows = (
        features.join(labelled.filter(~held_out(F.col("doc_id"))), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x")
        .limit(sample_rows)
        .select("x", "quality")
        .toArrow()
    )
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit_gam(x, rows.column("quality").to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id,
    held_out, score, predicted.

    A null or empty text is scored like any other, from features that are all zero. Repeated rows are
    answered each; an empty table gives no rows; without labels every score is 0.5."""
    features = durable(feature_table(docs), "op10-features")
    model = fit_quality(features, labels, sample_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns."""
    bound_batches(docs.sparkSession)
    model = fit_quality(durable(feature_table(docs), "op10-features"), labels)
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch.rename_columns([str(i) for i in range(batch.num_columns)])], str(place)):
                good = model.score(text_features(text_bytes(block.column(place)))) >= threshold
                yield block.filter(pa.array(good)).rename_columns(batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


@query("op10_quality_gam")
def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
