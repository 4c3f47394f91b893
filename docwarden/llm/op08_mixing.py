"""Mixing sources to target weights with soft membership.

A classifier fitted to the labelled table gives every document its posterior over domains, so each
document belongs to all of them in part. Rates r >= 0 are sought for which the expected tokens of each
domain, S_k = sum of r * tokens * p_k over documents, meet the targets T_k = weight_k * all tokens:
least squares in (S_k - T_k) / sqrt(T_k), by projected gradient descent from r = 1. The step of a
document is scaled by its length, so long documents do not move first.

All a step needs of the corpus is one number per domain, summed where the documents are. A document's
rate follows from its posterior and the list of gradients so far, so steps store nothing per document.

A scarce domain moves by about its share / its target a step, so plain steps alone may take thousands.
What ``FOLD_STEPS`` of them leave is closed by one proximal step. The rates that minimise the squares plus
a small weight times the squared distance from the present rates, r0, are max(0, r0 + p . l) with one l
per domain; l is the minimum of a convex function of so many variables, found by Newton's method. The
weight falls tenfold until every target is met or a dual bound proves that no rates are better. A pass
sums k + k (k + 1) / 2 + 1 numbers for k domains.

Targets out of reach: the sums at the optimum are unique, the rates are not, and the last thousandths may
rest on thousands of copies of one document. The rates returned are those of the largest weight whose
sums are within the tolerance of the optimum's, and a warning gives each domain's distance from its
target. If neither targets nor optimum are reached, it is an error.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.llm.common import BLOCK_BYTES, blocks, documents, durable, inside_table, joined, query, spans, text_bytes
from docwarden.llm.linear import SAMPLE_ROWS, TERM_BLOCK_BYTES, distinct_terms, fit_logistic, labelled_sample, matrix, predict, term_features, training_rows, vocabulary

TARGETS = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}
#: Shares of the tokens of the mix.
TOLERANCE, FOLD_STEPS = 0.002, 15
#: It stops when every domain is this near its target, or its least-squares optimum, relatively. After
#: so many plain steps the proximal ones follow.
PROXIMITIES, NEWTON_STEPS = tuple(10.0**-i for i in range(2, 14)), 100
#: Weights of the distance from the present rates; the bound of a Newton search.
VOCABULARY = 128
RECORD_BYTES = 64
#: What a copy takes besides its text, where copies are cut into batches.
_WORD = inside_table(b" \t\n\x0b\x0c\r\x00")


@dataclass
class Domains:
    """A vocabulary and one linear model per domain; posteriors are their normalised predictions."""

    names: list[str]
    vocab: np.ndarray
    models: list[np.ndarray]

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        x = term_features(self.vocab, texts)
        p = np.column_stack([predict(model, x) for model in self.models]) + 1e-9
        return p / p.sum(axis=1, keepdims=True)


def token_counts(texts: list[bytes]) -> np.ndarray:
    """Words between white space."""
    data, begins = joined(texts)
    starts, _ = spans(data, _WORD)
    return np.diff(np.searchsorted(starts, begins))


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], sample_rows: int = SAMPLE_ROWS) -> Domains:
    """``labelled`` has doc_id and domain; rows of other domains are left out."""
    labelled = labelled.filter(F.col("domain").isin(names) & F.col("doc_id").isNotNull())
    sample = labelled_sample(docs, labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain"), sample_rows)
    terms = distinct_terms(sample)
    marks = [(F.col("domain") == name).cast("int").alias(f"d{i}") for i, name in enumerate(names)]
    terms = terms.select("sample_row", "words", *marks)
    columns = [f"d{i}" for i in range(len(names))]
    vocab = vocabulary(terms, [F.col(c) for c in columns], VOCABULARY)
    rows = training_rows(sample, terms, vocab, columns)
    x = matrix(rows, vocab)
    return Domains(names, vocab, [fit_logistic(x, rows.column(c).to_numpy().astype(np.float64)) for c in columns])


def posterior_table(docs: DataFrame, domains: Domains) -> DataFrame:
    """doc_id, text_hash, n_tokens, p (array, one number per domain)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(domains.names)
        for block in blocks(batches, "text", TERM_BLOCK_BYTES):
            texts = text_bytes(block.column(1))
            p = domains.posteriors(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(token_counts(texts)), lists], names=["doc_id", "text_hash", "n_tokens", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, n_tokens long, p array<double>")


def rate_after(rate: Column, p: Column, history: list[np.ndarray]) -> Column:
    """The rate after the steps of ``history``: each moves against p . gradient, never below zero."""
    if not history:
        return rate
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in history])
    dot = lambda step: sum((p[k] * step[k] for k in range(len(history[0]))), F.lit(0.0))
    return F.aggregate(steps, rate, lambda r, step: F.greatest(F.lit(0.0), r - dot(step)))


def proximal_step(
    measure: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], goal: np.ndarray, proximity: float, start: np.ndarray, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """The l for which rates max(0, r0 + p . l) minimise the squares plus ``proximity`` times the
    distance from r0, and the relative distances of the sums from ``goal`` there. ``measure(l)`` gives
    the sums, their derivatives and half the squared rates."""

    def at(l: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        sums, slopes, half = measure(l)
        return sums - goal + proximity * goal * l, slopes + np.diag(proximity * goal), half - goal @ l + proximity / 2 * (goal @ l**2), sums / goal - 1

    now = start
    gradient, slopes, height, off = at(now)
    for _ in range(NEWTON_STEPS):
        if np.abs(off).max() < tolerance / 2 or np.abs(gradient / goal).max() < tolerance * 1e-4:
            break
        way = -np.linalg.lstsq(slopes / np.sqrt(np.outer(goal, goal)), gradient / np.sqrt(goal), rcond=1e-15)[0] / np.sqrt(goal)
        size, fall = 1.0, gradient @ way
        while size > 1e-9:
            there = at(now + size * way)
            if there[2] <= height + 1e-4 * size * fall or abs(there[0] @ way) <= 0.5 * abs(fall) and there[2] <= height + 1e-12 * abs(height):
                break
            size /= 2
        else:
            break
        now, (gradient, slopes, height, off) = now + size * way, there
    return now, off


def optimum_gap(goal: np.ndarray, off: np.ndarray, least: float) -> float:
    """How far half the sum of goal * off ** 2 is above its minimum at most; ``least`` is the smallest
    p . off of a document. The posteriors sum to 1, so adding -least to ``off`` makes it dual feasible."""
    dual = off + max(0.0, -least)
    slope, square = goal @ dual, goal @ dual**2
    return float(goal @ off**2 / 2 - (slope**2 / (2 * square) if slope < 0 else 0.0))


def fit_rates(table: DataFrame, targets: Mapping[str, float], tolerance: float = TOLERANCE) -> tuple[DataFrame, list[np.ndarray]]:
    """``table`` (n_tokens, p) with ``rate``, and all steps taken. Targets that the rates do not meet, at
    the least-squares optimum or where no step leads nearer, are a warning with the distances of the
    domains. Without tokens, or rows, every rate is 1."""
    weights = np.array(list(targets.values()), dtype=np.float64)
    if (weights < 0).any() or weights.sum() <= 0:
        raise ValueError("target weights must be nonnegative and not all zero")
    k = len(weights)
    t, p = F.col("n_tokens").cast("double"), F.col("p")
    moments = table.agg(F.sum(t).alias("total"), *[F.sum(t * p[a] * p[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(k)]).first()
    table, history, every = table.withColumn("rate", F.lit(1.0)), [], []
    if not moments["total"]:
        return table, every
    total = moments["total"]
    goal = np.maximum(weights / weights.sum(), 1e-9)
    curvature = np.array([[moments[f"m{a}_{b}"] for b in range(k)] for a in range(k)]) / total / np.sqrt(np.outer(goal, goal))
    size = 1 / np.linalg.eigvalsh(curvature).max()
    upper = [(a, b) for a in range(k) for b in range(a, k)]

    def dot(step: np.ndarray) -> Column:
        return sum((p[a] * float(step[a]) for a in range(k)), F.lit(0.0))

    def distance(table: DataFrame, history: list[np.ndarray]) -> np.ndarray:
        now = table.select("n_tokens", "p", rate_after(F.col("rate"), p, history).alias("r"))
        return np.array(now.agg(*[F.sum(t * F.col("r") * p[a]) for a in range(k)]).first()) / total / goal - 1

    for _ in range(FOLD_STEPS):
        off = distance(table, history)
        if np.abs(off).max() < tolerance:
            return table.withColumn("rate", rate_after(F.col("rate"), p, history)), every
        history.append(size * off)
        every.append(size * off)
    table = durable(table.withColumn("rate", rate_after(F.col("rate"), p, history)), "op8-rates")

    def measure(l: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        rated = table.select(t.alias("t"), "p", F.greatest(F.lit(0.0), F.col("rate") + dot(l)).alias("r"))
        held = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        sums = [F.sum(F.col("t") * F.col("r") * p[a]) for a in range(k)]
        slopes = [F.sum(held * p[a] * p[b]) for a, b in upper]
        got = np.array(rated.agg(*sums, *slopes, F.sum(F.col("t") * F.col("r") * F.col("r")) / 2).first(), dtype=np.float64) / total
        matrix = np.zeros((k, k))
        for (a, b), value in zip(upper, got[k:-1]):
            matrix[a, b] = matrix[b, a] = value
        return got[:k], matrix, got[-1]

    path, l = [], np.zeros(k)
    for proximity in PROXIMITIES:
        l, off = proximal_step(measure, goal, proximity, l, tolerance)
        path.append((l, off))
        if np.abs(off).max() < tolerance:
            break
        least = table.filter(t > 0).agg(F.min(dot(off))).first()[0]
        if optimum_gap(goal, off, least) <= tolerance**2 / 2 * goal[weights > 0].min():
            l, off = next(x for x in path if (np.abs(x[1] - off) * goal <= tolerance * np.maximum(goal, goal[weights > 0].min())).all())
            warnings.warn(f"op8: targets out of reach; at the least-squares optimum the domains are off by {_listed(targets, off)}", stacklevel=2)
            break
    else:
        warnings.warn(f"op8: neither targets nor a proven optimum reached; the domains are off by {_listed(targets, off)}", stacklevel=2)
    every.append(-l)
    return table.withColumn("rate", rate_after(F.col("rate"), p, [-l])), every


def _listed(targets: Mapping[str, float], off: np.ndarray) -> str:
    return ", ".join(f"{name} {value:+.2%}" for name, value in zip(targets, off))


def copies_of(rate: Column) -> Column:
    """Whole copies whose expectation is the rate: the fraction is decided by a hash of the row."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("long")


def keep_scale(rated: DataFrame, place: int) -> float:
    """What all rates are multiplied by so that the tokens of documents that are likeliest of the domain
    at ``place`` do not become fewer: the others then keep their proportion to them. At least 1, and
    about 1 / target of the domain at most."""
    t = F.col("n_tokens").cast("double")
    mine = rated.filter(F.col("p")[place] >= F.array_max("p"))
    sums = mine.agg(F.sum(t).alias("before"), F.sum(t * F.col("rate")).alias("after")).first()
    return max(1.0, sums["before"] / sums["after"]) if sums["after"] else 1.0


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic before junk (quality 0) before clean; unlabelled rows go."""
    return labels.select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain")
    ).filter("domain IS NOT NULL")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, sample_rows: int = SAMPLE_ROWS, keep: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id,
    text_hash, n_tokens, p_<domain> of each target, rate, copies.

    A null or empty text has no tokens; it weighs nothing, and its rate follows from its posterior as
    any other's. Rows that repeat an id and a text get the same answer each. An empty table gives no
    rows. Without labels all posteriors are equal and all rates 1.

    ``keep`` names a domain that mixing shall not thin out: all rates are multiplied by ``keep_scale``,
    and a document that is likeliest of that domain has a rate of 1 at least."""
    names = list(targets)
    table = durable(posterior_table(docs, fit_domains(docs, labelled, names, sample_rows)), "op8-posteriors")
    rated, _ = fit_rates(table, targets)
    if keep is not None:
        rate = F.col("rate") * keep_scale(rated, names.index(keep))
        mine = F.col("p")[names.index(keep)] >= F.array_max("p")
        rated = rated.withColumn("rate", F.when(mine, F.greatest(F.lit(1.0), rate)).otherwise(rate))
    return rated.select(
        "doc_id", "text_hash", "n_tokens", *[F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(names)], "rate", copies_of(F.col("rate")).alias("copies")
    )


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, keep: str | None = None) -> DataFrame:
    """Each row of ``docs``, with all columns, as often as its copies say; ``keep``, nulls, empty texts
    and repeated rows as in ``mixing_rates``. Posterior and rate of a row are worked out where the row
    is, from the fitted models and the list of steps. An empty table gives no rows."""
    names = list(targets)
    domains = fit_domains(docs, labelled, names)
    rated, steps = fit_rates(durable(posterior_table(docs, domains), "op8-posteriors"), targets)
    kept = names.index(keep) if keep is not None else None
    scale = keep_scale(rated, kept) if kept is not None else 1.0
    place = docs.columns.index("text")
    at = len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch.rename_columns([str(i) for i in range(batch.num_columns)])], str(place), TERM_BLOCK_BYTES):
                texts = text_bytes(block.column(place))
                p = domains.posteriors(texts)
                rate = np.ones(len(p))
                for step in steps:
                    rate = np.maximum(0.0, rate - p @ step)
                rate = rate * scale
                if kept is not None:
                    rate = np.where(p[:, kept] >= p.max(axis=1), np.maximum(rate, 1.0), rate)
                times = np.floor(rate + block.column(at).to_numpy()).astype(np.int64)
                order = np.repeat(np.arange(len(p)), times)
                ends = np.cumsum(np.array([len(x) + RECORD_BYTES for x in texts], dtype=np.int64)[order])
                for part in np.split(order, np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1):
                    rows = block.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays(rows.columns[:at], names=batch.schema.names[:at])

    chance = F.pmod(F.xxhash64(F.lit("mix"), docs["doc_id"].cast("long"), F.xxhash64(docs["text"])), F.lit(1 << 30)) / float(1 << 30)
    return docs.select(*[docs[c] for c in docs.columns], chance.alias("_chance")).mapInArrow(work, docs.schema)


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text_hash")
