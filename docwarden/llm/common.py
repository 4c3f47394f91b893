"""What several operators share: shared folders, durable tables, bounded Arrow blocks, word hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.session import run_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BLOCK_BYTES = 1 << 20
#: Whole texts a task looks at in one step; a longer text is a block of its own.

ASCII_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Lower-cases A-Z in UTF-8 bytes and leaves the rest.


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several steps read, so that it is computed once and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its oracle."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return register


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def matching_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all columns, whose id and text hash are in ``kept`` (doc_id, text_hash).
    Other columns may have any names. A null id matches a null id; an empty table gives no rows.
    Where ``docs`` repeats such a row, one of the copies is returned; whether it does is looked up in
    the narrow columns first, so that whole rows are grouped only then."""
    kept_id, kept_hash = free_name(docs, "_kept_id"), free_name(docs, "_kept_hash")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    mark = F.xxhash64(docs["text"])
    wanted = docs["doc_id"].cast("long").eqNullSafe(F.col(kept_id)) & (mark == F.col(kept_hash))
    narrow = docs.select(docs["doc_id"], docs["text"]).select("doc_id", F.xxhash64("text").alias("mark"))
    if narrow.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        return docs.join(kept, wanted, "left_semi")
    names = docs.columns
    row = F.struct(*[docs[c] for c in names])
    one = docs.select(docs["doc_id"].alias("_id"), mark.alias("_mark"), row.alias("_row")).groupBy("_id", "_mark").agg(F.first("_row").alias("_row"))
    one = one.join(kept, F.col("_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col("_mark") == F.col(kept_hash)), "left_semi")
    return one.select("_row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BATCH_BYTES = 4 << 20
#: What Spark hands a worker at once; a longer row is a batch of its own.


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound on Arrow batches, for stages that hold whole texts in their workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give memory that a worker has freed back to the machine: workers outlive their tasks, and the
    allocators would keep the largest block's pages for the next one."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose values of ``column`` hold at most ``limit`` bytes, or of
    one row. Every row comes out once, in order."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


# ---------------------------------------------------------------- words as 64-bit hashes

_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(kind)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            held = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base)]), dtype=np.uint64)
        _POWERS[kind] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that order and low bits of the result are even."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` (256 booleans) admits."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = inside[data]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial over random byte values, then mixed
    with the length. Two different words share one with a chance of about 2^-60."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        terms = _BYTE_VALUES[data] * _powers("up", _BASE, len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        value = (sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts]
        return mix(value + (ends - starts).astype(np.uint64))


def inside_table(outside: bytes) -> np.ndarray:
    """256 booleans: true for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(outside)] = False
    return table


def joined(texts: list[bytes], separator: bytes = b"\x00") -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by the separator, and each text's first byte."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    return np.frombuffer(separator.join(texts) + separator, dtype=np.uint8), starts
