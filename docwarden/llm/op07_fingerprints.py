"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line breaks and, so that a one-line text has parts as well, at
sentence ends. Each paragraph's 64-bit digest (a repeated one with its number) is added to three cells
of a sketch; a cell holds a count, the XOR of its digests and the XOR of their checks. Subtracting the
sketches of two versions cancels what they share. Peeling takes a digest out of a cell that holds just
one, which may free others, until the difference is listed; when cells remain, both sketches are made
anew with twice the cells. The fingerprint is the smallest sketch; likeness is shared paragraphs over
all paragraphs, as recovered.

Sketches of a block of pairs are built and peeled together with array operations. Documents are range
partitioned by id once; the only rows that wait for another task's are the first and last of each
partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docwarden.llm.common import blocks, bound_batches, documents, durable, inside_table, joined, mix, query, span_hashes, spans

CELLS = 18
#: Cells of a fingerprint; a retry doubles them.
PARTS = 3
BLOCK_BYTES = 1 << 19
#: Texts of one step; digests and sketches of both versions and of what follows take many times that.
_INSIDE = inside_table(b"\n\r.!?\x00")
_REPEAT = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)


def paragraph_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and digest of every paragraph; equal paragraphs of a text get different digests."""
    data, begins = joined(texts)
    starts, ends = spans(data, _INSIDE)
    blank = data[starts] == 32
    starts = starts + blank
    full = starts < ends
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(begins, starts, side="right") - 1
    keys = span_hashes(data, starts, ends)
    order = np.lexsort((keys, owner))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    nth = np.empty(len(order), dtype=np.uint64)
    nth[order] = (np.arange(len(order)) - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        return owner, mix(keys + nth * _REPEAT)


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _SEEDS[3])


def _places(owner: np.ndarray, keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of each key, one in each third of its sketch."""
    part = cells // PARTS
    return [owner * cells + i * part + (mix(keys ^ _SEEDS[i]) % np.uint64(part)).astype(np.int64) for i in range(PARTS)]


class Sketches:
    """Sketches of many texts (or of many differences) side by side."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, dtype=np.int64)
        self.key = np.zeros(n * cells, dtype=np.uint64)
        self.check = np.zeros(n * cells, dtype=np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        check = _check(keys)
        for at in _places(owner, keys, self.cells):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def packed(self) -> list[bytes]:
        """Each sketch as bytes: 12 for a cell, of whose check 16 bits are kept."""
        cell = np.zeros(self.n * self.cells, dtype=[("count", "<i2"), ("check", "<u2"), ("key", "<u8")])
        cell["count"], cell["check"], cell["key"] = self.count, self.check >> np.uint64(48), self.key
        raw, size = cell.tobytes(), self.cells * cell.itemsize
        return [raw[i * size : (i + 1) * size] for i in range(self.n)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, key and sign of what was recovered, and which sketches came out empty."""
        owners, keys, signs = [], [], []
        for _ in range(2 * self.cells + 8):  # a round takes a key of some sketch at least, of at most as many
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[_check(self.key[pure]) == self.check[pure]]
            if not len(pure):
                break
            owner, key, sign = pure // self.cells, self.key[pure], self.count[pure]
            order = np.lexsort((key, owner))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            take = order[new]
            owner, key, sign = owner[take], key[take], sign[take]
            self.add(owner, key, -sign)
            owners.append(owner), keys.append(key), signs.append(sign)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        empty = ~left.reshape(self.n, self.cells).any(axis=1)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return flat(owners, np.int64), flat(keys, np.uint64), flat(signs, np.int64), empty


def differences(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs 0..n-1, with the paragraphs (owner, key) of either version: pair, key and sign (1: only
    in the first) of every differing paragraph, and the cells each pair took. Pairs whose peeling fails
    are tried again with twice the cells until it succeeds."""
    open_ = np.arange(n)
    took = np.zeros(n, dtype=np.int64)
    owners, keys, signs = [], [], []
    while len(open_):
        number = np.full(n, -1)
        number[open_] = np.arange(len(open_))
        sketch = Sketches(len(open_), cells)
        for (owner, key), sign in ((a, 1), (b, -1)):
            wanted = number[owner] >= 0
            sketch.add(number[owner[wanted]], key[wanted], sign)
        owner, key, sign, empty = sketch.peel()
        good = empty[owner]
        owners.append(open_[owner[good]]), keys.append(key[good]), signs.append(sign[good])
        took[open_[empty]] = cells
        open_ = open_[~empty]
        cells *= 2
    return np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(signs) if signs else np.zeros(0, np.int64), took


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shared paragraphs over all paragraphs of each pair (1 for two texts without any), and cells."""
    pair, _, sign, took = differences(n, a, b)
    size_a, size_b = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    shared = size_a - np.bincount(pair[sign > 0], minlength=n)
    every = size_a + size_b - shared
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0), took


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha", pa.binary()), ("sketch", pa.binary()), ("edited_sketch", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("cells_edited", pa.int64()), ("cells_next", pa.int64()),
    ("place", pa.string()), ("part", pa.int64()), ("text", pa.string()),
])
DDL = (
    "doc_id long, n_chars long, edited_sha binary, sketch binary, edited_sketch binary, near_edited double, near_next double,"
    " cells_edited long, cells_next long, place string, part long, text string"
)


def fingerprint_block(ids: list[int | None], texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Fingerprints of texts, each with the text that follows it."""
    n = len(texts)
    edited = [edited_text(text, after).encode() for text, after in zip(texts, following, strict=True)]
    mine, other, after = (paragraph_keys(t) for t in ([t.encode() for t in texts], edited, [t.encode() for t in following]))
    sketches = []
    for owner, keys in (mine, other):
        sketch = Sketches(n, CELLS)
        sketch.add(owner, keys, 1)
        sketches.append(sketch.packed())
    near_edited, cells_edited = likeness(n, mine, other)
    near_next, cells_next = likeness(n, mine, after)
    nothing = [None] * n
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t).digest() for t in edited], *sketches, near_edited, near_next, cells_edited, cells_next, nothing, nothing, nothing]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def _edge(place: str, part: int, doc: int | None, text: str) -> pa.RecordBatch:
    row = {"doc_id": doc, "place": place, "part": part, "text": text}
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in SCHEMA], schema=SCHEMA)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a sorted partition with their followers; its first and last row as they are."""
    part, last = TaskContext.get().partitionId(), None
    for block in blocks(batches, "text", BLOCK_BYTES):
        ids, texts = block.column(0).to_pylist(), block.column(1).to_pylist()
        if last is None:
            yield _edge("first", part, ids[0], texts[0])
        else:
            ids, texts = [last[0], *ids], [last[1], *texts]
        if len(ids) > 1:
            yield fingerprint_block(ids[:-1], texts[:-1], texts[1:])
        last = ids[-1], texts[-1]
    if last is not None:
        yield _edge("last", part, *last)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        yield fingerprint_block(*(block.column(i).to_pylist() for i in range(3)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (base64), near_edited, near_next, and the cells with
    which either comparison succeeded.

    The next document is that of the next larger id, after the last the first; a null id comes before
    all others, and rows of one id follow each other by the hash of their text. A null or empty text
    has no paragraphs; two such texts have likeness 1. An empty table gives no rows."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = durable(ordered.mapInArrow(_in_order, DDL), "op7-fingerprints")
    firsts = done.filter("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = done.filter("place = 'last'").select("doc_id", "text", "part")
    # One row per partition: the partition that follows it, in a ring.
    ring = lasts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next_part"), F.min("part").over(Window.partitionBy(F.lit(1))).alias("start"))
    ring = ring.select("part", F.coalesce("next_part", "start").alias("next_part"))
    edges = lasts.join(ring, "part").join(firsts, "next_part").select("doc_id", "text", "following").mapInArrow(_edges, DDL)
    return done.filter("place IS NULL").unionByName(edges).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), F.base64("sketch").alias("fingerprint"),
        F.base64("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", "cells_edited", "cells_next",
    )


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
