"""Exact deduplication by Grace hashing: buckets small enough for a table that compares contents.

Texts are equal when they agree after white space is removed. The work has three steps:

1. Every task puts the texts of one block into an open-addressing table. A text met again in the
   block becomes a reference to the first one, so a group of copies leaves a task as one entry with
   its best row and its size, however large the group is.
2. Entries are dealt into spill files: buckets named by the leading bits of the content hash. A
   bucket whose entries exceed the byte limit is split on the next bits, again and again, until it
   fits or holds one hash only. Each bucket goes through a table of its own that compares complete
   contents; only distinct contents stay in memory, so a bucket of one hash fits as well.
3. Rows find their group through their entry. An entry covers the rows of one block at most, hence
   no join key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import blocks, documents, durable, matching_rows, query, text_bytes

BUCKET_BYTES = 32 << 20
#: Distinct content of one bucket's table.
BLOCK_BYTES = 16 << 20
#: Texts that a task puts into one table before the shuffle.
LEVEL_BITS = 4
#: Bits by which an oversized bucket is split.
WHITE = b" \t\n\x0b\x0c\r"

ROWS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sha", pa.binary()), ("entry", pa.int64()),
    ("size", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()),
    ("n_bytes", pa.int64()), ("content", pa.binary()),
])
ROWS_DDL = "row long, doc_id long, text_hash long, sha binary, entry long, size long, best_chars long, best_id long, best_row long, n_bytes long, content binary"
GROUPED = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
GROUPED_DDL = "entry long, keep_id long, keep_row long, group_size long"


class ContentTable:
    """Open addressing with linear probing. A slot holds the index of a content; a probe compares
    the hash first and then the complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def place(self, code: int, content: bytes) -> tuple[int, bool]:
        """Index of the content and whether it is new."""
        mask = len(self.slots) - 1
        at = code & mask
        while (held := self.slots[at]) >= 0:
            if self.hashes[held] == code and self.contents[held] == content:
                return held, False
            at = (at + 1) & mask
        index = self.slots[at] = len(self.contents)
        self.hashes.append(code)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return index, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for index, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = index


def rank(chars: int, doc: int | None, row: int) -> tuple:
    """The smallest stays: most code points, then the smallest id (null last), then the first row."""
    return (-chars, doc is None, doc or 0, row)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, the first of each content with the content and the block's best row."""
    next_row = TaskContext.get().partitionId() << 40  # the same again if the task runs again
    for block in blocks(batches, "text", BLOCK_BYTES):
        ids, hashes = block.column(0).to_pylist(), block.column(2)
        lengths = pa.compute.fill_null(pa.compute.utf8_length(block.column(1)), 0).to_pylist()
        table, first, best, sizes, of, shas = ContentTable(), [], [], [], [], []
        for at, text in enumerate(text_bytes(block.column(1))):
            content = text.translate(None, WHITE)
            sha = hashlib.sha256(content).digest()
            index, new = table.place(int.from_bytes(sha[:8], "big"), content)
            mine = rank(lengths[at], ids[at], next_row + at)
            if new:
                first.append(at), best.append(mine), sizes.append(0), shas.append(sha)
            elif mine < best[index]:
                best[index] = mine
            sizes[index] += 1
            of.append(index)
        rows = np.arange(next_row, next_row + len(ids))
        next_row += len(ids)
        index_at = dict(zip(first, range(len(first)), strict=True))
        held = [index_at.get(at) for at in range(len(ids))]
        only = lambda values: [None if i is None else values[i] for i in held]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows), pa.array(ids, pa.int64()), hashes.cast(pa.int64()), pa.array([shas[i] for i in of], pa.binary()),
                pa.array(rows[[first[i] for i in of]]), pa.array(only(sizes), pa.int64()),
                pa.array(only([-x[0] for x in best]), pa.int64()), pa.array(only([None if x[1] else x[2] for x in best]), pa.int64()),
                pa.array(only([x[3] for x in best]), pa.int64()), pa.array(only([len(x) for x in table.contents]), pa.int64()),
                pa.array(only(table.contents), pa.binary()),
            ],
            schema=ROWS,
        )


def _match_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: contents stream through the table, distinct ones stay in it."""
    table, best, sizes, of, entries = ContentTable(), [], [], [], []
    for batch in batches:
        names = ("entry", "sha", "content", "best_chars", "best_id", "best_row", "size")
        columns = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in names)
        for entry, sha, content, chars, doc, row, size in zip(*columns, strict=True):
            index, new = table.place(int.from_bytes(sha[:8], "big"), content)
            mine = rank(chars, doc, row)
            if new:
                best.append(mine), sizes.append(0)
            elif mine < best[index]:
                best[index] = mine
            sizes[index] += size
            of.append(index), entries.append(entry)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(entries, pa.int64()), pa.array([None if best[i][1] else best[i][2] for i in of], pa.int64()),
            pa.array([best[i][3] for i in of], pa.int64()), pa.array([sizes[i] for i in of], pa.int64()),
        ],
        schema=GROUPED,
    )


def spill_buckets(entries: DataFrame, limit: int) -> DataFrame:
    """Name each entry's bucket in ``bucket``: as many leading bits of its hash as make the bucket fit.

    Sizes are summed over the narrow columns. Oversized buckets are a short table (their number is
    at most all bytes / limit); the loop ends when there is none or hashes have no more bits."""
    code = F.conv(F.hex(F.substring("sha", 1, 7)), 16, 10).cast("long")  # 56 bits
    prefix = lambda bits: F.concat(F.lit(f"{bits}:"), F.shiftright(code, 56 - bits))
    total = entries.agg(F.sum("n_bytes")).first()[0] or 0
    bits = 0
    while (total >> bits) > limit and bits < 56:
        bits += LEVEL_BITS
    named = entries.withColumn("bucket", prefix(bits))
    while bits < 56:
        over = (
            named.groupBy("bucket")
            .agg(F.sum("n_bytes").alias("_bytes"), F.min("sha").alias("_low"), F.max("sha").alias("_high"))
            .filter((F.col("_bytes") > limit) & (F.col("_low") != F.col("_high")))
            .select("bucket", F.lit(True).alias("_over"))
        )
        over = durable(over, "op5-oversized")
        if over.isEmpty():
            break
        bits += LEVEL_BITS
        named = named.join(over, "bucket", "left").withColumn(
            "bucket", F.when(F.col("_over"), prefix(bits)).otherwise(F.col("bucket"))
        ).drop("_over")
    return named


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id,
    text_hash (xxhash64 of the original text), keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty and blank texts form one group. A null id loses to any other.
    Of rows that tie on length and id, one stays. An empty table gives no rows."""
    rows = durable(
        docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
        .mapInArrow(_entries, ROWS_DDL),
        "op5-rows",
    )
    entries = spill_buckets(rows.filter(F.col("content").isNotNull()), bucket_bytes)
    groups = (
        entries.select("bucket", "entry", "sha", "content", "best_chars", "best_id", "best_row", "size")
        .groupBy("bucket")
        .applyInArrow(_match_bucket, GROUPED_DDL)
    )
    return rows.select("row", "doc_id", "text_hash", "sha", "entry").join(groups, "entry").select(
        "doc_id",
        "text_hash",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs).filter("kept").select("doc_id", "text_hash")
    return matching_rows(docs, durable(kept, "op5-kept"))


@query("op5_exact_dedup", oracle=r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    r AS (
        SELECT doc_id, sha256(norm) AS text_sha256,
            first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY norm) AS group_size
        FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).drop("text_hash")
