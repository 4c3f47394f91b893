"""Token ids in binary shards, with a minimal perfect hash index from document keys to their places.

*Shards.* Documents are range partitioned and sorted by id; a task encodes its documents in blocks and
writes files of at most ``SHARD_BYTES`` of ids or ``SHARD_DOCS`` documents (or of one document). A file is
a header, the raw ids (little-endian, two bytes each if the vocabulary allows it, else four) and a table
of its documents' keys and offsets. The tokenizers library encodes each distinct word of a worker once:
its pre-tokenizer never joins what ASCII white space separates, nor a mark of ``.,;:!?`` at a word's end
with the letter or digit before it. Words are told apart by 64-bit hashes.

*Index.* Keys are dealt into buckets of about ``BUCKET_KEYS`` by hash. In a bucket, each level hashes the
remaining keys into twice as many bits; a key alone on its bit is settled there and the others go on to
the next level. A key's slot is the number of set bits before its own, so n keys have the slots 0 to n -
1. A slot holds a 32-bit fingerprint of its key, the shard, the offset, the number of ids and the number
of ids before it in the whole store. A lookup computes a few hashes, whatever the size; a foreign key
passes the fingerprint with a chance of 2^-32.

*Reading.* Keys become places by the index, and the files are read where they lie: only what is asked of a
record (its checksum, or its ids) meets its place in a join, and payloads are not moved for that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import ASCII_LOWER, blocks, documents, durable, inside_table, joined, mix, query, shared_path, span_hashes, spans, text_bytes

SHARD_BYTES = 4 << 20
SHARD_DOCS = 1 << 16
BUCKET_KEYS = 1 << 15
KNOWN_WORDS = 1_000_000
#: Encoded words a worker remembers (about 40 bytes each); beyond it the memory starts anew.
LEVELS = 48
END_ID = 2

INSIDE = inside_table(b" \t\n\x0b\x0c\r")
MARKS = ~inside_table(b".,;:!?")
ALNUM = ~inside_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- encoding


class WordCache:
    """Ids of words, by hash, in sorted arrays; new words go to the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.begins = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=f"<u{self.width}")

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words whose sorted hashes are not known yet."""
        coded = []
        for at in range(0, len(words), 4096):
            coded += [e.ids for e in self.model.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
        counts = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        begins = len(self.ids) + np.cumsum(counts) - counts
        flat = np.fromiter((i for ids in coded for i in ids), dtype=self.ids.dtype, count=int(counts.sum()))
        places = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, places, hashes)
        self.begins = np.insert(self.begins, places, begins)
        self.counts = np.insert(self.counts, places, counts)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has."""
        lowered = [t if b"<|" in t else t.translate(ASCII_LOWER) for t in texts]  # special tokens are told by case
        data, edges = joined(lowered, b" ")
        starts, ends = spans(data, INSIDE)
        cut = (ends - starts > 1) & MARKS[data[ends - 1]] & ALNUM[data[ends - 2]] if len(ends) else np.zeros(0, dtype=bool)
        last = np.cumsum(1 + cut) - 1  # the mark of a cut word, else the word
        words = np.empty((len(starts) + int(cut.sum()), 2), dtype=np.int64)
        words[last, 0], words[last, 1] = np.where(cut, ends - 1, starts), ends
        words[last[cut] - 1, 0], words[last[cut] - 1, 1] = starts[cut], ends[cut] - 1
        hashes, first, inverse = np.unique(span_hashes(data, words[:, 0], words[:, 1]), return_index=True, return_inverse=True)
        if len(self.hashes) > KNOWN_WORDS:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            raw = data.tobytes()
            self.learn(hashes[new], [raw[a:b].decode() for a, b in words[first[new]].tolist()])
            at = np.searchsorted(self.hashes, hashes)
        begins, counts = self.begins[at][inverse], self.counts[at][inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(begins - total[:-1], counts) + np.arange(total[-1])]
        return flat, np.diff(total[np.searchsorted(words[:, 0], edges)])


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- shard files

MAGIC = b"IDSHARD1"
HEADER = struct.Struct(">IIIIQQ")
#: Task, number within the task, bytes of an id, documents, ids, ids before it in the task.


@dataclass
class Shard:
    part: int
    seq: int
    before: int
    ids: np.ndarray
    keys: np.ndarray
    null: np.ndarray
    times: np.ndarray
    ends: np.ndarray  # of each document, in ids


def pack_shard(shard: Shard) -> bytes:
    header = HEADER.pack(shard.part, shard.seq, shard.ids.dtype.itemsize, len(shard.keys), len(shard.ids), shard.before)
    table = [shard.ids.tobytes(), shard.keys.astype("<i8").tobytes(), shard.times.astype("<i8").tobytes(), shard.ends.astype("<i8").tobytes(), shard.null.astype("u1").tobytes()]
    return b"".join([MAGIC, header, *table])


def read_shard(data: bytes) -> Shard:
    if data[:8] != MAGIC:
        raise ValueError("no shard of token ids")
    part, seq, width, docs, n, before = HEADER.unpack_from(data, 8)
    at = 8 + HEADER.size
    if len(data) < at + n * width + docs * 25:
        raise ValueError("the shard ends early")
    take = lambda kind, size, count: np.frombuffer(data, dtype=kind, count=count, offset=size)
    table = at + n * width
    return Shard(part, seq, before, take(f"<u{width}", at, n), take("<i8", table, docs), take("u1", table + 24 * docs, docs), take("<i8", table + 8 * docs, docs), take("<i8", table + 16 * docs, docs))


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[bytes]:
    model, part = word_cache(path), TaskContext.get().partitionId()
    seq = before = held = 0
    ids, keys, null, sizes, times = [], [], [], [], []
    last, seen = object(), 0

    def shard() -> bytes:
        lengths = np.array(sizes, dtype=np.int64)
        return pack_shard(Shard(part, seq, before, np.concatenate(ids), np.array(keys), np.array(null), np.array(times), np.cumsum(lengths)))

    for block in blocks(batches, "text", 2 << 20):
        flat, counts = model.encode(text_bytes(block.column(1)))
        if end_id is not None:
            flat, counts = np.insert(flat, np.cumsum(counts), end_id), counts + 1
        at = 0
        for key, n in zip(block.column(0).to_pylist(), counts.tolist(), strict=True):
            if keys and ((held + n) * flat.itemsize > SHARD_BYTES or len(keys) >= SHARD_DOCS):
                yield shard()
                seq, before, held = seq + 1, before + held, 0
                ids, keys, null, sizes, times = [], [], [], [], []
            seen = seen + 1 if key == last else 0
            last = key
            ids.append(flat[at : at + n]), keys.append(key or 0), null.append(key is None), sizes.append(n), times.append(seen)
            at, held = at + n, held + n
    if keys:
        yield shard()


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID) -> None:
    """Encode every row of ``docs`` (doc_id, text; other columns are ignored) into files of ``folder``,
    in ascending order of ids. A null text is empty; a null id comes first; rows that repeat an id are
    stored each, ordered by a hash of their text. An empty table gives no records."""
    named = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _shards(batches, named, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # The last two keys let a repeated id, however hot, lie in several tasks.
    chosen = chosen.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "mark", "row"]
    ordered = chosen.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = ordered.mapInArrow(work, "value binary").select(F.col("value").cast("string"))
    files.write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "content")


def _records(files: DataFrame, per_record: Callable[[Shard], pa.Array], kind: str) -> DataFrame:
    """One row per stored record: its place and what ``per_record`` makes of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = read_shard(batch.column(1)[i].as_py())
                size = len(shard.keys)
                begins = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                columns = [
                    pa.array(np.full(size, shard.part, dtype=np.int32)), pa.array(np.full(size, shard.seq, dtype=np.int32)),
                    pa.array(begins), per_record(shard),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "offset", "value"])

    return files.mapInArrow(work, f"part int, seq int, offset long, value {kind}")


def _described(shard: Shard) -> pa.Array:
    begins = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
    fields = {
        "doc_id": pa.array(shard.keys, mask=shard.null.astype(bool)), "times": pa.array(shard.times),
        "n": pa.array(shard.ends - begins), "before": pa.array(shard.before + begins),
    }
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


# ---------------------------------------------------------------- minimal perfect hash

SLOT = np.dtype([("mark", "<u4"), ("part", "<u4"), ("seq", "<u4"), ("offset", "<u8"), ("n", "<u8"), ("start", "<u8")])


def _position(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(one + np.uint64(level + 1) * (two | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def fingerprint(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (mix(one ^ mix(two)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Levels of bits; a key's slot is the rank of its bit over all levels."""

    levels: list[np.ndarray]
    left: np.ndarray  # keys no level could settle, as (one, two) rows; none in practice

    @staticmethod
    def build(one: np.ndarray, two: np.ndarray) -> PerfectHash:
        levels = []
        while len(one) and len(levels) < LEVELS:
            size = 2 * len(one) + 8
            at = _position(one, two, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            one, two = one[~alone[at]], two[~alone[at]]
        left = np.stack([one, two], axis=1) if len(one) else np.zeros((0, 2), dtype=np.uint64)
        if len(np.unique(left, axis=0)) < len(left):
            raise ValueError("two keys share both 64-bit hashes")
        return PerfectHash(levels, left)

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, some slot or -1."""
        out = np.full(len(one), -1, dtype=np.int64)
        open_, base = np.arange(len(one)), 0
        for level, bits in enumerate(self.levels):
            at = _position(one[open_], two[open_], level, len(bits))
            ranks = np.cumsum(bits) - 1
            hit = bits[at]
            out[open_[hit]] = base + ranks[at[hit]]
            open_, base = open_[~hit], base + int(bits.sum())
        for i, (a, b) in enumerate(self.left):
            out[open_[(one[open_] == a) & (two[open_] == b)]] = base + i
        return out

    def pack(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.left))
        return b"".join([head, struct.pack(f"<{len(self.levels)}I", *map(len, self.levels)), *(np.packbits(b).tobytes() for b in self.levels), self.left.astype("<u8").tobytes()])

    @staticmethod
    def unpack(data: bytes) -> tuple[PerfectHash, int]:
        """The function, and the byte after it."""
        n, left = struct.unpack_from("<II", data)
        sizes, at, levels = struct.unpack_from(f"<{n}I", data, 8), 8 + 4 * n, []
        for size in sizes:
            packed = np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8, offset=at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        rest = np.frombuffer(data, dtype="<u8", count=2 * left, offset=at).reshape(left, 2)
        return PerfectHash(levels, rest), at + 16 * left


def _u64(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _build_bucket(table: pa.Table) -> pa.Table:
    one, two = _u64(table["one"]), _u64(table["two"])
    function = PerfectHash.build(one, two)
    slots = np.zeros(len(one), dtype=SLOT)
    at = function.slots(one, two)
    slots["mark"][at] = fingerprint(one, two)
    for name in ("part", "seq", "offset", "n", "start"):
        slots[name][at] = table[name].to_numpy()
    data = function.pack() + slots.tobytes()
    return pa.table({"bucket": table["bucket"].slice(0, 1), "index": pa.array([data], pa.binary())})


def _found(index: bytes, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots' contents of the keys, and which keys they belong to."""
    function, at = PerfectHash.unpack(index)
    slots = np.frombuffer(index, dtype=SLOT, offset=at)
    place = function.slots(one, two)
    taken = slots[np.maximum(place, 0)] if len(slots) else np.zeros(len(one), dtype=SLOT)
    return taken, (place >= 0) & (taken["mark"] == fingerprint(one, two)) & (len(slots) > 0)


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    taken, known = np.zeros(keys.num_rows, dtype=SLOT), np.zeros(keys.num_rows, dtype=bool)
    if index.num_rows and keys.num_rows:
        taken, known = _found(index["index"][0].as_py(), _u64(keys["one"]), _u64(keys["two"]))
    kinds = {"part": np.int32, "seq": np.int32, "offset": np.int64, "n": np.int64, "start": np.int64}
    out = {"doc_id": keys["doc_id"], "times": keys["times"]}
    return pa.table(out | {name: pa.array(taken[name].astype(kind)) for name, kind in kinds.items()}).filter(pa.array(known))


PLACE = "doc_id long, times long, part int, seq int, offset long, n long, start long"


@dataclass
class IdStore:
    """A folder of shards and its index (bucket, index), a written table of ``buckets`` rows."""

    folder: str
    index: DataFrame
    buckets: int

    def _hashed(self, keys: DataFrame) -> DataFrame:
        """Keys (doc_id, times) with the two hashes and the bucket."""
        parts = [F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), F.col("times")]
        one, two = F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
        return keys.withColumns({"one": one, "two": two, "bucket": F.pmod(F.xxhash64(F.lit("bucket"), *parts), F.lit(self.buckets))})

    def places(self, keys: DataFrame) -> DataFrame:
        """Where the records of distinct ``keys`` (doc_id long, times long) lie: PLACE. ``times`` counts the
        rows of one id from 0. Keys that are not stored have no row."""
        return self._hashed(keys).groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(_look_up, PLACE)

    def fetch(self, keys: DataFrame, per_record: Callable[[Shard], pa.Array], kind: str) -> DataFrame:
        """The places of ``keys`` with ``value``: what ``per_record`` makes of a shard's records, in order."""
        read = _records(_files(self.index.sparkSession, self.folder), per_record, kind)
        return self.places(keys).join(read, ["part", "seq", "offset"])

    def ids_of(self, keys: DataFrame) -> DataFrame:
        """doc_id, times, start and ``ids`` (array of int) of each stored key."""
        return self.fetch(keys, _ids, "array<int>").select("doc_id", "times", "start", F.col("value").alias("ids"))


def _ids(shard: Shard) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], shard.ends]).astype(np.int32)), pa.array(shard.ids.astype(np.int32)))


def _checksums(shard: Shard) -> pa.Array:
    ids, at, out = shard.ids.astype("<u4"), 0, []
    for end in shard.ends.tolist():
        out.append(zlib.crc32(ids[at:end]))
        at = end
    return pa.array(out, pa.int64())


def build_index(spark: SparkSession, folder: str) -> IdStore:
    """Index every record of the shards below ``folder``. The driver sees one row per writing task."""
    records = durable(_records(_files(spark, folder), _described, "struct<doc_id:long,times:long,n:long,before:long>").select("part", "seq", "offset", "value.*"), "op12-records")
    place = F.struct("seq", "offset")
    parts = records.groupBy("part").agg(
        F.sum("n").alias("n"), F.count("*").alias("rows"), F.min_by("doc_id", place).alias("first"),
        F.max_by("doc_id", place).alias("last"), F.max_by("times", place).alias("times"),
    ).orderBy("part").collect()
    bases, base, carry, before = [], 0, 0, None
    for p in parts:
        # An id may go on from one task's documents to the next one's.
        carry = (before.times + 1 + (carry if before.first == before.last else 0)) if before is not None and before.last == p["first"] else 0
        bases.append((p.part, base, carry, p["first"]))
        base, before = base + p.n, p
    named = spark.createDataFrame(bases, "part int, base long, carry long, first long")
    buckets = max(1, -(-sum(p.rows for p in parts) // BUCKET_KEYS))
    store = IdStore(folder, records, buckets)
    times = F.col("times") + F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("carry")).otherwise(0)
    keyed = records.join(named, "part").select("part", "seq", "offset", "n", "doc_id", times.alias("times"), (F.col("base") + F.col("before")).alias("start"))
    index = store._hashed(keyed).drop("doc_id", "times").groupBy("bucket").applyInArrow(_build_bucket, "bucket long, index binary")
    store.index = durable(index, "op12-index")
    return store


def store_ids(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int | None = END_ID) -> IdStore:
    """Write ``docs`` (doc_id, text; other columns are ignored) to shards and index them."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "op12-shards")
    write_shards(docs, folder, path, end_id)
    return build_index(spark, folder)


def all_keys(docs: DataFrame) -> DataFrame:
    """Every row's key: its id, and how many rows of that id come before it."""
    counts = docs.select(F.col("doc_id").cast("long")).groupBy("doc_id").count()
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("times"))


def id_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store ``docs``, then read every document back by its key: doc_id, start, n_tokens, ids_crc32 (of
    the ids as little-endian unsigned 32-bit integers). Null and empty texts have the end id alone;
    rows that repeat an id are answered each; an empty table gives no rows."""
    read = store_ids(docs, path=path).fetch(all_keys(docs), _checksums, "long")
    return read.select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("value").alias("ids_crc32"))


@query("op12_id_store")
def op12_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(documents(spark, sf_dir))
