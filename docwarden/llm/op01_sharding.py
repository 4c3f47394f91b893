"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the document's id. A bucket that holds more
bytes than a shard may is split on its next bit, and only such a bucket; the others keep their short
prefix. A shard is thus the shortest prefix of a document's hash whose documents fit.

All splits of a range of depths are decided from one histogram of the deepest prefixes of the range,
whose rows number about 16 times the shards: it is folded to every shorter prefix, and each deepest
prefix takes the shallowest ancestor that fits. Prefixes of which none fits go through the next range.
Documents that share all hash bits (a repeated or missing id) are told apart by a second hash, of
their row; a document larger than a shard gets a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.llm.common import documents, durable, free_name, query

SHARD_BYTES = 4 << 20
RECORD_BYTES = 16
#: What a record takes besides its text: id and length. It bounds the rows of a shard, too.
HASH_BITS = 60
RANGE_BITS = 8
#: Depths that a further range adds.


def hash_bits(key: Column) -> Column:
    """The leading 60 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _prefix(code: Column, depth: Column | int) -> Column:
    bits = F.lit(HASH_BITS) - (F.lit(depth) if isinstance(depth, int) else depth)
    return F.when(bits >= HASH_BITS, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", code, bits.cast("int")))


def split_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (``parent``, ``code``, ``n_bytes`` and more) with ``depth`` and ``prefix`` of their shard
    below ``parent``: the shallowest prefix that fits, or that one code fills alone."""
    most = rows.groupBy("parent").agg(F.sum("n_bytes").alias("n")).agg(F.max("n")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(1, most // limit).bit_length() + 4)
    open_rows, done = rows, []
    while True:
        fine = open_rows.groupBy("parent", _prefix(F.col("code"), high).alias("fine")).agg(
            F.sum("n_bytes").alias("n"), F.min("code").alias("least"), F.max("code").alias("most")
        )
        fine = durable(fine, "op1-histogram")
        nodes = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
            "prefix", F.call_function("shiftright", F.col("fine"), (F.lit(high) - F.col("depth")).cast("int"))
        )
        sums = (
            nodes.groupBy("parent", "depth", "prefix")
            .agg(F.sum("n").alias("total"), F.min("least").alias("low"), F.max("most").alias("top"))
            .filter((F.col("total") <= limit) | (F.col("low") == F.col("top")))
        )
        leaves = nodes.join(sums, ["parent", "depth", "prefix"]).groupBy("parent", "fine").agg(F.min("depth").alias("depth"))
        leaves = durable(fine.select("parent", "fine").join(leaves, ["parent", "fine"], "left"), "op1-directory")
        placed = open_rows.withColumn("fine", _prefix(F.col("code"), high)).join(leaves, ["parent", "fine"])
        found = placed.filter("depth IS NOT NULL")
        done.append(found.withColumn("prefix", _prefix(F.col("code"), F.col("depth"))).drop("fine"))
        if high >= HASH_BITS or leaves.filter("depth IS NULL").isEmpty():
            break
        open_rows = durable(placed.filter("depth IS NULL").drop("fine", "depth"), "op1-open")
        low, high = high + 1, min(HASH_BITS, high + RANGE_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id, n_bytes,
    shard_id (``depth:prefix``, and ``/depth:prefix`` of the second hash where the first is used up),
    depth, shard_bytes, shard_rows.

    A null text has no bytes besides the record's own, a null id hashes as an empty one. Rows that
    repeat an id may part. ``shard_bytes`` exceeds ``limit`` only where ``shard_rows`` is 1. An empty
    table gives no rows."""
    rows = durable(_records(docs["doc_id"], docs["text"], docs, F.monotonically_increasing_id()), "op1-rows")
    first = _place_records(rows, limit)
    sizes = first.groupBy("shard_id").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return first.join(sizes, "shard_id").select("doc_id", "n_bytes", "shard_id", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def _records(doc_id: Column, text: Column, held: DataFrame, row: Column) -> DataFrame:
    return held.select(
        doc_id.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("n_bytes"),
        hash_bits(doc_id).alias("code"),
        row.alias("row"),
        F.lit("").alias("parent"),
    )


def _place_records(rows: DataFrame, limit: int) -> DataFrame:
    """Written records (``row`` tells them apart) with the ``shard_id`` and ``depth`` of their shard."""
    first = split_buckets(rows, limit).withColumn("shard_id", F.concat_ws(":", "depth", "prefix"))
    first = durable(first.drop("parent", "prefix"), "op1-shards")
    sizes = first.groupBy("shard_id").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("k"))
    full = durable(sizes.filter((F.col("n") > limit) & (F.col("k") > 1)).select("shard_id"), "op1-full")
    if not full.isEmpty():
        again = first.join(full, "shard_id", "left_semi").withColumns({"parent": F.col("shard_id"), "code": hash_bits(F.col("row"))})
        again = split_buckets(again.drop("depth"), limit).withColumn("shard_id", F.concat("parent", F.lit("/"), F.concat_ws(":", "depth", "prefix")))
        again = again.withColumn("depth", F.col("depth") + HASH_BITS).drop("parent", "prefix")
        first = durable(first.join(full, "shard_id", "left_anti").unionByName(again), "op1-all-shards")
    return first


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write ``docs``, with all columns, as one folder ``_shard=...`` per shard (with more underscores
    where ``docs`` has such a column). Every row is written once, whatever its id: rows are written
    with a number first, and shards are joined by that. A null id hashes as an empty one, a null text
    has no bytes; an empty table gives no folders."""
    shard = free_name(docs, "_shard")
    record = F.struct(*[docs[c] for c in docs.columns])
    held = durable(docs.select(F.monotonically_increasing_id().alias("row"), record.alias("record")), "op1-records")
    rows = durable(_records(held["record"]["doc_id"], held["record"]["text"], held, held["row"]), "op1-rows")
    shards = _place_records(rows, limit).select("row", F.col("shard_id").alias("shard"))
    placed = held.join(shards, "row").select("record.*", F.col("shard").alias(shard))
    placed.repartition(shard).write.partitionBy(shard).parquet(path)


@query("op1_sharding", oracle=f"""
    WITH d AS (
        SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {RECORD_BYTES} AS n_bytes,
            ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT AS code FROM documents),
    n AS (SELECT *, code >> ({HASH_BITS} - depth)::INT AS prefix FROM d, range(0, {HASH_BITS + 1}) AS r(depth)),
    s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM n GROUP BY depth, prefix),
    f AS (SELECT doc_id, min(depth) AS depth FROM n JOIN s USING (depth, prefix)
        WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY doc_id)
    SELECT doc_id, n_bytes, depth || ':' || prefix AS shard_id, depth::INT AS depth, shard_bytes, shard_rows
    FROM n JOIN f USING (doc_id, depth) JOIN s USING (depth, prefix)
""")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))
