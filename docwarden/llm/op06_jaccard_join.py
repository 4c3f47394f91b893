"""N-gram Jaccard join with signature trees.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``MIN_SHARED / 100``; the result is each document's component under links. Documents of equal sets
form a class and are handled as one from the start.

*Candidates.* A set of n shingles that links to another one misses at most ``n * (100 - MIN_SHARED) /
100`` of them there. Shingles whose hash lies below a fixed share of the hash space are published with
their class and counted; a class with more published shingles that no other class has than it may miss
has no partner. The others are brought together by prefix filtering: in the order (published first,
rarest first), two sets that link share one of their first ``misses + 1`` shingles. The classes that
have such a shingle in common meet under the smallest of them, the pivot; a pair of (pivot, class)
stands once, however many shingles lead to it. Very common passages come last in the order, so they
bring nobody together. None of this drops a link.

*Join.* The members under a pivot form a signature tree: leaves are documents, a node holds the OR of
its documents' token bitmaps and their range of sizes. The tree is joined with itself by dual
traversal, which leaves a pair of nodes when their sizes or the bits they share cannot give the
required overlap, or when all their documents are in one component already; pairs of documents that
remain are compared exactly. Only links that join two components are returned, so a group of copies
gives as many links as it has members. A pivot's members beyond ``BLOCK_MEMBERS`` or ``BLOCK_SHINGLES`` are dealt
into blocks that all hold the pivot; what a block does not connect to the pivot goes through all blocks of
that pivot in a second round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.llm.common import ASCII_LOWER, blocks, bound_batches, documents, durable, inside_table, joined, matching_rows, mix, query, span_hashes, spans, text_bytes
from docwarden.llm.components import connected_components

MIN_SHARED = 85
SHINGLE_WORDS = 4
PUBLISHED = np.uint64(int(0.4 * 2**64))
#: Shingles with a smaller hash are published and counted.
BUCKET_BYTES = 4 << 20
HELD_SHINGLES = 500_000
#: What a task gathers before it writes: 16 bytes each, and as much again four times while they are packed.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 400_000
#: A block's bounds; a larger document takes more than the second alone.
FANOUT = 8
BROADCAST_ROWS = 1_000_000
#: Representatives (24 bytes each) that are looked up by broadcast; more are looked up by a shuffle.

INSIDE = inside_table(b" \t\n\x0b\x0c\r")
_COMBINE = np.random.default_rng(4).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles. A text of fewer words than ``width`` has its
    whole sequence as the only shingle; a text without words has none."""
    data, begins = joined([text.translate(ASCII_LOWER) for text in texts], b" ")
    starts, ends = spans(data, INSIDE)
    hashes = span_hashes(data, starts, ends)
    edge = np.searchsorted(starts, begins)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - width + 1)
        rows = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            rows += mix(hashes[i : i + n] * _COMBINE[i])
        rows = mix(rows)
        out = []
        for first, last in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if last - first >= width:
                out.append(np.unique(rows[first : last - width + 1]))
            elif last > first:
                value = np.uint64(last - first)
                for i in range(last - first):
                    value = value + mix(hashes[first + i : first + i + 1] * _COMBINE[i])[0]
                out.append(mix(np.array([value], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def may_miss(n: int, min_shared: int) -> int:
    return n * (100 - min_shared) // 100


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def links(a: np.ndarray, b: np.ndarray, min_shared: int) -> bool:
    if 100 * min(len(a), len(b)) < min_shared * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= min_shared * (len(a) + len(b) - shared)


# ---------------------------------------------------------------- signature trees


class Components:
    """Labels of documents 0..n-1; joining two components relabels the smaller one."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members = [[i] for i in range(n)]

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []
        return True


class SignatureTree:
    """A bulk-loaded tree over a run of documents; level 0 has one node per document."""

    def __init__(self, order: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, surplus: np.ndarray) -> None:
        self.order = order
        self.levels = [(bitmaps[order], sizes[order], sizes[order], surplus[order])]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, more = self.levels[-1]
            cuts = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(more, cuts)))
        self.top = len(self.levels) - 1

    def documents(self, level: int, node: int) -> np.ndarray:
        size = FANOUT**level
        return self.order[node * size : (node + 1) * size]

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, min_shared: int) -> np.ndarray:
    """Which node pairs may hold a link. Shared tokens lie in shared bits; those beyond one a bit are
    at most the tokens a document has beyond its bits."""
    (xb, xl, xh, xs), (yb, yl, yh, ys) = x, y
    bits = np.bitwise_count(xb[i] & yb[j]).sum(axis=-1, dtype=np.int64)
    most = np.minimum(bits + np.minimum(xs[i], ys[j]), np.minimum(xh[i], yh[j]))
    least = np.maximum(xl[i], yl[j])
    return (100 * most >= min_shared * least) & (100 * xh[i] >= min_shared * yl[j]) & (100 * yh[j] >= min_shared * xl[i])


def dual_traversal(x: SignatureTree, y: SignatureTree, sets: list[np.ndarray], found: Components, min_shared: int) -> list[tuple[int, int]]:
    """Links between documents of two trees (or of one tree and itself) that join components."""
    out = []
    stack = [(x.top, 0, y.top, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        da, db = x.documents(la, a), y.documents(lb, b)
        first = found.label[da[0]]
        if (found.label[da] == first).all() and (found.label[db] == first).all():
            continue
        if la == 0 and lb == 0:
            if da[0] != db[0] and links(sets[da[0]], sets[db[0]], min_shared) and found.join(da[0], db[0]):
                out.append((int(da[0]), int(db[0])))
            continue
        ca = x.children(la, a) if la >= lb and la else [a]
        cb = y.children(lb, b) if lb >= la and lb else [b]
        na, nb = la - (len(ca) > 1 or (la >= lb and la > 0)), lb - (len(cb) > 1 or (lb >= la and lb > 0))
        pairs = [(i, j) for i in ca for j in cb if not (x is y and na == nb and i > j)]
        i, j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        good = possible(x.levels[na], i, y.levels[nb], j, min_shared)
        kept = [p for p, ok in zip(pairs, good.tolist(), strict=True) if ok]
        kept.sort(key=lambda p: x is y and p[0] == p[1])  # a node with itself comes off the stack first
        stack += [(na, i, nb, j) for i, j in kept]
    return out


class Signatures:
    """Bitmaps, sizes and an order in which similar documents are neighbours."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        width = 256
        while width < 2 * self.sizes.max(initial=0) and width < 4096:
            width *= 2
        self.bitmaps = np.zeros((len(sets), width // 64), dtype=np.uint64)
        for row, tokens in enumerate(sets):
            bit = tokens & np.uint64(width - 1)
            np.bitwise_or.at(self.bitmaps[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.surplus = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        self.least = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)

    def tree(self, rows: np.ndarray) -> SignatureTree:
        order = rows[np.lexsort((self.sizes[rows], self.least[rows]))]
        return SignatureTree(order, self.bitmaps, self.sizes, self.surplus)


# ---------------------------------------------------------------- tasks


def _describe(min_shared: int, width: int):
    names = ["doc_id", "text_hash", "n", "class", "published", "extra"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = shingle_sets(text_bytes(block.column(1)), width)
            counts, extra = [], []
            for tokens in sets:
                k = int(np.searchsorted(tokens, PUBLISHED))
                need = may_miss(len(tokens), min_shared) + 1 if len(tokens) else 0
                counts.append(k)
                extra.append(tokens[k : k + need - k].view(np.int64).tolist() if k < need else None)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(counts, pa.int64()), pa.array(extra, pa.list_(pa.int64()))],
                names=names,
            )

    return work


def _publish(n_buckets: int, width: int):
    """Published shingles and their classes, packed by bucket; a class met again in the task is left out."""

    def packed(tokens: list[np.ndarray], classes: list[np.ndarray]) -> pa.RecordBatch:
        token, owner = np.concatenate(tokens), np.concatenate(classes)
        bucket = (mix(token) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        present, cuts = np.unique(bucket[order], return_index=True)
        token, owner = np.split(token[order], cuts[1:]), np.split(owner[order], cuts[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(present), pa.array([t.tobytes() for t in token], pa.binary()), pa.array([c.tobytes() for c in owner], pa.binary())],
            names=["bucket", "tokens", "classes"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, classes, held = [], [], 0
        for block in blocks(batches, "text"):
            for values in shingle_sets(text_bytes(block.column(0)), width):
                name = class_of(values)
                k = int(np.searchsorted(values, PUBLISHED))
                if k and name not in seen:
                    seen.add(name)
                    tokens.append(values[:k]), classes.append(np.full(k, name, dtype=np.int64))
                    held += k
            if held > HELD_SHINGLES:
                yield packed(tokens, classes)
                tokens, classes, held = [], [], 0
        if held:
            yield packed(tokens, classes)

    return work


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a bucket that several classes have: a row for each class, with their number."""
    tokens, classes = [], []
    for batch in batches:
        tokens += [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
        classes += [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
    token, owner = np.concatenate(tokens), np.concatenate(classes)
    del tokens, classes
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    run = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
    many = np.repeat(np.diff(run) > 1, np.diff(run))  # most shingles stand alone: only the rest is sorted further
    token, owner = token[many], owner[many]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    _, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
    df = count[inverse]
    keep = df > 1
    yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(token[keep]), pa.array(df[keep])], names=["class", "token", "df"])


def _members(batches: Iterator[pa.RecordBatch], width: int) -> tuple[list[int], list[np.ndarray], list[int]]:
    """Distinct classes of a group with their sets and sides, the pivot first."""
    names, sets, sides, seen = [], [], [], set()
    for batch in batches:
        for block in blocks([batch], "text"):
            column = lambda name: block.column(block.schema.get_field_index(name))  # noqa: B023, E731
            for name, side, tokens in zip(column("class").to_pylist(), column("side").to_pylist(), shingle_sets(text_bytes(column("text")), width), strict=True):
                if (name, side) not in seen:
                    seen.add((name, side))
                    names.append(name), sets.append(tokens), sides.append(side)
    return names, sets, sides


def _linked(pairs: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[2] for p in pairs], pa.bool_())],
        names=["a", "b", "open"],
    )


def _join_block(min_shared: int, width: int):
    """Links within a block; of a pivot with several blocks also the members not connected to it."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = key[0].as_py()
        names, sets, sides = _members(batches, width)
        signed, found = Signatures(sets), Components(len(sets))
        everyone = signed.tree(np.arange(len(sets)))
        at = names.index(pivot)
        pairs = dual_traversal(signed.tree(np.array([at])), everyone, sets, found, min_shared)
        pairs += dual_traversal(everyone, everyone, sets, found, min_shared)
        out = [(names[a], names[b], False) for a, b in pairs]
        if sides[at] > 1:  # the pivot's number of blocks
            out += [(pivot, names[i], True) for i in np.flatnonzero(found.label != found.label[at]).tolist()]
        yield _linked(out)

    return work


def _join_open(min_shared: int, width: int):
    """Links between a block and members that are not connected to their pivot."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, sides = _members(batches, width)
        signed, found = Signatures(sets), Components(len(sets))
        side = np.array(sides)
        for i, name in enumerate(names):  # the same class on both sides is one document
            if sides[i] < 0 and name in names[:i]:
                found.join(i, names.index(name))
        mine, others = np.flatnonzero(side >= 0), np.flatnonzero(side < 0)
        pairs = dual_traversal(signed.tree(others), signed.tree(mine), sets, found, min_shared) if len(mine) and len(others) else []
        yield _linked([(names[a], names[b], False) for a, b in pairs])

    return work


# ---------------------------------------------------------------- the join


def _candidates(docs: DataFrame, described: DataFrame, min_shared: int, width: int) -> DataFrame:
    """(pivot, class, n): classes that share a prefix shingle with a smaller class, and the pivots."""
    total = described.agg(F.sum("published")).first()[0] or 0
    n_buckets = max(1, -(-total * 16 // BUCKET_BYTES))
    packed = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_publish(n_buckets, width), "bucket long, tokens binary, classes binary")
    counted = packed.groupBy("bucket").applyInArrow(_count, "class long, token long, df long")
    shared = counted.groupBy("class").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    classes = described.filter("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.max("published").alias("published"), F.max("extra").alias("extra"))
    misses = F.floor(F.col("n") * (100 - min_shared) / 100).cast("int")
    alone = F.col("published").cast("int") - F.coalesce(F.size("shared"), F.lit(0))
    prefix = F.transform(F.slice(F.array_sort(F.coalesce("shared", F.array().cast("array<struct<df:bigint,token:bigint>>"))), 1, misses + 1 - alone), lambda x: x["token"])
    postings = (
        classes.join(shared, "class", "left")
        .filter(alone <= misses)
        .select("class", "n", F.explode(F.concat(prefix, F.coalesce("extra", F.array().cast("array<bigint>")))).alias("token"))
    )
    postings = durable(postings, "op6-prefixes")
    pivots = postings.groupBy("token").agg(F.min("class").alias("pivot"), F.count("*").alias("owners")).filter("owners > 1").drop("owners")
    pairs = postings.join(pivots, "token").select("pivot", "class", "n").distinct()
    return durable(pairs, "op6-pairs")


def component_classes(docs: DataFrame, described: DataFrame, min_shared: int, width: int) -> DataFrame:
    """(node, root) over classes that link to another class."""
    pairs = _candidates(docs, described, min_shared, width)
    sizes = pairs.groupBy("pivot").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    )
    placed = pairs.join(sizes, "pivot").select(
        "pivot", "class", "n_blocks",
        F.explode(F.when(F.col("class") == F.col("pivot"), F.sequence(F.lit(0), F.col("n_blocks") - 1))
            .otherwise(F.array(F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int")))).alias("block"),
    )
    placed = durable(placed, "op6-blocks")
    reps = described.select("class", "doc_id", "text_hash").join(placed.select("class").distinct(), "class", "left_semi")
    reps = reps.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("class", "r.*")
    reps = durable(reps.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"}), "op6-representatives")
    known = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
    texts = docs.join(known, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).select("class", "text")
    texts = durable(texts, "op6-texts")
    schema = "a long, b long, open boolean"
    joined_ = placed.withColumn("side", F.col("n_blocks")).join(texts, "class")
    first = joined_.groupBy("pivot", "block").applyInArrow(_join_block(min_shared, width), schema)
    first = durable(first, "op6-links")
    found = first.filter("NOT open").select("a", "b")
    rest = durable(first.filter("open").select(F.col("a").alias("pivot"), F.col("b").alias("class")).distinct(), "op6-open")
    if not rest.isEmpty():
        parts = rest.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("n_parts"))
        rest = rest.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("class"), F.col("n_parts")).cast("int")).join(sizes, "pivot")
        ours = rest.select("pivot", "class", "part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(-1).alias("side"))
        theirs = placed.join(parts, "pivot").select("pivot", "class", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "block", F.lit(0).alias("side"))
        second = ours.unionByName(theirs).join(texts, "class").groupBy("pivot", "block", "part").applyInArrow(_join_open(min_shared, width), schema)
        found = found.unionByName(second.select("a", "b"))
    return connected_components(found)


def jaccard_components(docs: DataFrame, min_shared: int = MIN_SHARED, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``; other columns are ignored): doc_id, text_hash
    (xxhash64 of the original text), n_shingles, component_id, class (of equal sets), kept.

    ``component_id`` is the smallest doc_id reachable by links; it is null only where no document of
    the component has an id. A null or empty text, or one of white space, has no shingles and is linked
    with nothing. ``kept`` marks one row per component, that of the smallest id (null last). Rows that
    repeat an id and a text are one component, and all are marked alike. An empty table gives no rows."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    described = durable(
        docs.mapInArrow(_describe(min_shared, width), "doc_id long, text_hash long, n long, class long, published long, extra array<long>"), "op6-described"
    )
    roots = component_classes(docs, described, min_shared, width)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    classes = described.filter("n > 0").groupBy("class").agg(F.min(place).alias("least"))
    named = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    tops = named.groupBy("root").agg(F.min("least").alias("top"))
    tops = durable(named.select("class", "root").join(tops, "root").select("class", "top"), "op6-components")
    answered = described.filter("n > 0").join(tops, "class").withColumn("kept", place == F.col("top"))
    lone = described.filter("n = 0").withColumns({"top": place, "kept": F.lit(True)})
    return answered.unionByName(lone, allowMissingColumns=True).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("top.doc_id").alias("component_id"), "class", "kept"
    )


def drop_near_duplicates(docs: DataFrame, min_shared: int = MIN_SHARED, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component, with all columns."""
    kept = jaccard_components(docs, min_shared, width).filter("kept").select("doc_id", "text_hash")
    return matching_rows(docs, durable(kept, "op6-kept"))


@query("op6_jaccard_join", oracle=r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS MATERIALIZED (
        SELECT doc_id, unnest(CASE WHEN len(words) >= 4
            THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    d AS MATERIALIZED (SELECT * FROM s WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM d a JOIN d b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    r AS (SELECT doc_id, doc_id AS near FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.near = l.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
