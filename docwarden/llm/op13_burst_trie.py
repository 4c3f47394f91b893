"""Prefix trie of conversations, built as a burst trie.

Turns become ids (a digest of role and text), and conversations that are equal in every turn one
*sequence* with its members counted, so copies, however many, are one entry of the trie.

*Bursting.* All sequences start in one container under the root. A container of more than
``CONTAINER`` sequences bursts: the longest common prefix of its smallest and largest sequence is a path
without branches, at whose end the sequences are dealt into containers by their next turn id. A round
bursts every oversized container at once, and its counts are combined before the shuffle; there are as
many rounds as such branchings lie above each other, whatever the lengths.

*Sweeping.* The containers that remain are sorted by Spark and swept, each in one task, into nodes with
the sums of their subtrees. What the tops of containers hold is then added up the burst paths, round by
round. Texts are read once, for digests and word counts; only 32-character ids are shuffled. One
conversation's turns are one row, as one document's text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwarden.llm.common import durable, query

CONTAINER = 256
#: Sequences in a container that is swept by one task.
ENDS_IN_PIECE = 4096
FAMILY, BORROWED = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string"
)


# ---------------------------------------------------------------- sequences


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ``ids`` and ``words`` of its turns, ordered by turn (null first)
    and, where turns share a number, by their digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"),
    )
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), turn.alias("at"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return turns.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.n").alias("words"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its family. At most
    FAMILY rows meet one row of BORROWED - 1 turns."""
    heads = sequences.filter(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(
        F.col("conv_id").alias("first"), F.slice("ids", 1, BORROWED - 1).alias("head"), F.slice("words", 1, BORROWED - 1).alias("head_words")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(BORROWED)).cast("int")
    met = sequences.withColumns({"h": h, "first": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))}).join(heads, "first", "left")

    def spliced(head: str, own: str, kind: str) -> Column:
        borrowed = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(f"array<{kind}>"))
        rest = F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        return F.concat(borrowed, rest)

    return met.select("conv_id", spliced("head", "ids", "string").alias("ids"), spliced("head_words", "words", "long").alias("words"))


def _rows(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence's sorted members as text."""
    kinds = pa.schema([("sequence", pa.string()), ("first", pa.int64()), ("text", pa.string())])
    name, held, out = None, [], []
    for batch in batches:
        for key, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (key != name or len(held) >= ENDS_IN_PIECE):
                out.append((name, held[0], ",".join(map(str, held))))
                held = []
            name = key
            held.append(member)
        if out:
            yield _rows(out, kinds)
            out = []
    if held:
        yield _rows([(name, held[0], ",".join(map(str, held)))], kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's pieces, in order and comma-joined; only the digest's state is held."""
    kinds = pa.schema([("sequence", pa.string()), ("ends", pa.string())])
    name, state, out = None, None, []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == name:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                out.append((name, state.hexdigest()))
            name, state = key, hashlib.sha256(text.encode())
        if out:
            yield _rows(out, kinds)
            out = []
    if state is not None:
        yield _rows([(name, state.hexdigest())], kinds)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Equal sequences as one row: ids, words, n (members), least (smallest member), ends (digest of all
    members). A sequence's members are sorted by range, so that many copies cover many tasks; what one
    task then reads of them is a row for every ENDS_IN_PIECE."""
    named = durable(convs.withColumn("sequence", F.md5(F.array_join("ids", ""))), "op13-rebuilt")
    groups = named.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    members = named.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    pieces = members.mapInArrow(_pieces, "sequence string, first long, text string")
    ends = pieces.repartition("sequence").sortWithinPartitions("sequence", "first").mapInArrow(_digests, "sequence string, ends string")
    whole = named.join(groups, [named["sequence"] == groups["sequence"], named["conv_id"] == groups["least"]]).drop(groups["sequence"])
    return whole.join(ends, "sequence").select("ids", "words", "n", "least", "ends")


# ---------------------------------------------------------------- bursting


@dataclass
class Burst:
    """What the rounds of bursting leave: one table of paths a round, and settled containers."""

    paths: list[DataFrame] = field(default_factory=list)  # of each round
    settled: list[DataFrame] = field(default_factory=list)


def _common(a: str, b: str) -> Column:
    """Number of leading elements that two sorted-out sequences share."""
    same = F.zip_with(F.col(a), F.col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def under_root(sequences: DataFrame) -> DataFrame:
    root = {"above": F.lit(None).cast("string"), "above_least": F.lit(None).cast("long"), "start": F.lit(0).cast("long"), "turn": F.lit("")}
    return sequences.withColumns(root)


def burst(sequences: DataFrame, container: int = CONTAINER) -> Burst:
    """Burst containers by next turn id until none holds more than ``container`` sequences. ``sequences``
    all have the root's ``above``, ``above_least``, ``start`` and ``turn``, as :func:`under_root` adds them.

    A path (one per burst container): ``path`` (digest of its prefix), ``above`` (the path it hangs on,
    null for the root's), ``from_depth`` to ``depth`` (its nodes), ``words`` of those nodes, n, least, ends (of
    a sequence that ends there), n_children, above_least. A settled row: a sequence with its container
    (``above``, next turn id ``turn``), the depth ``start`` of the container's top and above_least."""
    out = Burst()
    open_ = sequences
    while True:
        heads = open_.groupBy("above", "turn").agg(
            F.count("*").alias("rows"), F.min("ids").alias("low"), F.max("ids").alias("high"),
            F.sum("n").alias("total"), F.min("least").alias("head_least"), F.min("above_least").alias("head_above_least"), F.min("start").alias("from_depth"),
        )
        if out.paths:
            heads = heads.filter(F.col("rows") > container)
        heads = heads.withColumn("depth", _common("low", "high"))
        heads = heads.withColumn("path", F.md5(F.concat(F.array_join(F.slice("low", F.lit(1), F.col("depth").cast("int")), ""), F.col("depth").cast("string"))))
        number = len(out.paths)
        heads = durable(heads.drop("rows", "low", "high"), f"op13-heads-{number}")
        if heads.isEmpty():
            out.settled.append(open_)
            return out
        met = open_.join(
            heads.withColumnRenamed("above", "of").withColumnRenamed("turn", "by"),
            F.col("above").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("by")), "left",
        )
        met = durable(met.drop("of", "by"), f"op13-open-{number}")
        columns = open_.columns
        out.settled.append(met.filter("path IS NULL").select(columns))
        inside = met.filter("path IS NOT NULL")
        ended = inside.filter(F.size("ids") == F.col("depth")).select("path", "ends")
        open_ = inside.filter(F.size("ids") > F.col("depth")).select(
            "ids", "words", "n", "least", "ends", F.col("path").alias("above"), F.col("head_least").alias("above_least"),
            (F.col("depth") + 1).alias("start"), F.get("ids", F.col("depth").cast("int")).alias("turn"),
        ).select(columns)
        children = open_.groupBy("above", "turn").count().groupBy("above").agg(F.count("*").alias("n_children"))
        # Every sequence of a container has the path's words; one is enough.
        one = inside.filter(F.col("least") == F.col("head_least")).select(
            "path", F.slice("words", F.greatest(F.col("from_depth"), F.lit(1)).cast("int"), (F.col("depth") - F.greatest(F.col("from_depth"), F.lit(1)) + 1).cast("int")).alias("words")
        )
        paths = heads.select(
            "path", "above", "from_depth", "depth", F.col("total").alias("n"), F.col("head_least").alias("least"), F.col("head_above_least").alias("above_least")
        ).join(one, "path").join(ended, "path", "left").join(children.withColumnRenamed("above", "path"), "path", "left")
        out.paths.append(durable(paths, f"op13-paths-{number}"))


# ---------------------------------------------------------------- sweeping


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Sweep:
    """The open path of one container while its sorted sequences go by, and the nodes it closed."""

    def __init__(self, above: str | None, above_least: int | None, start: int) -> None:
        self.above, self.above_least, self.start = above, above_least, start
        self.rows: list[list] = []  # as NODE's columns, with the place of the parent for its id
        self.open: list[int] = []  # places of the open nodes, from depth ``start`` on
        self.words: list[int] = []
        self.last: list[str] = []

    def add(self, ids: list[str], words: list[int], n: int, least: int, ends: str) -> None:
        keep = max(0, _shared(self.last, ids) - self.start + 1)
        self.close(keep)
        for at in self.open:
            row = self.rows[at]
            row[0], row[3] = min(row[0], least), row[3] + n
        for depth in range(self.start + len(self.open), len(ids) + 1):
            parent = self.open[-1] if self.open else None
            if parent is not None:
                self.rows[parent][4] += 1
            self.open.append(len(self.rows))
            self.words.append(words[depth - 1])
            self.rows.append([least, depth, parent, n, 0, 0, 0, NO_ENDS])
        self.rows[self.open[-1]][7] = ends
        self.last = ids

    def close(self, keep: int) -> None:
        while len(self.open) > keep:
            row, words = self.rows[self.open.pop()], self.words.pop()
            row[5] += row[4] == 0
            row[6] += (row[3] - 1) * words
            if row[2] is not None:
                parent = self.rows[row[2]]
                parent[5] += row[5]
                parent[6] += row[6]

    def nodes(self) -> list[tuple]:
        """NODE's columns, and the path the container hangs on for its top."""
        self.close(0)
        out = []
        for row in self.rows:
            top = row[2] is None
            out.append((*row[:2], self.above_least if top else self.rows[row[2]][0], *row[3:], self.above if top else None))
        return out


SWEPT = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("above", pa.string()),
])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, sweep, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["above"], row["turn"]
            if key != name:
                out += sweep.nodes() if sweep else []
                name, sweep = key, Sweep(row["above"], row["above_least"], row["start"])
            sweep.add(row["ids"], row["words"], row["n"], row["least"], row["ends"])
            if len(out) >= 20_000:
                yield _rows(out, SWEPT)
                out = []
    out += sweep.nodes() if sweep else []
    if out:
        yield _rows(out, SWEPT)


def _path_nodes(paths: DataFrame, below: DataFrame) -> DataFrame:
    """All nodes of a round's paths. ``below`` (above, leaves, saved): sums over what hangs on each path."""
    given = paths.join(below.withColumnRenamed("above", "path"), "path", "left").withColumns({
        "leaves": F.coalesce("leaves", F.lit(1).cast("long")), "saved": F.coalesce("saved", F.lit(0).cast("long")),
    })
    # The root has no words; words[i] are those of depth greatest(from_depth, 1) + i.
    words = F.when(F.col("from_depth") == 0, F.concat(F.array(F.lit(0).cast("long")), "words")).otherwise(F.col("words"))
    node = given.withColumn("words", words).select("*", F.posexplode(F.sequence("from_depth", "depth")).alias("at", "node_depth"))
    rest = F.aggregate(F.slice("words", F.col("at") + 1, F.size("words")), F.lit(0).cast("long"), lambda a, x: a + x)
    end = F.col("node_depth") == F.col("depth")
    top = F.col("at") == 0
    return node.select(
        F.col("least").alias("conv_id"), F.col("node_depth").alias("depth"),
        F.when(top, F.col("above_least")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, F.coalesce("n_children", F.lit(0).cast("long"))).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * rest).alias("saved_tokens"),
        F.when(end, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        F.when(top, F.col("above")).alias("above"),
    )


def trie_nodes(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turn, role, text; other columns are
    ignored), with NODE's columns.

    A null role or text is empty; rows without conv_id take no part. Turns that share a number are
    ordered by their digest, so rows that are repeated stand next to each other and are turns each. A
    rebuilt conversation without turns ends at the root. An empty table has no nodes, not even a root."""
    spark = conversations.sparkSession
    sequences = durable(under_root(distinct_sequences(rebuilt(durable(turn_sequences(conversations), "op13-turns")))), "op13-sequences")
    if sequences.isEmpty():
        return spark.createDataFrame([], NODE)
    found = burst(sequences, container)
    settled = found.settled[0]
    for more in found.settled[1:]:
        settled = settled.unionByName(more)
    sorted_ = settled.repartition("above", "turn").sortWithinPartitions("above", "turn", "ids")
    kinds = NODE + ", above string"
    nodes = durable(sorted_.select("above", "turn", "above_least", "start", "ids", "words", "n", "least", "ends").mapInArrow(_sweep, kinds), "op13-swept")
    sums = [F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")]
    tops = nodes.filter("above IS NOT NULL")
    levels = [nodes]
    for number in reversed(range(len(found.paths))):
        # What hangs on a path of this round: settled containers, and paths of the next round.
        level = durable(_path_nodes(found.paths[number], tops.groupBy("above").agg(*sums)), f"op13-level-{number}")
        levels.append(level)
        tops = nodes.filter("above IS NOT NULL").unionByName(level.filter("above IS NOT NULL"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("above")


ORACLE_SQL = rf"""
    WITH t AS (
        SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    placed AS (SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS p FROM t),
    sizes AS (SELECT c, count(*) AS size, c - ((c % {FAMILY}) + {FAMILY}) % {FAMILY} AS first,
        xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
            lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % {BORROWED} AS h
        FROM placed GROUP BY c),
    convs AS (SELECT s.c, s.first, s.h, least(s.h, coalesce(f.size, 0)) AS taken FROM sizes s LEFT JOIN sizes f ON f.c = s.first),
    turns AS (
        SELECT convs.c, p + 1 AS d, key, words FROM convs JOIN placed ON placed.c = first AND p < h
        UNION ALL SELECT convs.c, p - h + 1 + taken, key, words FROM convs JOIN placed ON placed.c = convs.c AND p >= h
    ),
    prefixes AS (
        SELECT c, d, md5(string_agg(key, '') OVER (PARTITION BY c ORDER BY d)) AS prefix, words FROM turns
        UNION ALL SELECT c, 0, '', 0 FROM convs
    ),
    chained AS (SELECT *, lag(prefix) OVER (PARTITION BY c ORDER BY d) AS above, d = max(d) OVER (PARTITION BY c) AS ends FROM prefixes),
    nodes AS (
        SELECT prefix, d, above, any_value(words) AS words, min(c) AS least, count(*) AS n,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
        FROM chained GROUP BY prefix, d, above
    ),
    children AS (SELECT above, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
    counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children ON children.above = nodes.prefix),
    sums AS (
        SELECT a.prefix, sum((x.n - 1) * x.words) AS saved_tokens, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
        FROM counted x JOIN prefixes a ON a.c = x.least AND a.d <= x.d GROUP BY a.prefix
    )
    SELECT x.least AS conv_id, x.d::BIGINT AS depth, p.least AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves::BIGINT AS n_leaves,
        saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
    FROM counted x JOIN sums USING (prefix) LEFT JOIN counted p ON p.prefix = x.above
"""


@query("op13_conversation_trie", oracle=ORACLE_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
