"""Hard negatives by inner product, mined with cover trees.

*Trees.* Rows are dealt by id, sorted by label and cut into runs of at most ``TREE_ROWS``, each with a
cover tree. A row x gets one more component, sqrt(M^2 - |x|^2) for the run's largest norm M, so that all
rows lie on a sphere and an anchor's inner products order them by angle. A node's children are chosen
farthest first: the node's own centre and rows more than the level's radius from each other, until every
row is within that radius of one. A node stores the greatest angle from its centre to any row below it
and its range of labels.

*Descent.* By its centre's angle and covering radius, a node's inner products lie between two bounds. Per
batch of anchors the open nodes are taken best bound first, in waves; nodes whose bounds miss every open
window (from the k-th best score so far, or the window's own lower end, to its upper end) are skipped,
the others are replaced by their children, and the rows of leaves are scored exactly. Bounds are widened
for rounding, so nothing is lost.

*Jobs.* All anchors meet all trees: a task takes one tree and at most ``ANCHORS`` anchors, and returns k
rows an anchor. A first job finds each anchor's positives; they give the windows of the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docwarden.llm.common import durable, query

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90
#: A negative's score, in percent of the positive's.
TREE_ROWS, LEAF_ROWS = 8192, 32
ANCHORS = 16_384
BATCH, WAVE = 64, 512
RATIO = 1.3
SLACK = 1e-7
ANCHOR_STEP = 100


# ---------------------------------------------------------------- cover tree


@dataclass
class CoverTree:
    """Rows in the order of the leaves, and nodes whose children follow each other."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray  # whole numbers, as float64 or int64
    norm: float
    begin: np.ndarray  # of a node: its centre's row, and the first below it
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # first child, and the one after the last; equal in a leaf
    stop: np.ndarray
    low: np.ndarray  # least and greatest label
    high: np.ndarray


def _angles(lifted: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(lifted @ centre, -1.0, 1.0))


def build_tree(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> CoverTree:
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    top = float(norms.max(initial=0.0))
    lifted = np.concatenate([rows.astype(np.float64), np.sqrt(np.maximum(top**2 - norms**2, 0.0))[:, None]], axis=1)
    lifted /= top or 1.0  # where all rows are zero, so are all angles' cosines
    order = np.arange(len(ids))
    nodes = [[0, len(ids), 0.0, 0, 0]]  # begin, end, radius, child, stop
    todo = [(0, np.pi)]
    while todo:
        at, scale = todo.pop()
        begin, end = nodes[at][:2]
        own = order[begin:end]
        points = lifted[own]
        away = _angles(points, points[0]) if top else np.zeros(len(own))
        away[(rows[own] == rows[own[0]]).all(axis=1)] = 0.0
        radius = float(away.max())
        nodes[at][2] = radius + SLACK if radius else 0.0
        if radius == 0.0 or len(own) <= LEAF_ROWS:
            continue
        # Levels without a branching are left out.
        scale = min(scale, radius) / RATIO
        centres, owner = [0], np.zeros(len(own), dtype=np.int64)
        while (far := int(away.argmax())) not in centres and away[far] > scale:
            now = _angles(points, points[far])
            now[far] = 0.0
            nearer = now < away
            owner[nearer], away[nearer] = len(centres), now[nearer]
            centres.append(far)
        # Each child's rows together, its centre first.
        first = np.ones(len(own), dtype=bool)
        first[centres] = False
        order[begin:end] = own[np.lexsort((first, owner))]
        edges = begin + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(centres)))])
        nodes[at][3:] = len(nodes), len(nodes) + len(centres)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                todo.append((len(nodes), scale))
            nodes.append([a, b, 0.0, 0, 0])
    begin, end, radius, child, stop = (np.array(c) for c in zip(*nodes, strict=True))
    labels = labels[order]
    low, high = (np.array([f(labels[a:b]) for a, b in zip(begin, end, strict=True)]) for f in (np.min, np.max))
    return CoverTree(ids[order], labels, rows[order], top, begin, end, radius, child, stop, low, high)


def pack_tree(tree: CoverTree) -> dict:
    return {name: np.ascontiguousarray(getattr(tree, name)).tobytes() for name in TREE_PARTS} | {"norm": tree.norm, "width": tree.rows.shape[1]}


TREE_PARTS = {
    "ids": np.int64, "labels": np.int64, "rows": np.int64, "begin": np.int64, "end": np.int64, "radius": np.float64,
    "child": np.int64, "stop": np.int64, "low": np.int64, "high": np.int64,
}


def unpack_tree(row: dict) -> CoverTree:
    parts = {name: np.frombuffer(row[name], dtype=kind) for name, kind in TREE_PARTS.items()}
    parts["rows"] = parts["rows"].reshape(len(parts["ids"]), row["width"])
    return CoverTree(norm=row["norm"], **parts)


# ---------------------------------------------------------------- search


class Best:
    """The k best (score, then smallest id) of each of n lists."""

    def __init__(self, n: int, k: int, lowest: np.ndarray) -> None:
        self.k, self.cut = k, lowest.astype(np.int64)  # of each list, the least score that may still enter
        self.lists = np.zeros(0, dtype=np.int64)
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def offer(self, lists: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` and ``allowed`` have a line for each of ``lists`` and a column for each of ``ids``."""
        allowed = allowed & (scores >= self.cut[lists, None])
        line, column = np.nonzero(allowed)
        if not len(line):
            return
        owner = np.concatenate([self.lists, lists[line]])
        value = np.concatenate([self.scores, scores[line, column].astype(np.int64)])
        name = np.concatenate([self.ids, ids[column]])
        order = np.lexsort((name, -value, owner))
        owner, value, name = owner[order], value[order], name[order]
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
        full = rank == self.k - 1
        self.cut[owner[full]] = value[full]
        kept = rank < self.k
        self.lists, self.scores, self.ids = owner[kept], value[kept], name[kept]


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: as float64 where every sum fits its 53 bits, else in 64-bit integers."""
    size = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
    bound = size(anchors) * size(rows)
    if bound < 2.0**52:
        return anchors.astype(np.float64) @ rows.astype(np.float64).T
    if bound < 2.0**62:
        return anchors @ rows.T
    raise ValueError("inner products do not fit 64 bits")


def descend(tree: CoverTree, anchors: np.ndarray, wanted: Callable, verify: Callable) -> None:
    """Best-first descent for a batch of anchors. ``wanted(upper, lower, low, high)`` tells for each anchor
    and node (bounds; least and greatest label) whether a row below may still count; ``verify(rows,
    scores)`` takes whole leaves."""
    norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))[:, None]
    reach = norms * tree.norm

    def bounds(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = _scores(anchors, tree.rows[tree.begin[nodes]]).astype(np.float64)
        radius = tree.radius[nodes]
        upper, lower = score + SLACK * reach, score - SLACK * reach
        wide = np.flatnonzero(radius)
        if len(wide):
            with np.errstate(invalid="ignore", divide="ignore"):
                angle = np.arccos(np.clip(np.where(reach > 0, score[:, wide] / reach, 0.0), -1.0, 1.0))
            upper[:, wide] = reach * (np.cos(np.maximum(angle - radius[wide], 0.0)) + SLACK)
            lower[:, wide] = reach * (np.cos(np.minimum(angle + radius[wide], np.pi)) - SLACK)
        return upper, lower

    nodes = np.zeros(1, dtype=np.int64)
    upper, lower = bounds(nodes)
    while len(nodes):
        open_ = wanted(upper, lower, tree.low[nodes], tree.high[nodes])
        best = np.where(open_, upper, -np.inf).max(axis=0)
        order = np.argsort(-best, kind="stable")
        order = order[best[order] > -np.inf]
        wave, rest = order[:WAVE], order[WAVE:]
        taken = nodes[wave]
        leaf = tree.child[taken] == tree.stop[taken]
        if leaf.any():
            rows = np.concatenate([np.arange(a, b) for a, b in zip(tree.begin[taken[leaf]], tree.end[taken[leaf]], strict=True)])
            for at in range(0, len(rows), 4 * WAVE):
                part = rows[at : at + 4 * WAVE]
                verify(part, _scores(anchors, tree.rows[part]))
        inner = taken[~leaf]
        nodes, upper, lower = nodes[rest], upper[:, rest], lower[:, rest]
        if len(inner):
            below = np.concatenate([np.arange(a, b) for a, b in zip(tree.child[inner], tree.stop[inner], strict=True)])
            more, less = bounds(below)
            nodes = np.concatenate([nodes, below])
            upper, lower = np.concatenate([upper, more], axis=1), np.concatenate([lower, less], axis=1)


def nearest_of_label(tree: CoverTree, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int) -> Best:
    """The k best other rows of each anchor's label."""
    best = Best(len(ids), k, np.full(len(ids), -(2**63), dtype=np.int64))
    every = np.arange(len(ids))

    def wanted(upper, lower, low, high):
        return (upper >= best.cut[:, None]) & (low <= labels[:, None]) & (labels[:, None] <= high)

    def verify(rows, scores):
        best.offer(every, scores, (tree.labels[rows] == labels[:, None]) & (tree.ids[rows] != ids[:, None]), tree.ids[rows])

    descend(tree, anchors, wanted, verify)
    return best


def within_windows(tree: CoverTree, labels: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The k best rows of other labels in each window; ``low`` and ``high`` have a line for each anchor
    and a column for each of its windows. List ``anchor * windows + window`` holds a window's rows."""
    n, windows = low.shape
    best = Best(n * windows, k, low.ravel())
    every = np.arange(n)

    def wanted(upper, lower, least, most):
        out = np.zeros(upper.shape, dtype=bool)
        for w in range(windows):
            out |= (upper >= best.cut[every * windows + w, None]) & (lower <= high[:, w, None])
        return out & ~((least == most) & (least == labels[:, None]))

    def verify(rows, scores):
        other = tree.labels[rows] != labels[:, None]
        for w in range(windows):
            best.offer(every * windows + w, scores, other & (scores <= high[:, w, None]), tree.ids[rows])

    descend(tree, anchors, wanted, verify)
    return best


# ---------------------------------------------------------------- Spark


def candidate_rows(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the vector in whole numbers, of rows that take part. Of rows that share an id,
    the one with the smallest label, then vector counts; a row without id takes no part."""
    whole = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    row = F.struct(moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
    rows = embeddings.filter(whole).filter(finite).select(F.col("vec_id").cast("long"), row.alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros, which add nothing to a product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, number, part = [], 0, TaskContext.get().partitionId()

    def packed(table: pa.Table) -> pa.RecordBatch:
        tree = build_tree(table["vec_id"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(np.int64), _matrix(table["vector"]))
        return pa.RecordBatch.from_pylist([{"part": part, "number": number} | pack_tree(tree)], schema=TREE_SCHEMA)

    for batch in batches:
        while batch.num_rows:
            room = TREE_ROWS - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == TREE_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, number = [], number + 1
    if sum(b.num_rows for b in held):
        yield packed(pa.Table.from_batches(held))


TREE_SCHEMA = pa.schema([("part", pa.int64()), ("number", pa.int64()), *[(name, pa.binary()) for name in TREE_PARTS], ("norm", pa.float64()), ("width", pa.int64())])
TREE_DDL = "part long, number long, " + ", ".join(f"{name} binary" for name in TREE_PARTS) + ", norm double, width long"


def cover_trees(rows: DataFrame) -> DataFrame:
    """A written table of trees, numbered from 0 (``tree``). A number is the count of trees in earlier
    tasks plus the own one; the driver sees one count per task."""
    trees = durable(rows.sortWithinPartitions("label", "vec_id").mapInArrow(_trees, TREE_DDL), "op11-trees")
    bases, base = [], 0
    for part, n in sorted(trees.groupBy("part").count().collect()):
        bases.append((part, base))
        base += n
    named = trees.sparkSession.createDataFrame(bases, "part long, base long")
    return durable(trees.join(named, "part").withColumn("tree", F.col("base") + F.col("number")).drop("part", "number", "base"), "op11-numbered")


def _fit(anchors: np.ndarray, width: int) -> np.ndarray:
    """Anchors cut or filled up to a tree's number of components; what is cut would meet zeros."""
    out = np.zeros((len(anchors), width), dtype=np.int64)
    shared = min(width, anchors.shape[1])
    out[:, :shared] = anchors[:, :shared]
    return out


FOUND = "anchor_id long, window int, vec_id long, score long"


def _search(find: Callable[[CoverTree, pa.Table, np.ndarray], Best], windows: int):
    def work(anchors: pa.Table, trees: pa.Table) -> pa.Table:
        owners, windows_, names, scores = ([np.zeros(0, dtype=np.int64)] for _ in range(4))
        for row in trees.to_pylist() if anchors.num_rows else []:
            tree = unpack_tree(row)
            anchors = anchors.sort_by([("label", "ascending"), ("vec_id", "ascending")])
            for at in range(0, anchors.num_rows, BATCH):
                batch = anchors.slice(at, BATCH)
                best = find(tree, batch, _fit(_matrix(batch["vector"]), row["width"]))
                owners.append(batch["vec_id"].to_numpy()[best.lists // windows])
                windows_.append(best.lists % windows), names.append(best.ids), scores.append(best.scores)
        columns = [np.concatenate(owners), np.concatenate(windows_).astype(np.int32), np.concatenate(names), np.concatenate(scores)]
        return pa.table({name: pa.array(c) for name, c in zip(("anchor_id", "window", "vec_id", "score"), columns, strict=True)})

    return work


def _over_all(anchors: DataFrame, trees: DataFrame, work: Callable) -> DataFrame:
    """Every block of anchors with every tree, as keys: a row of either side is written once for each
    partner, and a task holds one tree and one block."""
    n_trees, n_blocks = trees.count(), -(-anchors.count() // ANCHORS)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks)))
    left = anchors.withColumn("block", block.cast("long")).withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))))
    right = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n_blocks) - 1).cast("long"))))
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(work, FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, step: int = ANCHOR_STEP
) -> DataFrame:
    """For each anchor (``vec_id`` divisible by ``step``) and each of its ``positives`` best rows of the same
    label, the ``negatives`` best rows of other labels whose score is ``least`` to ``most`` percent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, embedding and label; other columns are ignored. Rows with a null label or
    vector, or a component that is null or not finite, take no part; nor do rows without id. A shorter
    vector counts as if zeros followed. Ties are ordered by id. An anchor without positives, or a window
    without rows, gives no rows; nor does an empty table. Products beyond 2^62 raise an error."""
    rows = durable(candidate_rows(embeddings), "op11-rows")
    spark = rows.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.filter(F.col("vec_id") % step == 0)
    if anchors.isEmpty():
        return spark.createDataFrame([], empty)
    trees = cover_trees(rows)

    def of_label(tree: CoverTree, batch: pa.Table, vectors: np.ndarray) -> Best:
        return nearest_of_label(tree, batch["vec_id"].to_numpy(), batch["label"].to_numpy(), vectors, positives)

    found = _over_all(anchors, trees, _search(of_label, 1))
    first = durable(_ranked(found, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "op11-positives")
    # Windows stand in the order of their positives; equal scores have equal windows.
    scores = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("ranked"))
    with_windows = anchors.join(scores, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", F.col("ranked.positive_score").alias("scores"))

    def of_windows(tree: CoverTree, batch: pa.Table, vectors: np.ndarray) -> Best:
        low, high = (np.full((batch.num_rows, positives), fill) for fill in (2**62, -(2**62)))  # no row is in these
        for i, found in enumerate(batch["scores"].to_pylist()):
            low[i, : len(found)] = [-(-least * s // 100) for s in found]
            high[i, : len(found)] = [most * s // 100 for s in found]
        return within_windows(tree, batch["label"].to_numpy(), vectors, low, high, negatives)

    mined = _ranked(_over_all(with_windows, trees, _search(of_windows, positives)), ["anchor_id", "window"], negatives)
    named = first.withColumn("window", F.col("rank") - 1).drop("rank")
    return mined.join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


@query("op11_hard_negatives", oracle=f"""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id
    ),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
    )
    SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= {NEGATIVES}
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
