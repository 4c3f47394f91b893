"""Cover trees and the negatives mined with them, beside brute force."""

import collections
import math

import numpy as np
import pytest

from docwarden.llm import op11_hard_negatives as op11

KINDS = "vec_id long, embedding array<float>, label int, score string, tree long, rank int"


def plain_negatives(rows, step=100):
    kept = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in vector])
        kept[i] = min(kept.get(i, row), row)
    out = collections.Counter()
    for a, (label, vector) in kept.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, other)), i, at) for i, (at, other) in kept.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(i, -m) for m, i, at in scored if at != label and 30 * -minus <= 100 * -m <= 90 * -minus][:10]
            out.update((a, p, rank, i, -minus, s) for rank, (i, s) in enumerate(fits, 1))
    return out


def check(spark, rows, step=100):
    table = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], KINDS).repartition(3)
    assert collections.Counter(map(tuple, op11.hard_negatives(table, step=step).collect())) == plain_negatives(rows, step)


def clustered(n, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    rows = centres[rng.integers(0, 9, n)] * rng.uniform(0.2, 2, (n, 1)) + rng.normal(scale=0.1, size=(n, d))
    return rows.astype(np.float32), rng.integers(0, 10, n)


def test_clustered_rows(spark):
    rows, labels = clustered(1500)
    check(spark, [(i, rows[i].tolist(), int(labels[i])) for i in range(1500)], step=30)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5, (i % 4) / 4], i % 3) for i in range(0, 220)]  # ties, and many equal vectors
    rows += [(300, None, 1), (400, [1.0, None, 0.0], 1), (500, [nan, 0.0, 0.0], 1), (600, [inf, 0.0, 1.0], 2), (700, [1.0, 1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (800, [], 0), (900, [0.0, 0.0, 0.0], 1), (1000, [-1.0, -1.0, -1.0], 1), (1100, [2.0], 2), (1200, [1.0] * 5, 2)]
    rows += [(100, [0.5, 0.5, 0.5], 4), (5, [1.0, 0.5, 0.25], 2)]  # ids that stand twice
    check(spark, rows)


def test_no_rows_and_no_anchors(spark):
    check(spark, [])
    check(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    check(spark, [(100, [1.0], 1)])


@pytest.mark.parametrize("n", [1, 2, 33, 2000])
def test_cover_tree_holds_every_row_within_its_radius(n):
    rows, labels = clustered(n, seed=n)
    whole = np.floor(256 * rows.astype(float)).astype(np.int64)
    tree = op11.unpack_tree(op11.pack_tree(op11.build_tree(np.arange(n), labels, whole)))
    assert sorted(tree.ids.tolist()) == list(range(n)) and (tree.rows == whole[tree.ids]).all() and (tree.labels == labels[tree.ids]).all()
    lifted = np.concatenate([tree.rows, np.sqrt(np.maximum(tree.norm**2 - (tree.rows.astype(float) ** 2).sum(axis=1), 0))[:, None]], axis=1) / tree.norm
    for i in range(len(tree.begin)):
        part = slice(tree.begin[i], tree.end[i])
        away = np.arccos(np.clip(lifted[part] @ lifted[tree.begin[i]], -1, 1))
        assert (away <= tree.radius[i] + 1e-6).all() or (tree.rows[part] == tree.rows[tree.begin[i]]).all()
        assert tree.low[i] == tree.labels[part].min() and tree.high[i] == tree.labels[part].max()
        below = range(tree.child[i], tree.stop[i])
        if below:  # children share out the rows, and the first one has the same centre
            assert tree.begin[below[0]] == tree.begin[i] and tree.end[below[-1]] == tree.end[i]
            assert all(tree.end[a] == tree.begin[a + 1] for a in below[:-1])


def test_descent_skips_most_rows_of_clusters():
    rows, labels = clustered(6000, seed=5)
    whole = np.floor(256 * rows.astype(float)).astype(np.int64)
    tree, seen = op11.build_tree(np.arange(6000), labels, whole), []
    best = op11.nearest_of_label(tree, np.arange(1), labels[:1], whole[:1], 5)
    scores = whole @ whole[0]
    right = sorted((-int(scores[i]), i) for i in range(1, 6000) if labels[i] == labels[0])[:5]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == right
    op11.descend(tree, whole[:1], lambda u, low, a, b: u >= best.cut[0], lambda r, s: seen.append(len(r)))
    assert sum(seen) < 3000


def test_products_of_large_numbers():
    big = np.array([[2**30, 1]], dtype=np.int64)
    assert op11._scores(big, big).tolist() == [[2**60 + 1]]
    with pytest.raises(ValueError):
        op11._scores(big * 4, big * 4)


def test_large_numbers_end_to_end(spark):
    check(spark, [(i, [float(2**20 + i), float(i)], i % 2) for i in range(0, 300)])
