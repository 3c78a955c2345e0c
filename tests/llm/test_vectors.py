"""Embedding near-duplicates, hard negatives and whitening against brute force and awkward tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tanyalah.llm import eigen_updates, grid_join, multi_index, queries
from tanyalah.llm.vectors import bounded_sample

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, block string, `node` string, x int, `key` string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "b", "n", 1, "k") for i, v, k in rows], SCHEMA)


def clustered(seed=3, dims=12, labels=3):
    """Vectors of a few labels: groups of copies, chains of neighbours, lone ones."""
    r = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        for _ in range(12):
            centre = r.normal(size=dims)
            for _ in range(int(r.integers(1, 14))):
                rows.append((centre + r.normal(size=dims) * r.choice([0, 0.03, 0.12, 0.2]), label))
    hot = r.normal(size=dims)
    rows += [(hot, 1)] * 150 + [(hot + r.normal(size=dims) * 0.01, 1) for _ in range(150)]
    r.shuffle(rows)
    return [(k, np.float32(v).tolist(), int(label)) for k, (v, label) in enumerate(rows)]


def linked_brute(rows, similarity=0.98):
    n = len(rows)
    vectors = [None if v is None or k is None or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, float) for _, v, k in rows]
    count, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if vectors[a] is None or vectors[b] is None or rows[a][2] != rows[b][2]:
                continue
            x, y = vectors[a], vectors[b]
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= similarity:
                count[a] += 1
                count[b] += 1
                parent[root(a)] = root(b)
    groups = {}
    for a in range(n):
        groups.setdefault(root(a), []).append(rows[a][0])
    return sorted((rows[a][0], count[a], min(groups[root(a)]), rows[a][0] == min(groups[root(a)])) for a in range(n))


@pytest.mark.parametrize("block_bytes", [4 << 20, 8 * 12 * 40])
def test_links_equal_brute_force(spark, block_bytes):
    rows = clustered()
    found = grid_join.linked_vectors(table(spark, rows), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, found)) == linked_brute(rows)


def test_joined_intervals_equal_brute_force_and_skip():
    r = np.random.default_rng(1)
    rows = np.concatenate([r.normal(size=(300, 6)), np.repeat(r.normal(size=(6, 6)), 50, axis=0) + r.normal(size=(300, 6)) * 0.02])
    vectors = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    copies = r.integers(1, 4, len(vectors))
    axes = grid_join.principal_axes(vectors, 3)
    order = np.lexsort(np.floor(vectors @ axes / 0.2).T[::-1])
    vectors, copies = vectors[order], copies[order]
    side = grid_join.Intervals(vectors, vectors @ axes)
    links = grid_join.Links(copies)
    at = np.arange(len(vectors))
    grid_join.join_intervals(side, side, (at, at), links, 0.98, leaf=8)
    near = vectors @ vectors.T >= 0.98
    np.fill_diagonal(near, False)
    assert (links.count == near @ copies).all()
    reach = near | np.eye(len(near), dtype=bool)
    for _ in range(10):
        reach = reach @ reach
    root = links.roots()
    assert ((root[:, None] == root) == reach).all()


def test_links_of_awkward_rows(spark):
    ones = [1.0, 1.0, 0.0]
    rows = [(4, ones, 1), (2, ones, 1), (3, [2.0, 2.0, 0.0], 1), (5, ones, 2), (6, ones, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0], 1), (10, [NAN, 1.0, 0.0], 1), (11, [INF, 1.0, 0.0], 1), (12, [None, 1.0, 1.0], 1), (13, [], 1), (14, [1.0, 1.0], 1)]
    found = {r.vec_id: tuple(r)[1:] for r in grid_join.linked_vectors(table(spark, rows)).collect()}
    for k in (2, 3, 4, 14):
        assert found[k] == (3, 2, k == 2)
    for k in (5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert found[k] == (0, k, True)
    # Repeated rows are links of each other; a null id stays null and is kept where it reaches no id.
    again = grid_join.linked_vectors(table(spark, [(1, ones, 1), (1, ones, 1), (None, ones, 1), (None, [0.0, 1.0, 0.0], 2), (None, None, 2)]))
    assert sorted(map(tuple, again.collect()), key=str) == sorted([(1, 2, 1, True)] * 2 + [(None, 2, 1, False), (None, 0, None, True), (None, 0, None, True)], key=str)
    # Different vectors of one id are one node.
    chain = grid_join.linked_vectors(table(spark, [(1, ones, 1), (5, ones, 1), (5, [0.0, 0.0, 1.0], 1), (9, [0.0, 0.0, 1.0], 1)]))
    assert {r.component_id for r in chain.collect()} == {1}
    empty = grid_join.linked_vectors(table(spark, []))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    assert grid_join.linked_vectors(table(spark, [(1, None, 1)])).collect()[0][1:] == (0, 1, True)


def mined_brute(rows, anchors):
    kept = [(LAST if i is None else i, np.floor(256 * np.array(v, float)).astype(int), k) for i, v, k in rows if k is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(x) for _, x, _ in kept), default=0)
    kept = [(i, np.pad(x, (0, longest - len(x))), k) for i, x, k in kept]
    out = []
    for i, x, k in kept:
        if i == LAST or i % anchors:
            continue
        scored = sorted((-int(x @ y), j, own) for j, y, own in kept if j != i)
        for p, j, _ in [s for s in scored if s[2] == k][:5]:
            able = [s for s in scored if s[2] != k and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(able, 1)]
    return sorted((tuple(None if c == LAST else c for c in row) for row in out), key=str)


LAST = multi_index.LAST


def as_rows(frame):
    return sorted((tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("block_bytes", [32 << 20, 8 * 12 * 30])
def test_hard_negatives_equal_brute_force(spark, block_bytes):
    r = np.random.default_rng(5)
    rows = [(i, v, int(r.integers(0, 3))) for i, v, _ in clustered()]
    frame = table(spark, rows)
    found = multi_index.mine_hard_negatives(frame, frame.vec_id % 10 == 0, block_bytes=block_bytes)
    expected = mined_brute(rows, 10)
    assert len(expected) > 300 and as_rows(found) == expected


def test_visits_come_in_falling_order_and_once():
    r = np.random.default_rng(2)
    first, second = r.normal(size=7), r.normal(size=9)
    second[4] = -np.inf
    visits = multi_index.Visits(first, second)
    seen, bounds = [], []
    while visits.heap:
        bounds.append(visits.best())
        seen.append(visits.next())
    assert len(seen) == len(set(seen)) == 7 * 8 and bounds == sorted(bounds, reverse=True)
    assert all(b == first[i] + second[j] for b, (i, j) in zip(bounds, seen))


def test_bounds_hold_and_searches_stop_early():
    r = np.random.default_rng(4)
    rows = multi_index.whole(np.repeat(r.normal(size=(20, 8)), 60, axis=0) + r.normal(size=(1200, 8)) * 0.02)
    books = tuple(multi_index.codebook(h, 8) for h in (rows[:, :4], rows[:, 4:]))
    index = multi_index.MultiIndex(rows, books)
    anchors = rows[::50]
    first, second = index.bounds(anchors)
    for k in range(len(index.cells)):
        i, j = divmod(int(index.cells[k]), len(books[1]))
        most = (anchors @ rows[index.members(k)].T).max(axis=1)
        assert (most <= first[:, i] + second[:, j]).all()
    labels = np.zeros(len(rows), np.int64)
    read = []
    plain = multi_index.products
    multi_index.products = lambda a, b: read.append(len(a) * len(b)) or plain(a, b)
    try:
        best = multi_index.first_of_own_label(index, anchors, labels[::50], np.arange(0, 1200, 50), labels, np.arange(1200), 5)
    finally:
        multi_index.products = plain
    assert sum(read) < len(anchors) * len(rows) / 2 and len(best.slot) == 5 * len(anchors)


def test_hard_negatives_of_awkward_rows(spark):
    ones = [1.0, 1.0, 0.0]
    rows = [(0, ones, 1), (10, ones, 1), (10, ones, 1), (1, ones, 1), (2, [0.5, 0.5, 0.0], 2), (3, [0.5, 0.5], 2), (4, [0.6, 0.6, 0.0], 3), (None, ones, 1), (None, [0.5, 0.6, 0.0], 2), (5, None, 2), (6, [NAN, 1.0, 1.0], 2), (7, ones, None), (8, [], 4), (20, [0.0, 0.0, 0.0], 1), (30, [-1.0, -1.0, 0.0], 5)]
    frame = table(spark, rows)
    assert as_rows(multi_index.mine_hard_negatives(frame, frame.vec_id % 10 == 0)) == mined_brute(rows, 10)
    none = table(spark, [])
    assert multi_index.mine_hard_negatives(none, none.vec_id == 0).count() == 0
    assert multi_index.mine_hard_negatives(frame, frame.vec_id == 99).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        multi_index.products(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**30))
    assert multi_index.products(np.full((1, 1), 2.0**30 + 1), np.full((1, 1), 2.0**30 + 1))[0, 0] == (2**30 + 1) ** 2


def test_rank_one_updates_equal_a_full_decomposition():
    r = np.random.default_rng(0)
    wide = np.floor(64 * r.normal(size=(400, 12)) * np.geomspace(1, 0.01, 12))
    flat = wide.copy()
    flat[:, 3], flat[:, 7] = flat[:, 5], 0
    for rows in (wide, flat, np.repeat(wide[:5], 20, axis=0), wide[:1], np.zeros((3, 12)), np.eye(12) * 7):
        one, two = eigen_updates.Spectrum(12), eigen_updates.Spectrum(12)
        for k, row in enumerate(rows):
            (one if k % 3 else two).add(row)
        one.join(two)
        product = rows.T @ rows
        most = max(1.0, np.abs(product).max())
        assert np.abs(one.axes * one.values @ one.axes.T - product).max() < 1e-8 * most
        assert np.abs(one.axes.T @ one.axes - np.eye(12)).max() < 1e-11
        assert np.abs(one.values - np.linalg.eigvalsh(product)).max() < 1e-8 * most


def test_secular_roots_solve_the_equation():
    r = np.random.default_rng(9)
    for d in (np.sort(r.normal(size=9)), np.array([0, 1e-9, 1.0, 1 + 1e-7, 50.0])):
        z = r.normal(size=len(d))
        root, axes = eigen_updates.secular(d, z)
        assert np.allclose(axes.T @ (np.diag(d) + np.outer(z, z)) @ axes, np.diag(root), atol=1e-8 * root[-1])
        assert (root[:-1] >= d[:-1]).all() and (root[:-1] <= d[1:]).all()


def whitened_brute(rows, components=16):
    x = np.array([np.floor(64 * np.array(v, float)) + 1_000_000 for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    middle = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(middle.T @ middle / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [int((((n * y - sums).astype(np.int64)) ** 2).sum()) for y in x]
    return n, deviation, values, (x - fit.mean(axis=0)) @ axes[:, :components] / np.sqrt(values[:components])


def test_whitening_equals_brute_force(spark):
    frame = queries.table(spark, SF, "embeddings")
    more = frame.union(frame.where("vec_id < 200"))
    rows = [(r.vec_id, r.embedding) for r in more.collect()]
    n, deviation, values, expected = whitened_brute(rows)
    found = eigen_updates.whitened(more.repartition(37)).toPandas()
    assert len(found) == 16 * len(rows) and set(found.n) == {n}
    share = found.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (values[:16] / values.sum()) - 1).max() < 1e-9
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    held = found.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    place = {i: k for k, (i, _) in enumerate(rows)}
    expected = expected[[place[i] for i in sorted(place)]]
    sign = np.sign((held * expected).sum(axis=0))
    assert np.abs(held * sign - expected).max() < 1e-6
    assert dict(zip(found.vec_id, found.deviation)) == {i: d for (i, _), d in zip(rows, deviation)}


def test_whitening_of_awkward_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], None), (None, [3.0, 2.0, 3.0], 1), (4, None, 1), (5, [NAN, 1.0, 1.0], 1), (6, [INF, 1.0, 1.0], 1), (7, [None, 1.0, 1.0], 1), (8, [5.0, 2.0], 1)]
    found = eigen_updates.whitened(table(spark, rows)).collect()
    assert sorted({str(r.vec_id) for r in found}) == ["1", "2", "8", "None"]
    assert {r.component for r in found} == {1, 2, 3} and {r.n for r in found} == {3}
    assert all(r.whitened is None for r in found if r.component == 3)
    assert abs(sum(r.explained for r in found if r.vec_id == 1) - 1) < 1e-12
    one = eigen_updates.whitened(table(spark, [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)] * 2
    none = eigen_updates.whitened(table(spark, [(1, None, 1)]))
    assert none.count() == 0 and none.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    far = {r.vec_id: r for r in eigen_updates.whitened(table(spark, [(1, [1e30], 1), (2, [-1e30], 1), (3, [0.0], 1)])).collect()}
    assert far[1].deviation is None and far[1].deviation_whole is None or far[1].deviation_whole > 1 << 63


def test_samples_are_bounded_and_repeat(spark):
    frame = spark.range(20_000).selectExpr("id", "id % 7 as other")
    first = sorted(r.id for r in bounded_sample(frame, ["id"], 500, 20_000).collect())
    assert len(first) == 500 and first == sorted(r.id for r in bounded_sample(frame.repartition(13), ["id"], 500, 20_000).collect())
