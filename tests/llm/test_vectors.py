"""Near-duplicate vectors at default parameters against brute force on planted clusters, and odd rows."""

import numpy as np

from tessel.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, key long, leaf int"


def root_of(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_planted_links_at_default_parameters(spark):
    rng = np.random.default_rng(12)
    n, dims = 20_000, 32
    center = rng.standard_normal((7000, dims))
    x = center[rng.integers(0, 7000, n)] + 0.11 * rng.standard_normal((n, dims))
    label = rng.integers(0, 3, n)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, pairs = np.zeros(n, dtype=int), []
    for a in range(0, n, 2000):
        near = (u[a : a + 2000] @ u.T >= 0.98) & (label[a : a + 2000, None] == label)
        near[np.arange(2000), a + np.arange(2000)] = False
        links[a : a + 2000] = near.sum(1)
        pairs += [(int(i) + a, int(j)) for i, j in zip(*np.nonzero(near), strict=True)]
    root = root_of(n, pairs)
    rows = [(i, x[i].tolist(), int(label[i]), 0, 0) for i in range(n)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert links.sum() > 10_000 and all(got[i].n_links <= links[i] for i in range(n))
    assert sum(r.n_links for r in got.values()) >= 0.99 * links.sum()
    assert np.mean([got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(n)]) >= 0.995


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0)]
    rows += [(5, [1e200, 1e200], 1), (6, [1e-200, 1e-200], 1), (7, [3.0, 3.0], 1), (7, [3.0, 3.0], 1), (None, [3.0, 3.0], 1), (8, [3.0, 3.0, 0.0], 1), (9, None, 1), (10, [float("inf"), 1.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).collect())
    want = [("1", 1, "1", True)] * 2 + [("2", 1, "1", False), ("3", 1, "1", False), ("5", 3, "5", True), ("6", 3, "5", False), ("7", 3, "5", False), ("7", 3, "5", False)]
    assert got == sorted([*want, ("None", 0, "None", True), ("8", 0, "8", True), ("9", 0, "9", True), ("10", 0, "10", True)])
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_labels(spark):
    """More labels than any fixed number of trees would serve: each is searched."""
    rng = np.random.default_rng(3)
    rows = []
    for label in range(300):
        v = rng.standard_normal(8)
        rows += [(10 * label + i, (v + 0.01 * rng.standard_normal(8)).tolist(), label, 0, 0) for i in range(3)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_links == 2 and r.component_id == r.vec_id // 10 * 10 for r in got)
