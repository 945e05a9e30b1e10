"""Bounded k-means and trees of centres: the same results with fewer distances, repeated ids apart."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from trackloom.operators import cluster as C
from trackloom.operators import distance as D


def lloyd(x, c, rounds):
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    return c, at, d.min(1)


@pytest.mark.parametrize("shape", ["clusters", "cloud", "ties", "one"])
def test_bounds_change_nothing(spark, shape):
    rnd = np.random.RandomState(3)
    if shape == "clusters":
        x = np.concatenate([rnd.normal(m, 0.3, (150, 6)) for m in rnd.normal(0, 4, (12, 6))])
    elif shape == "cloud":
        x = rnd.normal(size=(900, 6))
    elif shape == "ties":
        x = np.array([[float(i % 8), float(i % 3)] for i in range(500)])
    else:
        x = rnd.normal(size=(50, 3))
    start = x[rnd.permutation(len(x))[: 1 if shape == "one" else 12]]
    if shape == "ties":
        start = np.array([[0.0, 0.0], [2.0, 0.0], [4.0, 0.0], [4.0, 0.0], [6.0, 2.0]])
    df = spark.createDataFrame([(i // 2, v.tolist()) for i, v in enumerate(x)] + [(7, None)], "id long, v array<double>").repartition(5)  # ids twice
    centres, assigned, counted = C.elkan_kmeans(df, start.tolist(), 12)
    want, at, d = lloyd(x, start, len(counted))
    assert np.abs(np.array(centres) - want).max() < 1e-9
    got = collections.Counter((r["id"], r["centre"], round(r["d"], 6)) for r in assigned.collect())
    assert got == collections.Counter((i // 2, int(j), round(float(e), 6)) for i, (j, e) in enumerate(zip(at, d, strict=True)))
    assert counted[0] == len(x) * len(start)
    if shape == "clusters":
        assert sum(counted[1:]) < 0.25 * (len(counted) - 1) * counted[0]
    if shape == "cloud":
        assert sum(counted[1:]) < 0.7 * (len(counted) - 1) * counted[0]


def test_bounded_kmeans_of_nothing(spark):
    centres, assigned, counted = C.elkan_kmeans(spark.createDataFrame([(1, None)], "id long, v array<double>"), [[0.0, 1.0]], 3)
    assert centres == [[0.0, 1.0]] and assigned.collect() == [] and counted == [0]


def test_repeated_ids_stay_apart_in_trees(spark):
    rnd = np.random.RandomState(5)
    x = np.concatenate([rnd.normal(m, 0.1, (30, 2)) for m in ((0, 0), (0, 9), (9, 0), (9, 9))])
    df = spark.createDataFrame([(1, v.tolist()) for v in x], "id long, v array<double>")
    tree = C.hierarchical_kmeans(df, 2, 2)
    placed = D.push_tree(df, spark.createDataFrame(tree, "node int, parent int, c array<double>"), 2).collect()
    assert len(placed) == 120 and sorted(collections.Counter(tuple(r["path"]) for r in placed).values()) == [30] * 4
    leaves = {n: c for n, p, c in tree if p}
    assert all(min(np.abs(np.array(c) - m).max() for m in ((0, 0), (0, 9), (9, 0), (9, 9))) < 0.2 for c in leaves.values())
