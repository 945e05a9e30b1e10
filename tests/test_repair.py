"""Least-norm repair as a linear program: duality gaps, brute force over vertices, and whole windows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from trackloom.operators import coding as L


def least_norm(a, y):
    """Over all vertices: some least solution has as many entries as equations."""
    m, n = a.shape
    best = np.inf
    for s in combinations(range(n), m):
        try:
            c = np.linalg.solve(a[:, s], y)
        except np.linalg.LinAlgError:
            continue
        best = min(best, np.abs(c).sum())
    return best


@pytest.mark.parametrize("m,n", [(1, 4), (2, 6), (3, 8), (4, 9)])
def test_small_programs_against_all_vertices(m, n):
    rnd = np.random.RandomState(10 * m + n)
    a, y = rnd.normal(size=(m, n)), rnd.normal(size=(m, 12)) * 10.0 ** rnd.randint(-3, 4, 12)
    y[:, 0] = 0
    c, gaps = L.basis_pursuit(a, y)
    assert (gaps < 1e-6).all() and np.abs(a @ c - y).max() < 1e-7 * np.abs(y).max()
    for j in range(12):
        assert np.abs(c[:, j]).sum() == pytest.approx(least_norm(a, y[:, j]), rel=1e-6, abs=1e-12)


def test_larger_programs_close_their_gap():
    rnd = np.random.RandomState(4)
    a = rnd.normal(size=(30, 120))
    sparse = np.zeros((120, 8))
    for j in range(8):
        sparse[rnd.permutation(120)[:4], j] = rnd.normal(size=4) * 5
    c, gaps = L.basis_pursuit(a, a @ sparse)
    assert (gaps < 1e-6).all() and np.abs(c - sparse).max() < 1e-5  # few entries are found again
    c, gaps = L.basis_pursuit(a, rnd.normal(size=(30, 5)))
    assert (gaps < 1e-6).all()


def test_many_columns_share_their_vertices():
    """Thousands of columns over thousands of others: every gap closes, in a time that does not grow with their product."""
    import time

    rnd = np.random.RandomState(7)
    a, y = np.abs(rnd.normal(size=(3, 6000))).round(2) * 100, np.abs(rnd.normal(size=(3, 2000))).round(2) * 100
    began = time.time()
    places, coefficients, gaps = L.least_vertices(a, y)
    assert time.time() - began < 10 and (gaps < 1e-7).all()
    assert np.abs((a[:, places] * coefficients).sum(-1) - y).max() < 1e-6
    grid, asked = rnd.randint(-2, 3, (3, 200)).astype(float), rnd.randint(-4, 5, (3, 100)).astype(float)
    c, gaps = L.basis_pursuit(grid, asked)  # ties and repeated columns
    assert (gaps < 1e-7).all() and np.abs(grid @ c - asked).max() < 1e-9


def test_programs_without_a_solution():
    a = np.array([[1.0, 2.0], [2.0, 4.0]])
    c, gaps = L.basis_pursuit(a, np.array([[1.0, 1.0], [2.0, 0.0]]))
    assert gaps[0] < 1e-6 and np.isinf(gaps[1]) and np.abs(c[:, 0]).sum() == pytest.approx(0.5)
    assert np.allclose(c[:, 1], np.linalg.lstsq(a, [1.0, 0.0], rcond=None)[0])


def test_windows_are_filled(spark):
    rnd = np.random.RandomState(6)
    rows, truth = [], {}
    for clip in (1, 2):
        w = rnd.normal(size=(10, 3)) @ rnd.normal(size=(3, 24))
        for t in range(24):
            gone = set(rnd.permutation(10)[:3]) if t >= 16 else set()
            for f in range(10):
                truth[clip, t, f] = w[f, t]
                if f in gone and t % 2:
                    continue  # absent rows are gaps like nulls
                rows.append((clip, t, f, None if f in gone else float(w[f, t])))
    rows += [(3, t, f, 1.0 if f else None) for t in range(2) for f in range(3)] + [(4, 1, 0, None), (None, 1, 1, 2.0)]
    got = L.repaired_tracks(spark.createDataFrame(rows, "clip int, track_id long, frame int, v double").repartition(3), ["clip"]).collect()
    held = {(r["clip"], r["track_id"], r["frame"]): r for r in got}
    assert len(held) == len(got)
    for key, v in truth.items():
        assert held[key]["v"] == pytest.approx(v, abs=1e-4)
    assert sum(r["filled"] for r in got if r["clip"] in (1, 2)) == 2 * 8 * 3
    assert [held[3, t, 0]["v"] for t in range(2)] == [None, None] and held[4, 1, 0]["v"] is None and held[None, 1, 1]["v"] == 2.0
