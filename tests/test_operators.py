"""Operators on small literal inputs and against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import alignment, binning, cluster, coding, distance, encode, flow, forest, geometry, graphpath, images, metrics, sampling, svm, tracks, windows
from trackloom.plans import ordered, stages
from trackloom.sources import frames
from trackloom.streaming import tracks as streaming


def scores(spark, labels, values):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(zip(labels, values, strict=True))], "id long, label int, score double")


def test_precision_recall_values(spark):
    df = scores(spark, [1, 1, -1, -1, -1], [5, 3, 4, 2, 1])
    rows = metrics.precision_recall(df).orderBy("k").collect()
    assert [r.precision for r in rows] == pytest.approx([1, 1, 1 / 2, 2 / 3, 2 / 4, 2 / 5])
    assert [r.recall for r in rows] == pytest.approx([0, 0.5, 0.5, 1, 1, 1])
    r = metrics.pr_summary(df).first()
    assert r.auc == pytest.approx(0.5 + 0.5 * (0.5 + 2 / 3) / 2) and r.ap == pytest.approx((1 + 2 / 3) / 2)
    prior = metrics.precision_recall(scores(spark, [1, -1], [1, 2]), prior=0.25).orderBy("k").collect()
    assert prior[-1].precision == pytest.approx(0.25)


def test_roc_values(spark):
    df = scores(spark, [1, 1, -1, -1, -1], [5, 3, 4, 2, 1])
    rows = metrics.roc(df).orderBy("k").collect()
    assert [r.tpr for r in rows] == pytest.approx([0, 0.5, 0.5, 1, 1, 1])
    assert [r.tnr * 3 for r in rows] == pytest.approx([3, 3, 2, 2, 1, 0])
    r = metrics.roc_summary(df).first()
    assert r.eer == pytest.approx(1 / 3) and r.auc == pytest.approx(1 - 1 / 6)
    never = scores(spark, [1, 1, -1, -1, -1, -1], [1, -math.inf, -1, -1, -1, -1])
    assert metrics.tp_fp(never).count() == 6 and metrics.tp_fp(never, include_inf=True).count() == 7


def test_bin_search_values(spark):
    df = spark.createDataFrame([(x,) for x in [-math.inf, -11.0, *map(float, range(-10, 11)), math.inf, math.nan, None]], "x double")
    got = [r.i for r in df.select(binning.bin_search(F.col("x"), range(-10, 11)).alias("i")).collect()]
    assert got == [0, 0, *range(1, 22), 21, 0, None]
    assert df.select(binning.bin_search(F.col("x"), []).alias("i")).first().i == 0


def test_bin_sum_and_histogram(spark):
    acc = spark.createDataFrame([(1, 1.0), (2, 7.0)], "bin int, h double")
    obs = spark.createDataFrame([(2, -1.0), (0, 99.0)], "bin int, x double")
    assert {(r.bin, r.h) for r in binning.bin_sum(acc, obs).collect()} == {(1, 1.0), (2, 6.0)}
    with pytest.raises(Exception, match="out of range"):
        binning.bin_sum(acc, spark.createDataFrame([(3, 1.0)], "bin int, x double")).collect()
    x = spark.createDataFrame([(1.0, float(w)) for w in range(1, 11)] + [(math.nan, 5.0), (2.0, 3.0), (2.5, 4.0)], "x double, w double")
    assert [r.h for r in binning.weighted_histogram(x, F.col("x"), F.col("w"), [1.0, 2.0]).orderBy("bin").collect()] == [55.0, 3.0]


def test_ancestors_and_flat_map(spark):
    parents = spark.createDataFrame([(i, i + 1 if i < 20 else 0) for i in range(1, 21)], "node int, parent int")
    assert binning.ancestors(parents).count() == 210
    flat = cluster.flat_map(spark.createDataFrame([(i, max(1, i - 1)) for i in range(1, 40)] + [(50, 50)], "node int, parent int")).collect()
    assert {r.root for r in flat if r.node < 50} == {1} and len(flat) == 40


def test_natural_order(spark):
    names = ["1000X Radonius Maximus", "10X Radonius", "200X Radonius", "20X Radonius", "Allegia 50 Clasteron", "Allegia 500 Clasteron", "Allegia 51 Clasteron", "Xiph Xlater 5", "Xiph Xlater 40", ""]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.s for r in df.orderBy(sampling.natural_key(F.col("s"))).collect()]
    assert got == ["", "10X Radonius", "20X Radonius", "200X Radonius", "1000X Radonius Maximus", "Allegia 50 Clasteron", "Allegia 51 Clasteron", "Allegia 500 Clasteron", "Xiph Xlater 5", "Xiph Xlater 40"]


@pytest.mark.parametrize(("mode", "n", "want"), [("beginning", 5, [1, 2, 3, 4, 5]), ("beginning", 0.5, [1, 2, 3, 4, 5]), ("ending", 5, [6, 7, 8, 9, 10]), ("largest", 5, [6, 7, 8, 9, 10]), ("smallest", 0.5, [1, 2, 3, 4, 5]), ("uniform", 5, [1, 3, 6, 8, 10]), ("uniform", 2, [1, 10]), ("uniform", 100, list(range(1, 11))), ("uniform", 1, [10]), ("beginning", 0, [])])
def test_subset(spark, mode, n, want):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "pos int, x double")
    assert sorted(r.pos for r in sampling.subset(df, n, mode, keys=["x"]).collect()) == want
    assert len(sampling.subset(df, 3, "random", seed=4).collect()) == 3


def test_running_sums_match_a_global_window(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([1.0, 2.0, None, 5.5]), rnd.randrange(9)) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, k double, v int").repartition(5)
    got = {r.id: (r["rank"], r.s) for r in ordered.running_sums(df, [F.col("k"), F.col("id")], {"s": F.col("v")}, slices=7).collect()}
    total, want = 0, {}
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1):
        total += v
        want[i] = (n, total)
    assert got == want
    top = {r.id: r.m for r in ordered.running_max(df, [F.col("id")], F.col("v"), "m").collect()}
    assert top == {i: max(r[2] for r in rows[: i + 1]) for i in range(800)}
    assert ordered.running_sums(df.limit(0), [F.col("id")], {"s": F.col("v")}).count() == 0


def vectors(spark, n, d, seed, base=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, spark.createDataFrame([(base + i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_neighbours_and_ratio_match(spark):
    x, data = vectors(spark, 150, 10, 1)
    q, queries = vectors(spark, 7, 10, 2, 1000)
    d = ((q[:, None] - x[None]) ** 2).sum(-1)
    got = distance.nearest_neighbours(queries, data, 7).orderBy("q", "rank").collect()
    assert [r.id for r in got] == np.argsort(d, 1)[:, :7].ravel().tolist()
    assert [r.d2 for r in got] == pytest.approx(np.sort(d, 1)[:, :7].ravel())
    match = {r.k1: r.k2 for r in distance.ratio_match(queries, data, 1.2).collect()}
    two = np.sort(d, 1)[:, :2]
    assert match == {1000 + i: int(d[i].argmin()) for i in range(7) if 1.2 * two[i, 0] < two[i, 1]}
    one = distance.ratio_match(queries, data.limit(1)).collect()
    assert len(one) == 7  # a single candidate is accepted


def test_distance_and_kernel_identity(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((2, 6, 10))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    from trackloom.functions.vectors import pair_value

    for dist, kernel in (("l2", "kl2"), ("l1", "kl1"), ("chi2", "kchi2"), ("hell", "khell")):
        k = [pair_value(kernel, F.col(u), F.col(v)) for u, v in ("aa", "bb", "ab")]
        for r in df.select(pair_value(dist, F.col("a"), F.col("b")).alias("d"), (k[0] + k[1] - 2 * k[2]).alias("k")).collect():
            assert r.d == pytest.approx(r.k, abs=1e-9)


def test_kmeans_separates_patterns(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([np.array(c) + rng.normal(0, 0.05, (25, 2)) for c in ((0, 0), (0, 1), (1, 0), (1, 1))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    centres, assigned, energy = cluster.kmeans(df, 4, init="plusplus", iterations=15)
    labels = {r.id: r.centre for r in assigned.collect()}
    assert len({labels[i] for i in range(0, 100, 25)}) == 4 and energy < 1.5
    assert all(labels[i] == labels[i // 25 * 25] for i in range(100))
    l1, _, _ = cluster.kmeans(df, 1, distance="l1", iterations=2)
    assert l1[0] == pytest.approx(np.median(pts, 0).tolist(), abs=1e-9)
    whole, _, _ = cluster.kmeans(df, 2, integer=True, iterations=3)
    assert all(x == int(x) for c in whole for x in c)
    tree = cluster.hierarchical_kmeans(df, 2, 2, 5)
    assert [p for _, p, _ in tree] == [0, 0, 1, 1, 2, 2]
    table = spark.createDataFrame(tree, "node int, parent int, c array<double>")
    paths = {r.id: tuple(r.path) for r in distance.push_tree(df, table, 2).collect()}
    assert all(len(p) == 2 and dict((n, q) for n, q, _ in tree)[p[1]] == p[0] for p in paths.values())


def test_gmm_finds_two_groups(spark):
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.normal(-2, 0.5, (60, 2)), rng.normal(2, 1.0, (30, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    means, covs, priors, _ = cluster.gmm(df, [[-1.0, -1.0], [1.0, 1.0]], 8)
    assert priors[0] == pytest.approx(2 / 3, abs=0.05) and means[1] == pytest.approx([2, 2], abs=0.5) and covs[0][0] < covs[1][0]


def test_vlad_and_fisher(spark):
    data = spark.createDataFrame([(i, [float(i + 1)]) for i in range(3)], "id long, v array<double>")
    centres = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "k int, c array<double>")
    assign = spark.createDataFrame([(i, i, 1.0) for i in range(3)], "id long, k int, a double")
    assert [r.val for r in encode.vlad(data, centres, assign, normalize=False).orderBy("k").collect()] == [1.0, 1.0, 1.0]
    x, df = vectors(spark, 40, 3, 9)
    mix = [(np.zeros(3), np.ones(3), 0.4), (np.full(3, 0.7), np.full(3, 2.0), 0.6)]
    logs = np.stack([np.log(p) - 0.5 * (np.log(2 * np.pi * s).sum() + ((x - m) ** 2 / s).sum(1)) for m, s, p in mix], 1)
    q = np.exp(logs - logs.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    got = {(r.k, r.moment, r.dim): r.val for r in encode.fisher(df, [(m.tolist(), s.tolist(), p) for m, s, p in mix]).collect()}
    for k, (m, s, p) in enumerate(mix):
        z = (x - m) / np.sqrt(s)
        for j in range(3):
            assert got[k, 1, j] == pytest.approx((q[:, k] * z[:, j]).sum() / (40 * math.sqrt(p)), abs=1e-10)
            assert got[k, 2, j] == pytest.approx((q[:, k] * (z[:, j] ** 2 - 1)).sum() / (40 * math.sqrt(2 * p)), abs=1e-10)


def test_kernel_map_approximates(spark):
    values = [0.0, 0.1, 0.4, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    m = np.array([r.m for r in df.select(encode.kernel_map(F.col("x"), 3, "chi2").alias("m")).collect()])
    want = [[2 * a * b / (a + b) if a + b else 0 for b in values] for a in values]
    assert np.abs(m @ m.T - want).max() < 0.05


def test_aib_values():
    parents, _ = cluster.aib(np.array([[0.3, 0.3, 0, 0], [0, 0, 0.2, 0.2]]))
    assert parents == [5, 5, 6, 6, 7, 7, 1]
    cut, labels = cluster.aib_cut(parents, 2)
    assert cut == [5, 6] and labels == [1, 1, 2, 2, 1, 2, 0]


def test_layered_paths_match_brute_force(spark):
    rnd = random.Random(0)
    n, w = 3, 4
    ea, eb = ({(k, s, t): rnd.randrange(1, 11) for k in range(w - 1) for s in range(n) for t in range(n)} for _ in range(2))
    links = {(k, s, t): rnd.randrange(1, 11) for k in range(w) for s in range(n) for t in range(n)}
    df = lambda d: spark.createDataFrame([(*k, float(v)) for k, v in d.items()], "k int, s int, t int, w double")
    from itertools import product

    best = min(sum(links[k, a[k], b[k]] for k in range(w)) + sum(ea[k, a[k], a[k + 1]] + eb[k, b[k], b[k + 1]] for k in range(w - 1)) for a in product(range(n), repeat=w) for b in product(range(n), repeat=w))
    forward = graphpath.coupled_paths(df(ea), df(eb), df(links), w)
    backward = graphpath.coupled_paths(df(ea), df(eb), df(links), w, forward=False)
    found = graphpath.best_path(forward, w - 1).first()
    assert found.dist == best and graphpath.best_path(backward, 0).first().dist == best
    through = graphpath.through_pair(forward, backward, df(links)).collect()
    assert min(r.dist for r in through) == best
    path = spark.createDataFrame([(k, s) for k, s in enumerate(found.path_a)], "k int, s int")
    assert graphpath.path_cost(path, df(ea)).first().cost == sum(ea[k, found.path_a[k], found.path_a[k + 1]] for k in range(w - 1))
    ignored = graphpath.without_nodes(df(ea), spark.createDataFrame([(1, 0)], "k int, s int"))
    assert ignored.count() == len(ea) - 6
    assert graphpath.node_parts(graphpath.node_index(1, 2, 1, n, w), n, w) == (1, 2, 1)


def test_homography_ransac(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.05, 0.02, 3], [-0.01, 0.97, 5], [1e-4, -5e-5, 1]])
    a = rng.uniform(0, 640, (80, 2))
    b = geometry.apply(h, a)
    assert geometry.dlt(a[:6], b[:6]) == pytest.approx(h, abs=1e-6)
    b[:20] += rng.uniform(30, 90, (20, 2))
    df = spark.createDataFrame([(1, *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)] + [(2, 1.0, 1.0, 2.0, 2.0)], "frame int, xa double, ya double, xb double, yb double")
    got = {r.frame: r for r in geometry.fit_homographies(df, ["frame"], 0.001).collect()}
    assert got[1].inliers == 60 and np.array(got[1].h).reshape(3, 3) == pytest.approx(h, abs=1e-3) and got[2].h is None
    cells = (a[:, 0] // 64 * 10 + a[:, 1] // 64).astype(int)
    h2, inliers = geometry.ransac_homography_cells(a, b, 0.001, cells)
    assert inliers[20:].all() and h2 == pytest.approx(h, abs=1e-2)


def test_mesh_warp_follows_an_affine_map(spark):
    rng = np.random.default_rng(4)
    a = rng.uniform(5, 95, (60, 2))
    b = a @ np.array([[0.98, 0.05], [-0.05, 0.98]]).T + [2, 3]
    vertices, cells = geometry.similar_warp(a, b, 100, 100, 4)
    assert geometry.apply(cells[1, 2], a[:5]) == pytest.approx(b[:5], abs=0.5) and vertices.shape == (5, 5, 2)
    df = spark.createDataFrame([(1, *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)], "frame int, xa double, ya double, xb double, yb double")
    got = geometry.fit_meshes(df, ["frame"], 100, 100, 4).collect()
    assert len(got) == 16
    knots = np.array([[0.0, 0], [10, 0], [0, 10], [10, 10], [5, 5]])
    moved = knots + [[0, 0], [1, 0], [0, 1], [0, 0], [0.5, 0.2]]
    c = geometry.thin_plate(knots, moved)
    assert geometry.plate_warp(knots, knots, c) == pytest.approx(moved) and geometry.plate_unwarp(moved, knots, c) == pytest.approx(knots, abs=1e-6)


def test_path_product_and_smoothing(spark):
    step = [1.0, 0.0, 2.0, 0.0, 1.0, -1.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, 1, 1, f, step) for f in range(1, 6)], "clip int, row int, col int, frame int, h array<double>")
    got = {r.frame: r.path for r in windows.path_product(df, ["clip", "row", "col"], "frame", "h").collect()}
    assert got[1] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and got[5] == [1, 0, 8, 0, 1, -4, 0, 0, 1]
    paths = spark.createDataFrame([(f, 1, 1, [float(f % 2)] * 9) for f in range(6)], "frame int, row int, col int, c array<double>")
    affinity = spark.createDataFrame([(t, r, 1.0) for t in range(6) for r in range(6) if abs(t - r) == 1], "t int, r int, w double")
    out = {r.frame: r.p[0] for r in geometry.smooth_paths(paths, affinity, 1).collect()}
    assert out[0] == pytest.approx(0.5) and out[2] == pytest.approx(2 / 3)


def test_minimum_cut(spark):
    rng = random.Random(3)
    for _ in range(20):
        n = 6
        edges = [(i, j, rng.randrange(5)) for i in range(n) for j in range(n) if i != j]
        src, snk = [rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)]
        net = flow.FlowNetwork(n)
        for i, j, c in edges:
            net.add_edge(i, j, c)
        for i in range(n):
            net.add_terminal(i, src[i], snk[i])
        cut = lambda m: sum(snk[i] if m >> i & 1 else src[i] for i in range(n)) + sum(c for i, j, c in edges if m >> i & 1 and not m >> j & 1)  # noqa: B023, E731
        assert net.solve() == min(map(cut, range(1 << n)))
        assert cut(sum(1 << i for i in range(n) if net.source_side()[i])) == net.flow
    e = spark.createDataFrame([(1, 0, 1, 3.0, 3.0), (2, 0, 1, 1.0, 1.0)], "g int, src long, dst long, cap double, rev_cap double")
    t = spark.createDataFrame([(1, 0, 9.0, 0.0), (1, 1, 0.0, 2.0), (2, 0, 9.0, 0.0), (2, 1, 0.0, 9.0)], "g int, node long, source double, sink double")
    got = {(r.g, r.node): (r.source_side, r.flow) for r in flow.minimum_cuts(e, t, ["g"]).collect()}
    assert got[1, 1] == (True, 2.0) and got[2, 1] == (False, 1.0) and got[2, 0] == (True, 1.0)


def test_seam_keeps_to_coverage():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (3, 6, 8, 3))
    b = a.copy()
    b[:, :, 5:] = 255 - b[:, :, 5:]
    cover_a, cover_b = np.ones((3, 6, 8), bool), np.ones((3, 6, 8), bool)
    cover_a[:, :, 6:], cover_b[:, :, :2] = False, False
    zero = np.zeros((3, 6, 8))
    masks = flow.seam_clip([(a[i], b[i], zero[i], zero[i], cover_a[i], cover_b[i]) for i in range(3)])
    assert len(masks) == 3 and all(m[:, 6:].all() and not m[:, :2].any() for m in masks)


def test_coding_segmentation(spark):
    rng = np.random.default_rng(7)
    one, two = np.outer([1, 0, 0], rng.choice([-1, 1], 12) * rng.uniform(1, 2, 12)), np.outer([0, 1, 1], rng.choice([-1, 1], 10) * rng.uniform(1, 2, 10))
    w = np.c_[one, two] + rng.normal(0, 0.01, (3, 22))
    labels = coding.segment(w, 0.1)
    assert coding.misclassified(labels, np.r_[[1] * 12, [2] * 10]) == 0
    trials = coding.try_sequence(w, [0.05, 0.1, 0.3])
    assert len(np.unique(coding.best_segmentation(w, trials, 2))) == 2
    df = spark.createDataFrame([(int(k), c.tolist()) for k, c in zip(labels, w.T, strict=True)], "label int, v array<double>")
    bits = {r.label: r.bits for r in coding.grouped_lengths(df, "label", "v", 0.1).collect()}
    assert sum(bits.values()) == pytest.approx(coding.total_coding_length(w, labels, 0.1))
    assert coding.matrix_rank(one) == 1 and coding.project(w, 2).shape == (2, 22)
    known = np.ones((3, 22), bool)
    known[2, 21] = False
    assert coding.repair(w, known)[2, 21] == pytest.approx(w[2, 21], abs=0.1)
    pts = [(0, t, f, *(np.array([f * 1.0, 0.0]) if t < 4 else np.array([0.0, f * f * 1.0])) * (1 + t)) for t in range(8) for f in range(6)]
    rows = spark.createDataFrame([(int(a), int(b), int(c), float(d), float(e)) for a, b, c, d, e in pts], "window int, track_id long, frame int, x double, y double")
    seg = {r.track_id: r.label for r in coding.segment_windows(rows, 0.5).collect()}
    assert seg[0] == seg[3] != seg[5] == seg[7]


def test_svm_objective(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1.5, 1, (30, 2)), rng.normal(-1.5, 1, (30, 2))]
    y = np.r_[np.ones(30), -np.ones(30)].astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(2).cache()
    seen = []
    w, b, objective = svm.train(df, 0.1, steps=40, callback=seen.append)
    assert seen and objective < 0.5 and np.mean(np.sign(x @ w + b) == y) > 0.9
    assert svm.predict(df, w, b).where("score * y > 0").count() > 54
    for loss in ("hinge2", "l1", "l2", "logistic"):
        w, b, objective = svm.train(df, 0.5, loss, steps=25)
        assert np.isfinite(objective) and np.mean(np.sign(x @ w + b) == y) > 0.85


def test_image_operators(spark):
    rng = np.random.default_rng(5)
    img = rng.random((8, 10))
    df = spark.createDataFrame([(int(y), int(x), float(img[y, x])) for y in range(8) for x in range(10)], "y int, x int, v double")
    grid = lambda d, c="v": {(r.y, r.x): r[c] for r in d.collect()}
    assert grid(images.down(df))[1, 2] == pytest.approx(img[2:4, 4:6].mean())
    assert grid(images.up(df))[2, 3] == pytest.approx((img[1, 1] + img[1, 2]) / 2)
    targets = spark.createDataFrame([(0, 0, 1.5, 2.25), (0, 1, 7.0, 9.0), (0, 2, 7.5, 1.0)], "y int, x int, wy double, wx double")
    warped = grid(images.backward_warp(df, targets))
    assert warped[0, 0] == pytest.approx(0.5 * (0.75 * img[1, 2] + 0.25 * img[1, 3]) + 0.5 * (0.75 * img[2, 2] + 0.25 * img[2, 3])) and warped[0, 1] == img[7, 9] and math.isnan(warped[0, 2])
    t = grid(images.distance_transform(df, 0.1, 0, 0.2, 0, 10))
    yy, xx = np.mgrid[:8, :10]
    assert all(t[y, x] == pytest.approx((img + 0.2 * (yy - y) ** 2 + 0.1 * (xx - x) ** 2).min()) for y in range(8) for x in range(10))
    codes = images.local_binary_patterns(df, 4).collect()
    assert sum(r.n for r in codes) == 48
    assert images.harris(df, 1.0).count() == 80
    blended = grid(images.blend(df.where("x < 6"), df.where("x >= 4").withColumn("v", F.lit(0.0))))
    assert blended[0, 5] == pytest.approx(img[0, 5] / 2) and blended[0, 9] == 0 and blended[0, 1] == img[0, 1]
    assert images.mosaic(df.withColumn("i", F.lit(3)), "i", 2, 8, 10, 1).agg(F.min("y")).first()[0] == 9
    labels = images.superpixels(np.kron([[0.0, 1.0]], np.ones((10, 10))), 5, least=3)
    assert not set(np.unique(labels[:, :9])) & set(np.unique(labels[:, 11:]))
    blob = np.full((9, 9), 200)
    blob[3:6, 3:6] = 10
    assert images.fill_region(blob, (4, 4)).sum() == 9 and any(a == 9 for _, _, a in images.stable_regions(blob))
    assert images.whiten(img).shape == img.shape
    quick = cluster.quick_shift(df.withColumn("f", F.array("v")), 1.0, 2.0)
    assert quick.count() == 80 and quick.where("gap = double('Infinity')").count() >= 1
    assert images.soft_mask(spark.createDataFrame([(1, 5.0, 5.0, True), (1, 900.0, 5.0, False)], "frame int, x double, y double, good boolean"), spark.createDataFrame([(1, 6.0, 6.0)], "frame int, y double, x double")).first().m == pytest.approx(1)


def test_scalar_functions(spark):
    one = spark.range(1)
    v = F.array(F.lit(0.3), F.lit(-0.2), F.lit(0.5))
    r = one.select(S.inverse_rodrigues(S.rodrigues(v)).alias("v"), S.unhat(S.hat(v)).alias("h"), S.inverse3(S.rodrigues(v)).alias("i"), S.rodrigues(v).alias("m")).first()
    assert r.v == pytest.approx([0.3, -0.2, 0.5]) and r.h == pytest.approx([0.3, -0.2, 0.5])
    assert np.array(r.i).reshape(3, 3) == pytest.approx(np.array(r.m).reshape(3, 3).T)
    p = lambda *x: F.array(*(F.lit(float(c)) for c in x))
    c = one.select(S.collinear(p(0, 0), p(1, 1), p(2, 2)).alias("a"), S.collinear(p(0, 0), p(1, 1), p(2, 3)).alias("b"), S.in_quad(F.lit(0.5), F.lit(0.5), (F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(1.0), F.lit(1.0))).alias("c"), S.normalise_homogeneous(p(2, 4, 2)).alias("d"), S.frame_to_ellipse(p(1, 2, 3)).alias("e"), S.raised_cosine(0, F.lit(0.5)).alias("f")).first()
    assert (c.a, c.b, c.c, c.d, c.e, c.f) == (True, False, True, [1, 2, 1], [1, 2, 3, 0, 0, 3], 1.0)
    x, y, z = S.rgb_to_xyz(F.lit(0.2), F.lit(0.5), F.lit(0.7))
    back = one.select(*(b.alias(n) for b, n in zip(S.xyz_to_rgb(x, y, z), "rgb", strict=True)), S.xyz_to_lab(F.lit(1.0), F.lit(1.0), F.lit(1.0))[0].alias("l"), S.xyz_to_luv(F.lit(1.0), F.lit(1.0), F.lit(1.0))[0].alias("l2")).first()
    assert (back.r, back.g, back.b) == pytest.approx((0.2, 0.5, 0.7)) and back.l == pytest.approx(100) and back.l2 == pytest.approx(100)


def test_tracks(spark):
    labels = spark.createDataFrame([(t, w, 1 if t < 12 else 2) for t in range(20) for w in range(3)], "track_id long, window int, label int")
    pairs = {(r.u, r.v): (r.n, r.pruned) for r in tracks.co_membership(labels).where("window = 0").collect()}
    assert pairs == {(1, 1): (12, None), (2, 2): (8, 1e8)}
    good = labels.where("label = 1").select("window", "label").distinct()
    assert {r.verdict for r in tracks.background_verdict(labels, good).where("track_id < 12").collect()} == {1}
    pts = spark.createDataFrame([(1, f, 0.01 * f, 0.0) for f in range(4)], "track_id long, frame int, x double, y double")
    assert tracks.drop_repeats(pts, ["track_id"], "frame").count() == 1
    assert tracks.drop_repeats(pts.withColumn("x", F.col("x") * 100), ["track_id"], "frame", signed=True).count() == 1
    assert tracks.lifespans(pts, max_age=3).first().tail == 2


def test_frames_and_keypoints(spark, tmp_path):
    made = frames.write_frames(spark.createDataFrame([(3, b"c"), (10, b"j"), (None, b"x")], "frame_idx long, content binary"), f"file://{tmp_path}/f", "A%03d.jpg")
    assert made.count() == 2
    back = frames.read_frames(spark, f"file://{tmp_path}/f")
    assert sorted((r.frame_idx, bytes(r.content)) for r in back.collect()) == [(3, b"c"), (10, b"j")]
    assert frames.zip_frames(back, back.where("frame_idx = 3")).count() == 1
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.key").write_text("1 128\n5.5 6.5 2.0 0.25\n" + " ".join(map(str, range(128))))
    r = frames.read_keypoints(spark, str(tmp_path / "k")).first()
    assert r.frame == [7.5, 6.5, 2.0, -0.25] and r.descriptor[:9] == [0, 7, 6, 5, 4, 3, 2, 1, 8]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.txt").write_text("2\n1\n1 2 4 0 2 7 8\n")
    o = frames.read_keypoints(spark, str(tmp_path / "o"), "oxford").first()
    assert o.frame == [2.0, 3.0, 0.25, 0.0, 0.5] and o.descriptor == [7, 8]
    assert frames.pattern(spark, "checker", 16, 16).agg(F.avg("v")).first()[0] == 0.5


def test_stage_cache_keys_on_parameters(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert stages.stage(spark, str(tmp_path), "s", params, make).count() == 3
    assert len(calls) == 2


def test_streams(spark, tmp_path):
    rows = [(1, f) for f in [1, 2, 3, 7, 8]] + [(2, f) for f in range(1, 12)]
    spark.createDataFrame(rows, "track_id long, frame long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("track_id long, frame long").parquet(f"{tmp_path}/in")
    q = streaming.track_lifecycle(stream, max_age=5).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.track_id, r.head, r.tail) for r in spark.table("ended").collect()) == [(1, 1, 3), (2, 1, 5), (2, 6, 10)]
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 15) AS ts, 'a' AS event_type, 1.0D AS value FROM range(40)").coalesce(1).write.parquet(f"{tmp_path}/ev")
    ev = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(f"{tmp_path}/ev")
    q = streaming.sliding_counts(ev).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 80


def test_forest_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 24)).repeat(50, 0) + rng.normal(0, 0.4, (1000, 24))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    trees = forest.build(data, trees=4, leaf=16)
    indexed = forest.index(data, trees)
    assert indexed.count() == 4000
    asked = data.where("id % 100 = 0")
    want = {(r.q, r.id) for r in distance.nearest_neighbours(asked, data, 7).collect()}
    got = {(r.q, r.id) for r in forest.query(asked, indexed, trees, 7, 12).collect()}
    assert len(want & got) >= 0.9 * len(want)
    every = {(r.q, r.id) for r in forest.query(asked, indexed, trees, 7, 10_000).collect()}
    assert every == want


def _paths(spark, n=3, cells=2):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    shift = [1.0, 0.0, 4.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0]
    return spark.createDataFrame([(f, r, c, shift, eye) for f in range(1, n + 1) for r in range(1, cells + 1) for c in range(1, cells + 1)], "frame int, row int, col int, p array<double>, c array<double>")


def test_path_updates_keep_a_common_shift(spark):
    paths = _paths(spark)
    affinity = spark.createDataFrame([(t, r, 0.5) for t in (1, 2, 3) for r in (1, 2, 3) if t != r], "t int, r int, w double")
    out = alignment.optimise_paths(paths, affinity, 2, smoothness=1.0, weight=0.5, span=1, n_frames=3).collect()
    assert len(out) == 12 and all(r.p == pytest.approx([1, 0, 4, 0, 1, -2, 0, 0, 1]) for r in out)
    target = paths.select("frame", "row", "col", F.col("c").alias("s"), F.lit(3.0).alias("boost"))
    moved = alignment.update_paths(paths, affinity, 0.0, 0.0, target, 1.0).first()
    assert moved.p[2] == pytest.approx(1.0)
    assert alignment.mean_offset(paths).first().offset == pytest.approx([1, 0, 4, 0, 1, -2, 0, 0, 1])
    mesh = {(r.i, r.j): (r.x, r.y) for r in alignment.target_mesh(paths.where("frame = 1"), 100, 60, 2).collect()}
    assert len(mesh) == 9 and mesh[1, 2] == pytest.approx((105, 29))


def test_control_points(spark):
    paths = _paths(spark, 2)
    rows = [(f, k, 10.0 + k, 20.0, 10.0 + k + (0.5 if k < 25 else 90.0), 20.0) for f in (1, 2) for k in range(30 if f == 1 else 5)]
    pts = spark.createDataFrame(rows, "frame int, k int, xa double, ya double, xb double, yb double")
    eye = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    aligned = alignment.aligned_points(pts, paths, paths, eye, 200, 60, 2)
    assert aligned.where("k = 0").first().d == pytest.approx(0.5)
    kept = alignment.reject_points(aligned)
    assert kept.count() == 25 and kept.select("frame").distinct().count() == 1
    r = alignment.alignment_summary(kept).first()
    assert r.n_points == 25 and r.error == pytest.approx(0.5)
    st = {(x.frame, x.k): (x.ax, x.bx) for x in alignment.stitched_points(pts, kept, paths, paths, eye, eye, 200, 60, 2, 500, 1, 1).collect()}
    assert st[1, 0] == pytest.approx((514, 514.5)) and st[1, 29] == (-1, -1) and len(st) == 30
    assert alignment.points_per_cell(pts, "xa", "ya", 200, 60, 2).agg(F.sum("n")).first()[0] == 35
    mask = spark.createDataFrame([(1, 20, x, 1.0) for x in range(10, 20)], "frame int, y int, x int, m double")
    assert alignment.refine_points(pts, mask, mask.withColumn("x", F.col("x") + 1)).count() == 10
    assert alignment.overlap_score(pts.where("k < 5"), mask).first().score == pytest.approx(0.5)


def test_label_affinity_and_ranks(spark):
    points = spark.createDataFrame([(0, 1, k) for k in range(3)], "window int, frame int, k int")
    masks = spark.createDataFrame([(0, 1, k, s, 1, 0.5) for k in range(3) for s in "ab"], "window int, frame int, k int, side string, label int, m double")
    assert tracks.label_affinity(points, masks, 40, 2.0).first().w == pytest.approx(math.exp(-2 * 0.75 / 40))
    rows = spark.createDataFrame([(0, 1, 2, t, f, float(f * (t + 1)), 0.0) for t in range(3) for f in range(5)], "window int, u int, v int, track_id long, frame int, x double, y double")
    assert coding.edge_ranks(rows, 0.1).first().w == pytest.approx(math.exp(-0.3) / 4)


def test_small_helpers(spark):
    flipped = spark.createDataFrame([([float(i) for i in range(58)],)], "h array<double>").select(alignment.flip_patterns(alignment.flip_patterns(F.col("h"))).alias("h")).first().h
    assert flipped == [float(i) for i in range(58)]
    assert alignment.override({"a": {"b": 1, "c": 2}}, {"A": {"b": 3}, "z": 1}, skip=True, ignore_case=True) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(KeyError):
        alignment.override({}, {"x": 1}, strict=True)
    assert geometry.derivative(lambda v: [v[0] * v[1]], [2.0, 3.0]) == pytest.approx(np.array([[3.0, 2.0]]))


def test_forest_returns_few_rows_of_a_block(spark):
    """A query meets its leaves' rows in blocks that return their best: 60 queries over 30,000 rows in one leaf make no row a pair."""
    x = np.random.RandomState(12).normal(size=(30_000, 8))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 20, "id long, v array<double>").repartition(4).cache()
    trees = forest.build(data.limit(50), trees=1, leaf=100)
    got = {(r.q, r["rank"]): r.id for r in forest.query(data.where("id % 500 = 7").distinct(), forest.index(data, trees), trees, 7, 1, bounded=True).collect()}
    for q in range(7, 30_000, 500):
        want = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:7]
        assert [got[q, r] for r in range(1, 8)] == want.tolist()
    plan = forest.query(data.where("id % 500 = 7"), forest.index(data, trees), trees, 7, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_bounded_forest_query_misses_none(spark):
    """Few leaves of a table without clusters miss most neighbours; a bounded query goes on until none can be missed."""
    x = np.random.default_rng(3).normal(size=(3000, 16))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    trees = forest.build(data, trees=2, leaf=16)
    indexed, asked = forest.index(data, trees), data.where("id % 100 = 0")
    want = {(r.q, r.id) for r in distance.nearest_neighbours(asked, data, 7).collect()}
    assert len(want & {(r.q, r.id) for r in forest.query(asked, indexed, trees, 7, 2).collect()}) < 0.9 * len(want)
    assert {(r.q, r.id) for r in forest.query(asked, indexed, trees, 7, 2, bounded=True).collect()} == want


def test_queries_take_whole_vectors(spark, tmp_path):
    """gmm and coding_bits depend on every component of the embeddings."""
    from trackloom.plans import queries_images, queries_matching

    x = np.random.default_rng(2).normal(size=(120, 10))
    results = []
    for k, scale in enumerate((1.0, 3.0)):
        x[:, 9] *= scale
        spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        mixture = queries_matching.gmm(spark, f"{tmp_path}/{k}").collect()
        assert all(len(r["mean"]) == len(r.variance) == 10 for r in mixture)
        results.append({r.label: r.bits for r in queries_images.coding_bits(spark, f"{tmp_path}/{k}").collect()})
    assert all(results[0][k] < results[1][k] for k in results[0])


def test_distance_transform_reaches_the_whole_image(spark):
    pixels = spark.createDataFrame([(y, x, 0.0 if (y, x) == (0, 0) else 1e9) for y in range(2) for x in range(150)], "y int, x int, v double")
    got = {(r.y, r.x): (r.v, r.ay, r.ax) for r in images.distance_transform(pixels).collect()}
    assert all(got[y, x] == (x * x + y * y, 0, 0) for y in range(2) for x in range(150))
    at = spark.createDataFrame([(1, 0.0, 0.0)], "frame int, y double, x double")
    points = spark.createDataFrame([(1, 450.0, 0.0, True), (1, 451.0, 0.0, False)], "frame int, x double, y double, good boolean")
    assert 0.5 < images.soft_mask(points, at).first().m < 0.6
