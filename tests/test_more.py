"""Solvers, descriptors and stateful operators beyond what the SQL twins hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.twister import Twister
from trackloom.operators import alignment as A
from trackloom.operators import cluster as C
from trackloom.operators import coding as L
from trackloom.operators import descriptors as V
from trackloom.operators import distance as D
from trackloom.operators import flow as Q
from trackloom.operators import geometry as H
from trackloom.operators import keypoints as K
from trackloom.operators import svm as M
from trackloom.plans import runtime
from trackloom.streaming import tracks as R


def test_homography_memory_grows_with_its_points():
    """The decomposition keeps no square of the points: its left vectors alone would be 288 MB here."""
    import tracemalloc

    a = np.random.RandomState(3).uniform(0, 500, (3000, 2))
    h = np.array([[1.02, 0.03, 4.0], [-0.02, 0.97, -3.0], [0.00002, 0.00001, 1.0]])
    tracemalloc.start()
    got = H.dlt(a, H.apply(h, a))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, h, atol=1e-7) and most < 20e6
    assert np.allclose(H.dlt(a[:4], H.apply(h, a[:4])), h, atol=1e-6)


def test_mesh_of_many_points():
    """Control points are added up by corner, not one at a time; each counts once with its weight."""
    import time

    rnd = np.random.RandomState(5)
    a = rnd.uniform([1, 1], [500, 720], (300_000, 2))
    b = a @ np.array([[1.01, 0.02], [-0.01, 0.98]]).T + [3.0, 2.0]
    began = time.time()
    _, local = H.similar_warp(a, b, 500.0, 720.0, 4)
    assert time.time() - began < 5
    assert np.allclose(np.concatenate([H.apply(h, a[:50]) for h in local.reshape(-1, 3, 3)]), np.tile(b[:50], (16, 1)), atol=0.05)
    few, pulled = a[:40], b[:40] + rnd.normal(size=(40, 2))
    once, twice = H.similar_warp(few, pulled, 500.0, 720.0, 4, 1.0)[0], H.similar_warp(np.r_[few, few], np.r_[pulled, pulled], 500.0, 720.0, 4, 2.0)[0]
    assert np.allclose(once, twice, atol=1e-6)


def test_edge_ranks_of_many_groups(spark):
    """Ranks by groups of one and of several tracks, with gaps, repeated and missing entries; many small groups take no call each."""
    import math
    import time

    rnd = np.random.RandomState(8)
    rows = [(0, 1, 1, t, f, float(x), float(x)) for t in range(3) for f, x in enumerate(rnd.normal(size=6))]
    rows += [(0, 2, 1, t, f, (t + 1) * (f + 1.0), (t + 1) * (2.0 - f)) for t in range(3) for f in range(6)]
    rows += [(0, 3, 1, 0, 0, 1.0, 2.0), (0, 3, 1, 0, 0, 3.0, 4.0), (0, 3, 1, 1, 1, None, None), (0, 3, 1, None, 1, 1.0, 1.0), (0, 4, 1, 0, 0, 0.0, 0.0)]
    got = {r["u"]: (r["n"], r["w"]) for r in L.edge_ranks(spark.createDataFrame(rows, "window int, u int, v int, track_id long, frame int, x double, y double"), 0.1).collect()}
    want = {1: (3, 3), 2: (3, 1), 3: (1, 1), 4: (1, 0)}
    assert got == {u: (n, pytest.approx(math.exp(-0.1 * n) * rank / 4)) for u, (n, rank) in want.items()}
    many = spark.range(40_000).select(F.lit(0).alias("window"), F.col("id").cast("int").alias("u"), F.lit(0).alias("v"), F.col("id").alias("track_id"), F.lit(1).alias("frame"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    began = time.time()
    assert L.edge_ranks(many, 0.1).where("n = 1").count() == 40_000
    assert time.time() - began < 20


def test_coding_lengths_of_many_groups(spark):
    """Sums as columns and as terms give each group's own length; many small groups take no call each."""
    import time

    rnd = np.random.RandomState(9)
    for dims in (2, 14):
        rows = [(k, rnd.normal(size=dims).tolist()) for k in (0, 1, None) for _ in range(20 + (k or 0))]
        for affine in (False, True):
            got = {r["k"]: (r["m"], r["bits"]) for r in L.grouped_lengths(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", 0.5, affine).collect()}
            for k in (0, 1, None):
                w = np.array([v for label, v in rows if label == k]).T
                assert got[k] == (w.shape[1], pytest.approx(L.coding_length(w, 0.25, len(rows), affine)))
    many = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.array(F.col("id") / 7.0, F.lit(1.0)).alias("v"))
    began = time.time()
    assert L.grouped_lengths(many, "k", "v", 0.5).where("m = 4").count() == 50_000
    assert time.time() - began < 20


def test_twister_numbers_of_every_seed(spark):
    """The query returns the numbers themselves: the published ones for the default seed, the generator's for each supplier."""
    from trackloom.plans import catalog

    rows = {r["seed"]: r for r in catalog.QUERIES["twister_numbers"](spark, "/root/testdata/sf0.001").collect()}
    published = [0.8147236863931789, 0.9057919370756192, 0.12698681629350606, 0.9133758561390194, 0.6323592462254095]
    assert [rows[5489][f"x{i}"] for i in range(7)] == [*published, *published[3:]]
    assert len(rows) > 1
    for seed, r in rows.items():
        want = np.random.RandomState(seed).random_sample(5).tolist()
        assert [r[f"x{i}"] for i in range(7)] == [*want, *want[3:]]


def test_twister_state():
    t = Twister(3)
    t.rand(5, 2)
    at = t.state
    a = t.rand(7)
    t.state = at
    assert np.array_equal(a, t.rand(7)) and len(at[0]) == 624
    assert not np.array_equal(Twister([1, 2]).rand(3), Twister([1, 3]).rand(3))


def test_second_derivative():
    f = lambda x: x[0] ** 3 + 2 * x[0] * x[1] + np.sin(x[1])
    got = H.second_derivative(f, np.array([1.5, 0.3]))
    assert np.allclose(got, [[9.0, 2.0], [2.0, -np.sin(0.3)]], atol=1e-4)


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(0)
    rows = [((rng.normal(0, 1, 2) + (2.0 if i % 2 else -2.0)).tolist(), 1 if i % 2 else -1) for i in range(200)]
    return spark.createDataFrame(rows, "x array<double>, y int").repartition(4).cache()


def test_dual_and_primal_agree(two_classes):
    w, b, primal = M.train(two_classes, 0.01, steps=150)
    u, c, dual = M.train_dual(two_classes, 0.01, rounds=12)
    assert dual <= primal + 0.01 and primal <= dual + 0.05
    assert np.dot(w, u) / np.linalg.norm(w) / np.linalg.norm(u) > 0.98
    _, _, part = M.train(two_classes, 0.01, steps=150, batch=0.3)
    assert part < 2 * primal + 0.05


def test_kmeans_repetitions_and_mixture_starts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.1, 2) + [(i % 4) // 2 * 5, i % 2 * 5]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>").cache()
    energies = [C.kmeans(df, 4, seed=s)[2] for s in range(4)]
    assert C.kmeans(df, 4, repetitions=4)[2] == min(energies)
    for init in ("rand", "kmeans"):
        means, covs, priors, _ = C.fit_gmm(df, 4, init, repetitions=2)
        assert len(means) == 4 and abs(sum(priors) - 1) < 1e-9
        q = C.gmm_posteriors(df, means, covs, priors).collect()
        assert len(q) == 200 and all(abs(sum(r["q"]) - 1) < 1e-9 for r in q)


def test_nearest_centre_keeps_repeated_ids(spark, monkeypatch):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [5.0, 5.0]), (None, [4.0, 5.0])], "id long, v array<double>")
    centres = spark.createDataFrame([(7, [0.0, 1.0]), (9, [5.0, 4.0])], "centre int, c array<double>")
    want = [(None, 9, 2.0), (1, 7, 1.0), (1, 9, 1.0)]
    for most in (10_000, 1):
        monkeypatch.setattr(D, "MOST_CENTRES", most)
        got = sorted(((r.id, r.centre, r.d) for r in D.push_centres(df, centres).collect()), key=str)
        assert got == sorted(want, key=str)
    assert D.push_centres(df, centres.limit(0)).count() == 0


def test_references_by_blocks_and_by_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(6).tolist(), "n") for i in range(20)] + [(30, None, None), (31, [1.0, 2.0], "x"), (32, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (33, [0.0] * 6, "z")]
    df = spark.createDataFrame(rows, "id long, v array<double>, name string")
    refs = spark.createDataFrame([(k, rng.random(6).tolist()) for k in range(3)] + [(9, [0.0] * 6)], "k int, c array<double>")
    metrics = [*D.TERMS, "linf"]
    tables = []
    for most in (10_000, 1):
        monkeypatch.setattr(D, "MOST_CENTRES", most)
        tables.append({(r.id, r.k): r for r in D.to_references(df, refs, metrics).collect()})
    assert len(tables[0]) == len(tables[1]) == 24 * 4
    for at, r in tables[0].items():
        s = tables[1][at]
        assert r.name == s.name
        assert all((r[m] is None) == (s[m] is None) and (r[m] is None or abs(r[m] - s[m]) < 1e-9) for m in metrics), at


def image(spark, values):
    return spark.createDataFrame([(y, x, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "y int, x int, v double")


def test_oriented_gradients_of_the_mirrored_image(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (24, 24))
    no = 9

    def features(values):
        cells = V.cell_orientations(image(spark, values), 8, no)
        return {(int(r.cy), int(r.cx), r.f): r.v for r in V.oriented_gradients(cells, no).collect()}

    one, other = features(a), features(a[:, ::-1])
    for (cy, cx, f), v in one.items():
        if f < 2 * no:  # direction t becomes pi - t
            mirrored = (no - f) % (2 * no)
        elif f < 3 * no:
            mirrored = 2 * no + (no - (f - 2 * no)) % no
        else:  # the four blocks change sides
            mirrored = 3 * no + [1, 0, 3, 2][f - 3 * no]
        assert abs(other.get((cy, 2 - cx, mirrored), 0.0) - v) < 1e-6
    assert max(one.values()) <= 0.2 * 2 * no and {f for *_, f in one} <= set(range(31))


def test_multi_scale_descriptors(spark):
    rng = np.random.default_rng(3)
    df = image(spark, rng.normal(0, 1, (30, 30)))
    rows = V.multi_scale_descriptors(df, [3, 4], 6).collect()
    assert {r.size for r in rows} == {3, 4} and all(0 <= r.v <= 255 and 0 <= r.bin < 128 for r in rows)
    norms = {}
    for r in rows:
        norms[r.size, r.y, r.x] = norms.get((r.size, r.y, r.x), 0) + r.v**2
    assert all(450 < n**0.5 <= 512 for n in norms.values())


def test_keypoints_of_a_shifted_image_match(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(0, 10, (40, 44))
    for axis in (0, 1):
        a = (a + np.roll(a, 1, axis) + np.roll(a, -1, axis)) / 3
    b = np.roll(a, (2, 3), (0, 1))
    for method in ("dog", "hessian"):
        rows = K.detect_and_match(image(spark, a), image(spark, b), method, 0.001, 1.2, sigmas=[0.6, 0.8, 1.1, 1.5, 2.0]).collect()
        right = [(r.xb - r.xa, r.yb - r.ya) == (3.0, 2.0) for r in rows]
        assert len(rows) >= 4 and sum(right) >= 0.8 * len(rows), method
    corners = K.detect(image(spark, a), "harris", [1.0, 1.3, 1.7], 0.0)
    assert corners.where("r > 0").count() > 0
    with pytest.raises(ValueError):
        K.detect(image(spark, a), "other")


def test_intensity_orders_of_the_turned_patch(spark):
    rng = np.random.default_rng(8)
    patch = rng.random((21, 21))
    d = V.intensity_orders(patch)
    assert len(d) == 144 and abs(np.linalg.norm(d) - 1) < 1e-9
    # a turn by a right angle permutes places, not orders: the disc and its circles are the same
    assert np.allclose(d, V.intensity_orders(np.rot90(patch)), atol=1e-6)
    assert not V.intensity_orders(np.zeros((9, 9))).any()
    rows = V.patch_descriptors(image(spark, patch).withColumn("k", F.lit(1)), ["k"]).collect()
    assert np.allclose([dict((r.bin, r.v) for r in rows).get(i, 0.0) for i in range(144)], d)


def stream_of(spark, tmp_path, df, name, batches):
    """``df`` as files that a stream reads one at a time, in the order of ``batch``."""
    for i in range(batches):
        df.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def collected(spark, tmp_path, stream, name):
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start(str(tmp_path / f"{name}-out"))
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_carried_seams_are_those_of_the_whole_clip(spark, tmp_path):
    rng = np.random.default_rng(4)
    h, w, n = 5, 8, 4
    rows, frames = [], []
    for f in range(n):
        a, b = rng.integers(0, 255, (2, h, w, 3), dtype=np.uint8)
        ca, cb = np.ones((h, w), bool), np.ones((h, w), bool)
        ca[:, -2:], cb[:, :2] = False, False
        frames.append((a, b, np.zeros((h, w)), np.zeros((h, w)), ca, cb))
        rows.append((f, 1, f, h, w, *(bytearray(x.tobytes()) for x in (a, b)), *(bytearray(x.astype(np.uint8).tobytes()) for x in (ca, cb))))
    df = spark.createDataFrame(rows, "batch int, clip long, frame long, height int, width int, a binary, b binary, cover_a binary, cover_b binary")
    stream = stream_of(spark, tmp_path, df, "seams", n)
    got = {r.frame: np.frombuffer(r["mask"], np.uint8).reshape(h, w) for r in collected(spark, tmp_path, R.carry_seams(stream), "seams").collect()}
    want = Q.seam_clip(frames)
    assert sorted(got) == list(range(n)) and all(np.array_equal(got[f], want[f]) for f in range(n))


def test_matches_are_carried(spark, tmp_path):
    match = "array<struct<xa: double, ya: double, xb: double, yb: double>>"
    moved = "array<struct<xa: double, ya: double, ua: double, va: double, xb: double, yb: double, ub: double, vb: double, error: double>>"
    rows = [
        (0, 1, 0, [(1.0, 1.0, 2.0, 2.0), (5.0, 5.0, 6.0, 6.0)], []),
        (1, 1, 1, [(9.0, 9.0, 9.0, 9.0), (1.4, 1.0, 7.0, 7.0)], [(1.0, 1.0, 1.5, 1.0, 2.0, 2.0, 2.5, 2.0, 0.2), (5.0, 5.0, 5.5, 5.0, 6.0, 6.0, 6.5, 6.0, 3.0)]),
    ]
    df = spark.createDataFrame(rows, f"batch int, clip long, frame long, fresh {match}, moved {moved}")
    out = collected(spark, tmp_path, R.propagate_matches(stream_of(spark, tmp_path, df, "matches", 2)), "matches").collect()
    got = sorted((r.frame, r.k, r.xa, r.xb) for r in out)
    # the second point is lost by its error; of the fresh ones the second lies in another pixel than the carried
    assert got == [(0, 0, 1.0, 2.0), (0, 1, 5.0, 6.0), (1, 0, 1.5, 2.5), (1, 1, 9.0, 9.0), (1, 2, 1.4, 7.0)]


def test_best_agreement_beyond_six_groups():
    a = np.arange(80) % 8
    assert L.misclassified(a, (a + 3) % 8) == 0.0
    assert L.misclassified(np.array([1, 1, 2, 2]), np.array([5, 5, 5, 9])) == 0.25


def test_corrupted_entries_are_repaired():
    rng = np.random.default_rng(6)
    w = rng.normal(0, 1, (12, 3)) @ rng.normal(0, 1, (3, 20))
    bad = w.copy()
    bad[4, 7] += 5.0
    fixed = L.repair_corrupted(bad)
    assert abs(fixed[4, 7] - w[4, 7]) < 0.5 < abs(bad[4, 7] - w[4, 7])
    assert L.process(bad, "corrupted", dims=3).shape == (3, 20)
    known = np.ones_like(w, bool)
    known[2, 3] = False
    assert np.allclose(L.process(w, "incomplete", known, projected=False), w, atol=1e-3)


def test_offset_puts_the_middle_frame_on_the_first_clip(spark):
    shift = lambda x, y: [1.0, 0.0, x, 0.0, 1.0, y, 0.0, 0.0, 1.0]
    rows = [(f, r, c, shift(3.0 + r, 4.0 + c), shift(1.0, 2.0)) for f in (1, 2, 3, 4) for r in (1, 2) for c in (1, 2)]
    paths = spark.createDataFrame(rows, "frame int, row int, col int, p array<double>, c array<double>")
    same = np.array(A.aligned_offset(paths, paths, shift(0.0, 0.0), 100.0, 80.0, 2)).reshape(3, 3)
    # both clips alike: only the mean offset is taken back
    assert np.allclose(same / same[2, 2], np.linalg.inv(np.array(shift(3.5, 3.5)).reshape(3, 3)), atol=1e-9)
    other = np.array(A.aligned_offset(paths, paths, shift(2.0, 0.0), 100.0, 80.0, 2)).reshape(3, 3)
    assert np.allclose(other / other[2, 2], np.array(shift(-4.5, -3.5)).reshape(3, 3), atol=1e-9)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embedded(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def test_kmeans_query_converges_to_means(spark, embedded):
    ids, x, _ = embedded
    centres, assigned, energy = C.kmeans(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>"), 8, iterations=100)
    centres, got = np.array(centres), {r.id: (r.centre, r.d) for r in assigned.collect()}
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert [got[i][0] for i in ids] == d.argmin(1).tolist() and abs(energy - d.min(1).sum()) < 1e-6
    for k in range(8):
        assert np.allclose(centres[k], x[d.argmin(1) == k].mean(0), atol=1e-6)


def test_gmm_query_by_numpy(spark, embedded):
    from trackloom.plans import catalog

    _, x, _ = embedded
    mu, s2, p = np.array([[0.5] * 64, [-0.5] * 64]), np.array([x.var(0)] * 2), np.array([0.5, 0.5])
    for _ in range(4):
        logs = np.log(p) - 0.5 * (np.log(2 * np.pi * s2) + (x[:, None] - mu) ** 2 / s2).sum(-1)
        z = np.logaddexp(logs[:, 0], logs[:, 1])
        q = np.exp(logs - z[:, None])
        n = q.sum(0)
        p, mu = n / len(x), q.T @ x / n[:, None]
        s2 = np.maximum(q.T @ x**2 / n[:, None] - mu**2, 1e-6)
    got = sorted(catalog.QUERIES["gmm"](spark, SF).collect(), key=lambda r: r.k)
    assert np.allclose([r["mean"] for r in got], mu, atol=1e-6) and np.allclose([r.variance for r in got], s2, atol=1e-6)
    assert np.allclose([r.prior for r in got], p) and abs(got[0].loglik - z.sum()) < 1e-4


def test_coding_bits_query_by_numpy(spark, embedded):
    from trackloom.plans import catalog

    _, x, label = embedded
    got = {r.label: (r.m, r.bits) for r in catalog.QUERIES["coding_bits"](spark, SF).collect()}
    for k in np.unique(label):
        part = x[label == k].T
        m, bits = got[int(k)]
        assert m == part.shape[1] and abs(bits - L.coding_length(part, 0.25, len(x))) < 1e-3


def test_homographies_query_repeats_itself(spark):
    from trackloom.plans import catalog

    one, other = (sorted(map(str, catalog.QUERIES["homographies"](spark, SF).collect())) for _ in range(2))
    assert one == other and len(one) == 24


def test_runtime(spark):
    info = runtime.runtime_info(spark)
    before = runtime.set_threads(spark, 3)
    assert info["shuffle_partitions"] == before and runtime.set_threads(spark, before) == 3
    assert info["spark"].startswith("4") and info["threads"] >= 1
