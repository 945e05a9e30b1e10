"""Scale-space features: turned, scaled and sheared images, tiles, and the defined cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import features as T


def textured(h=96, w=80, seed=3):
    return T.blurred(np.random.RandomState(seed).rand(h, w), 2.0) * 100


def table_of(spark, images):
    rows = [(name, y, x, float(v)) for name, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image string, y int, x int, v double")


def found(spark, images, **options):
    octaves = options.pop("octaves", None)
    doubled = options.pop("doubled", False)
    out: dict[str, list] = {name: [] for name in images}
    for r in T.features(table_of(spark, images), T.Options(**options), octaves, doubled=doubled).collect():
        out[r["image"]].append(r)
    return out


def matched(a, b, ratio=1.5):
    """Places in ``b`` of the features of ``a`` that pass the ratio test."""
    x, y = (np.array([r["d"] for r in side], float) for side in (a, b))
    d = ((x[:, None] - y[None]) ** 2).sum(2)
    order = np.argsort(d, 1)
    near = np.take_along_axis(d, order[:, :2], 1)
    return [(i, order[i, 0]) for i in range(len(a)) if ratio**2 * near[i, 0] < near[i, 1]]


def test_turned_and_scaled_copies_match(spark):
    image = textured()
    h, w = image.shape
    ys, xs = np.meshgrid(np.arange(2 * h) / 2, np.arange(2 * w) / 2, indexing="ij")
    got = found(spark, {"plain": image, "turned": np.rot90(image), "large": T.sampled(image, ys, xs)}, peak=0.05)
    pairs = matched(got["plain"], got["turned"])
    assert len(pairs) > 0.85 * len(got["plain"])
    turn = []
    for i, j in pairs:
        a, b = got["plain"][i], got["turned"][j]
        if abs(w - 1 - a["x"] - b["y"]) + abs(a["y"] - b["x"]) < 1e-6:
            turn.append(abs((a["angle"] - b["angle"] - math.pi / 2 + math.pi) % T.TURN - math.pi))
    assert len(turn) > 0.9 * len(pairs) and np.median(turn) < 1e-6
    pairs = matched(got["plain"], got["large"])
    off = [abs(2 * got["plain"][i]["x"] - got["large"][j]["x"]) + abs(2 * got["plain"][i]["y"] - got["large"][j]["y"]) for i, j in pairs]
    assert len(pairs) > 0.8 * len(got["plain"]) and np.median(off) < 0.3 and np.percentile(off, 90) < 1
    assert abs(np.median([got["large"][j]["sigma"] / got["plain"][i]["sigma"] for i, j in pairs]) - 2) < 0.1


def test_an_image_turned_by_any_angle_matches(spark):
    image, a = textured(110, 110, 5), math.radians(25)
    yy, xx = np.mgrid[:110, :110] - 54.5
    turned = T.sampled(image, 54.5 - math.sin(a) * xx + math.cos(a) * yy, 54.5 + math.cos(a) * xx + math.sin(a) * yy)
    got = found(spark, {"plain": image, "turned": turned}, peak=0.05, octaves=2)
    inner = [r for r in got["plain"] if math.hypot(r["x"] - 54.5, r["y"] - 54.5) < 35]
    good = 0
    for i, j in matched(inner, got["turned"]):
        p, q = inner[i], got["turned"][j]
        x, y = q["x"] - 54.5, q["y"] - 54.5
        good += math.hypot(54.5 + math.cos(a) * x + math.sin(a) * y - p["x"], 54.5 - math.sin(a) * x + math.cos(a) * y - p["y"]) < 1
    assert good > 0.6 * len(inner)


@pytest.mark.parametrize("method", ["dog", "harris_laplace"])
def test_tiles_do_not_change_results(spark, method):
    image = textured(150, 130, 9)
    keys = ("octave", "y", "x", "sigma", "angle", "response", "shape", "d")
    whole, cut = (sorted(tuple(r[k] for k in keys) for r in found(spark, {"a": image}, peak=0.05, method=method, tile=tile)["a"]) for tile in (512, 40))
    assert len(whole) > 20 and whole == cut


def test_a_sheared_blob_gives_its_ellipse(spark):
    yy, xx = np.mgrid[:121, :121] - 60.0
    spread = np.array([[25.0, 9.0], [9.0, 9.0]])
    p = np.linalg.inv(spread)
    blob = 100 * np.exp(-0.5 * (p[0, 0] * xx * xx + 2 * p[0, 1] * xx * yy + p[1, 1] * yy * yy))
    values, vectors = np.linalg.eigh(spread)
    want = vectors @ np.diag(np.sqrt(values)) @ vectors.T
    want /= math.sqrt(np.linalg.det(want))
    for method in ("dog", "multiscale_hessian"):
        got = found(spark, {"a": blob}, method=method, affine=True, oriented=False, peak=1e-3, octaves=1)["a"]
        near = [r for r in got if math.hypot(r["x"] - 60, r["y"] - 60) < 1]
        assert near and all(np.abs(np.reshape(r["shape"], (2, 2)) / r["sigma"] - want).max() < 0.05 for r in near)
    plain = [r for r in found(spark, {"a": blob}, oriented=False, octaves=1, peak=1e-3)["a"] if math.hypot(r["x"] - 60, r["y"] - 60) < 1]
    assert all(r["shape"] == [r["sigma"], 0.0, 0.0, r["sigma"]] for r in plain)


def test_sheared_copies_match_after_adaptation(spark):
    """Blobs of different neighbourhoods, in an image and in its sheared copy."""
    rnd = np.random.RandomState(2)
    image, shear = T.blurred(rnd.rand(140, 140), 3.0) * 300, np.array([[1.0, 0.45], [0.0, 1.0]])
    yy, xx = np.mgrid[:140, :140] - 69.5
    at = np.stack([xx, yy], -1) @ shear.T + 69.5
    copy = T.sampled(image, at[..., 1], at[..., 0])

    def correct(affine):
        got = found(spark, {"a": image, "b": copy}, affine=affine, peak=0.2, octaves=1)
        good = 0
        for i, j in matched(got["a"], got["b"], 1.2):
            p, q = got["a"][i], got["b"][j]
            back = shear @ np.array([q["x"] - 69.5, q["y"] - 69.5]) + 69.5
            good += math.hypot(back[0] - p["x"], back[1] - p["y"]) < 2.5
        return good

    assert correct(True) >= 8


@pytest.mark.parametrize("method", sorted(T.METHODS))
def test_blobs_are_found_at_their_scale(spark, method):
    image = np.zeros((90, 90))
    yy, xx = np.mgrid[:90, :90]
    for y, x, s in ((30, 30, 3.0), (60, 55, 5.0)):
        image += 100 * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s))
    got = found(spark, {"a": image}, method=method, peak=1e-3, oriented=False, described=False)["a"]
    if "harris" in method:
        return  # corners are elsewhere on a smooth blob; test_corners has them
    for y, x, s in ((30, 30, 3.0), (60, 55, 5.0)):
        near = [r["sigma"] for r in got if math.hypot(r["y"] - y, r["x"] - x) < 1.5]
        assert near
        if method in ("hessian", "hessian_laplace"):
            assert min(abs(math.log2(v / s)) for v in near) < 0.4
        if method == "dog":  # a difference of blurs peaks at a fixed part of the blob's size
            assert min(abs(math.log2(v / s)) for v in near) < 0.6


def test_corners(spark):
    image = np.zeros((80, 80))
    image[20:60, 25:55] = 100
    for method in ("multiscale_harris", "harris_laplace"):
        got = found(spark, {"a": image}, method=method, peak=1.0, oriented=False, described=False)["a"]
        assert got
        for r in got:
            if r["sigma"] < 4:
                assert min(math.hypot(r["y"] - y, r["x"] - x) for y in (19.5, 59.5) for x in (24.5, 54.5)) < 2.5 * r["sigma"]


def test_defined_cases(spark):
    got = found(spark, {"flat": np.ones((20, 20)), "dot": np.ones((1, 1)), "line": np.arange(30.0)[None, :], "large": textured(40, 40)}, peak=0.05)
    assert not got["flat"] and not got["dot"] and not got["line"] and got["large"]
    assert found(spark, {"a": textured(40, 40)}, peak=0.05, doubled=True)["a"]
    pixels = table_of(spark, {"a": textured(40, 40)})
    assert T.features(pixels.limit(0)).collect() == []
    assert T.features(pixels.withColumn("v", F.lit(None).cast("double"))).collect() == []
    named = pixels.withColumnRenamed("image", "clip").withColumn("tx", F.lit(9)).withColumn("lo_y", F.lit(9))
    assert T.features(named, T.Options(peak=0.05), image="clip").count() == len(found(spark, {"a": textured(40, 40)}, peak=0.05)["a"])
    with pytest.raises(ValueError):
        T.features(pixels, T.Options(method="surf"))
