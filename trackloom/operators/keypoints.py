"""Keypoints of pixel tables (``y, x, v``): scale-space extrema, upright descriptors, and matches of two images.

A scale space is the image blurred by each of a few sigmas, a layer each.  All
steps are offset joins and aggregations over pixels, so an image need not fit
a task.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.descriptors import dense_descriptors
from trackloom.operators.distance import ratio_match
from trackloom.operators.images import gaussian_weights, harris, smooth
from trackloom.plans.stages import durable

#: Sigmas of an octave and a little more: ratios of 2 to the 1/3.
SIGMAS = [1.6 * 2 ** (k / 3) for k in range(6)]


def scale_space(pixels: DataFrame, sigmas: list[float] = SIGMAS) -> DataFrame:
    """``s, y, x, v``: a layer for each sigma, by its number."""
    parts = [smooth(pixels.select("y", "x", "v"), gaussian_weights(sigma)).select(F.lit(s).alias("s"), "y", "x", "v") for s, sigma in enumerate(sigmas)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return durable(out)


def differences(space: DataFrame) -> DataFrame:
    """``s, y, x, r``: each layer taken off the next."""
    onward = space.select((F.col("s") - 1).alias("s"), "y", "x", F.col("v").alias("__next"))
    return space.join(onward, ["s", "y", "x"]).select("s", "y", "x", (F.col("__next") - F.col("v")).alias("r"))


def _neighbours(df: DataFrame, offsets: list[tuple[int, int, int]], value: str) -> DataFrame:
    """``s, y, x, o, n``: the value ``n`` at every offset (by its number) from each pixel."""
    o = F.array(*(F.struct(F.lit(i).alias("o"), F.lit(a).alias("ds"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for i, (a, b, c) in enumerate(offsets)))
    sent = df.select("s", "y", "x", F.col(value).alias("n"), F.explode(o).alias("q"))
    return sent.select((F.col("s") - F.col("q.ds")).alias("s"), (F.col("y") - F.col("q.dy")).alias("y"), (F.col("x") - F.col("q.dx")).alias("x"), F.col("q.o").alias("o"), "n")


def hessians(space: DataFrame, sigmas: list[float] = SIGMAS) -> DataFrame:
    """``s, y, x, r``: the determinant of second differences, scaled by sigma to the 4; borders have none."""
    offsets = [(0, dy, dx) for dy, dx in product((-1, 0, 1), repeat=2)]
    near = _neighbours(space, offsets, "v").groupBy("s", "y", "x").agg(F.count("*").alias("c"), *(F.max(F.when(F.col("o") == i, F.col("n"))).alias(f"n{i}") for i in range(9))).where("c = 9")
    n: dict[tuple[int, int], Column] = {(dy, dx): F.col(f"n{i}") for i, (_, dy, dx) in enumerate(offsets)}
    xx, yy = n[0, 1] + n[0, -1] - 2 * n[0, 0], n[1, 0] + n[-1, 0] - 2 * n[0, 0]
    xy = (n[1, 1] + n[-1, -1] - n[1, -1] - n[-1, 1]) / 4
    scale = F.element_at(F.array(*(F.lit(s**4) for s in sigmas)), F.col("s") + 1)
    return near.join(space.select("s", "y", "x"), ["s", "y", "x"], "left_semi").select("s", "y", "x", (scale * (xx * yy - xy * xy)).alias("r"))


def extrema(layers: DataFrame, threshold: float = 0.0, minima: bool = True) -> DataFrame:
    """``s, y, x, r``: places above (or below, with ``minima``) all of their 26 neighbours in space and
    scale, of at least ``threshold`` in size.  The outer layers and the borders have none."""
    offsets = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
    some = layers.where(F.abs("r") >= threshold)
    around = some.select("s", "y", "x", "r").join(_neighbours(layers, offsets, "r"), ["s", "y", "x"])
    best = around.groupBy("s", "y", "x", "r").agg(F.count("*").alias("c"), F.max("n").alias("hi"), F.min("n").alias("lo")).where(f"c = {len(offsets)}")
    return best.where((F.col("r") > F.col("hi")) | ((F.col("r") < F.col("lo")) if minima else F.lit(False))).select("s", "y", "x", "r")


def detect(pixels: DataFrame, method: str = "dog", sigmas: list[float] = SIGMAS, threshold: float = 0.0) -> DataFrame:
    """``y, x, sigma, r``: keypoints by extrema of differences of blurs (``dog``), of the Hessian's
    determinant (``hessian``), or of the corner measure of every layer (``harris``)."""
    space = scale_space(pixels, sigmas)
    if method == "dog":
        layers = differences(space)
    elif method == "hessian":
        layers = hessians(space, sigmas)
    elif method == "harris":
        parts = [harris(space.where(F.col("s") == s).select("y", "x", "v"), sigma).select(F.lit(s).alias("s"), "y", "x", (F.col("r") * sigma**4).alias("r")) for s, sigma in enumerate(sigmas)]
        layers = parts[0]
        for p in parts[1:]:
            layers = layers.unionByName(p)
    else:
        raise ValueError(f"method: {method}")
    found = extrema(durable(layers), threshold, minima=method == "dog")
    return found.select("y", "x", F.element_at(F.array(*map(F.lit, sigmas)), F.col("s") + 1).alias("sigma"), "r")


def describe(pixels: DataFrame, keypoints: DataFrame, size: int = 3) -> DataFrame:
    """``y, x, v``: the upright descriptor (array of 128) around every keypoint that has room for one, from
    4 x 4 bins of ``size`` pixels."""
    half = (3 * size) // 2
    at = keypoints.select((F.col("y") - half).alias("y"), (F.col("x") - half).alias("x")).distinct()
    bins = dense_descriptors(pixels, size, 1).join(at, ["y", "x"])
    filled = bins.groupBy("y", "x").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0)).cast("double"))
    return filled.select((F.col("y") + half).alias("y"), (F.col("x") + half).alias("x"), vector.alias("v"))


def detect_and_match(a: DataFrame, b: DataFrame, method: str = "dog", threshold: float = 0.0, ratio: float = 1.5, size: int = 3, width: int = 1 << 20, sigmas: list[float] = SIGMAS) -> DataFrame:
    """``xa, ya, xb, yb``: keypoints of two images matched by the ratio test on their descriptors.  ``width``
    is above every x."""
    sides = []
    for pixels in (a, b):
        described = describe(pixels, detect(pixels, method, sigmas, threshold), size)
        sides.append(durable(described.select((F.col("y").cast("long") * width + F.col("x")).alias("id"), "v")))
    pairs = ratio_match(sides[0], sides[1], ratio)
    place = lambda k, n: ((F.col(k) % width).cast("double").alias(f"x{n}"), F.floor(F.col(k) / width).cast("double").alias(f"y{n}"))
    return pairs.select(*place("k1", "a"), *place("k2", "b"))
