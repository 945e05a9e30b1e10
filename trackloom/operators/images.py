"""Image operators on pixel tables (``y, x, v``), and the few that need a whole raster at once."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.windows import smooth_rows
from trackloom.plans.stages import durable


def gaussian_weights(sigma: float) -> list[float]:
    half = max(1, math.ceil(4 * sigma))
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def triangular_weights(radius: int) -> list[float]:
    w = radius + 1 - np.abs(np.arange(-radius, radius + 1))
    return (w / w.sum()).tolist()


def smooth(pixels: DataFrame, weights: list[float], value: str = "v", image: list[str] | None = None, step: int = 1) -> DataFrame:
    """Separable blur in two passes; ``step`` keeps every so many pixels."""
    image = image or []
    out = smooth_rows(smooth_rows(pixels, "x", "y", value, weights, image), "y", "x", value, weights, image)
    return out.where((F.col("x") % step == 0) & (F.col("y") % step == 0)) if step > 1 else out


def down(pixels: DataFrame, average: bool = True, image: list[str] | None = None) -> DataFrame:
    """Half the size (0-based pixels): the mean of 2 x 2, or every second pixel."""
    image = image or []
    if not average:
        return pixels.where("y % 2 = 0 AND x % 2 = 0").select(*image, (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), "v")
    return pixels.groupBy(*image, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def up(pixels: DataFrame, image: list[str] | None = None) -> DataFrame:
    """Twice the size by bilinear interpolation; the last row and column repeat."""
    image = image or []
    taps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, wy in ((-1, 0.5), (0, 1.0), (1, 0.5)) for dx, wx in ((-1, 0.5), (0, 1.0), (1, 0.5)) for w in [wy * wx]))
    sent = pixels.select(*image, (2 * F.col("y")).alias("y2"), (2 * F.col("x")).alias("x2"), "v", F.explode(taps).alias("t"))
    sent = sent.select(*image, (F.col("y2") + F.col("t.dy")).alias("y"), (F.col("x2") + F.col("t.dx")).alias("x"), F.col("t.w").alias("w"), "v").where("y >= 0 AND x >= 0")
    return sent.groupBy(*image, "y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def blend(a: DataFrame, b: DataFrame, value: str = "v") -> DataFrame:
    """The mean where both have a pixel, else the one there is."""
    both = a.select("y", "x", F.col(value).alias("__a")).join(b.select("y", "x", F.col(value).alias("__b")), ["y", "x"], "full")
    return both.select("y", "x", F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).otherwise((F.col("__a") + F.col("__b")) / 2).alias(value))


def cross_fade(a: DataFrame, b: DataFrame, alpha: float, middle: float, value: str = "v") -> DataFrame:
    """Sigmoid fade from ``a`` to ``b`` along x around ``middle``."""
    share = 1 / (1 + F.exp(-alpha * (F.col("x") - middle)))
    both = a.select("y", "x", F.col(value).alias("__a")).join(b.select("y", "x", F.col(value).alias("__b")), ["y", "x"])
    return both.select("y", "x", ((1 - share) * F.col("__a") + share * F.col("__b")).alias(value))


def _cubic(d: Column) -> Column:
    """The cubic convolution kernel with slope -1/2."""
    d = F.abs(d)
    return F.when(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1).when(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2).otherwise(0.0)


def backward_warp(pixels: DataFrame, targets: DataFrame, kernel: str = "linear", slopes: bool = False, image: list[str] | None = None) -> DataFrame:
    """Samples of ``pixels`` at ``targets`` (``[image,] y, x, wy, wx``), bilinear or by cubic convolution; NaN where a
    pixel that counts is missing.  With ``slopes`` (bilinear only) also the derivatives ``vy, vx`` by
    the place sampled; all four pixels count then."""
    image = image or []
    y0, x0 = F.floor("wy").cast("int"), F.floor("wx").cast("int")
    fy, fx, i, j = F.col("wy") - y0, F.col("wx") - x0, F.col("i"), F.col("j")
    steps = F.array(*map(F.lit, (-1, 0, 1, 2) if kernel == "cubic" else (0, 1)))
    each = targets.select(*image, F.col("y").alias("ty"), F.col("x").alias("tx"), "wy", "wx", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    side = (lambda f, k: _cubic(f - k)) if kernel == "cubic" else (lambda f, k: F.when(k == 1, f).otherwise(1 - f))
    wanted = each.select(*image, "ty", "tx", (y0 + i).alias("y"), (x0 + j).alias("x"), side(fy, i).alias("__a"), side(fx, j).alias("__b"), (2 * i - 1).alias("__i"), (2 * j - 1).alias("__j"))
    wanted = wanted.select(*image, "ty", "tx", "y", "x", (F.col("__a") * F.col("__b")).alias("w"), (F.col("__i") * F.col("__b")).alias("a"), (F.col("__j") * F.col("__a")).alias("b"))
    wanted = wanted if slopes else wanted.where("w != 0")
    sums = {"v": "w"} | ({"vy": "a", "vx": "b"} if slopes else {})
    joined = wanted.join(pixels.select(*image, "y", "x", F.col("v").alias("__v")), [*image, "y", "x"], "left").groupBy(*image, "ty", "tx").agg(F.count("__v").alias("got"), F.count("*").alias("all"), *(F.sum(F.col(w) * F.col("__v")).alias(n) for n, w in sums.items()))
    return joined.select(*image, F.col("ty").alias("y"), F.col("tx").alias("x"), *(F.when(F.col("got") == F.col("all"), F.col(n)).otherwise(float("nan")).alias(n) for n in sums))


def distance_transform(pixels: DataFrame, a: float = 1.0, b: float = 0.0, c: float = 1.0, d: float = 0.0, reach: int | None = None) -> DataFrame:
    """``y, x, v, ay, ax``: min over (u, w) of I(u, w) + c (y - u - d)^2 + a (x - w - b)^2 and its
    place, by one pass for each axis.  Offsets beyond ``reach`` are not tried; without it, all
    within the image's extent are."""
    extent = {"y": reach, "x": reach}
    if reach is None:
        ends = pixels.agg(*(f(k).alias(f"{n}_{k}") for k in "yx" for n, f in (("lo", F.min), ("hi", F.max)))).first()
        extent = {k: (ends[f"hi_{k}"] or 0) - (ends[f"lo_{k}"] or 0) for k in "yx"}

    def one(df: DataFrame, axis: str, weight: float, shift: float, rest: list[str]) -> DataFrame:
        sent = df.select("*", F.explode(F.sequence(F.lit(-extent[axis]), F.lit(extent[axis]))).alias("__o"))
        cost = F.col("v") + weight * (F.col("__o") - shift) ** 2
        sent = sent.select((F.col(axis) + F.col("__o")).alias("__to"), *[k for k in ("y", "x") if k != axis], F.struct(cost.alias("v"), *(F.col(k) for k in rest)).alias("m"))
        best = sent.groupBy("__to", *[k for k in ("y", "x") if k != axis]).agg(F.min("m").alias("m"))
        return best.withColumnRenamed("__to", axis).select("y", "x", "m.*").join(df.select("y", "x"), ["y", "x"], "left_semi")

    start = pixels.select("y", "x", "v", F.col("y").alias("ay"), F.col("x").alias("ax"))
    return one(one(start, "x", a, b, ["ay", "ax"]), "y", c, d, ["ay", "ax"])


def mosaic(pixels: DataFrame, image: str, columns: int, height: int, width: int, gap: int = 0) -> DataFrame:
    """Images numbered from 0 tiled row by row."""
    return pixels.select((F.floor(F.col(image) / columns) * (height + gap) + F.col("y")).cast("int").alias("y"), ((F.col(image) % columns) * (width + gap) + F.col("x")).cast("int").alias("x"), "v")


def harris(pixels: DataFrame, sigma: float, alpha: float = 0.04) -> DataFrame:
    """``y, x, r``: det - alpha trace^2 of the smoothed structure tensor."""
    from trackloom.operators.windows import gradient

    gx = gradient(pixels, ["y"], "x", "v").select("y", "x", F.col("g").alias("gx"))
    gy = gradient(pixels, ["x"], "y", "v").select("y", "x", F.col("g").alias("gy"))
    g = durable(gx.join(gy, ["y", "x"]))
    w = gaussian_weights(sigma)
    parts = [smooth(g.select("y", "x", e.alias("v")), w).select("y", "x", F.col("v").alias(n)) for n, e in (("xx", F.col("gx") * F.col("gx")), ("yy", F.col("gy") * F.col("gy")), ("xy", F.col("gx") * F.col("gy")))]
    t = parts[0].join(parts[1], ["y", "x"]).join(parts[2], ["y", "x"])
    return t.select("y", "x", (F.col("xx") * F.col("yy") - F.col("xy") ** 2 - alpha * (F.col("xx") + F.col("yy")) ** 2).alias("r"))


def local_binary_patterns(pixels: DataFrame, cell: int) -> DataFrame:
    """``cy, cx, pattern, n``: 8-neighbour comparison codes (bit set where the neighbour is at
    least the pixel) counted in square cells; borders have no code."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    offsets = F.array(*(F.struct(F.lit(-a).alias("dy"), F.lit(-b).alias("dx"), F.lit(1 << i).alias("bit")) for i, (a, b) in enumerate(ring)))
    sent = pixels.select("y", "x", F.col("v").alias("nv"), F.explode(offsets).alias("o")).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "nv", F.col("o.bit").alias("bit"))
    codes = pixels.join(sent, ["y", "x"]).groupBy("y", "x").agg(F.sum(F.when(F.col("nv") >= F.col("v"), F.col("bit")).otherwise(0)).alias("pattern"), F.count("*").alias("n")).where("n = 8")
    return codes.groupBy(F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx"), "pattern").agg(F.count("*").alias("n"))


def soft_mask(points: DataFrame, at: DataFrame, sigma: float = 50.0, reach: int | None = None) -> DataFrame:
    """``frame, y, x, m``: share of Gaussian weight from points marked good (``frame, x, y, good``) at
    the asked places only.  Places and points meet by cells of ``reach``, without it all of a frame do."""
    w = F.exp(-((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2) / (2 * sigma * sigma))
    share = F.try_divide(F.sum(F.when(F.col("good"), w).otherwise(0.0)), F.sum(w)).alias("m")  # null where all weights vanish
    if reach is None:
        p = points.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), "good")
        return at.join(p, "frame").groupBy("frame", "y", "x").agg(share)
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), "good", cell("y").alias("cy"), cell("x").alias("cx"))
    q = at.select("frame", "y", "x", F.explode(near).alias("a"), cell("y").alias("cy0"), cell("x").alias("cx0")).select("*", F.explode(near).alias("b")).select("frame", "y", "x", (F.col("cy0") + F.col("a")).alias("cy"), (F.col("cx0") + F.col("b")).alias("cx"))
    return q.join(p, ["frame", "cy", "cx"]).groupBy("frame", "y", "x").agg(share)


def dark(r: Column, g: Column, b: Column, least: int = 20) -> Column:
    return (r < least) & (g < least) & (b < least)


def drop_dark(points: DataFrame, pixels: DataFrame, sigma: float = 50.0, share: float = 0.2) -> DataFrame:
    """Points (``x, y``) whose pixel's blurred share of dark pixels is at most ``share``."""
    mask = smooth(pixels.select("y", "x", dark(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("v")), gaussian_weights(sigma))
    bad = mask.where(F.col("v") > share).select(F.col("y").alias("__y"), F.col("x").alias("__x"))
    return points.join(bad, (F.round("y").cast("int") == F.col("__y")) & (F.round("x").cast("int") == F.col("__x")), "left_anti")


def by_raster(pixels: DataFrame, image: list[str], kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """``image`` columns and the rows of ``schema`` that ``kernel`` makes of every image (``image, y, x, v``,
    dense).  An image is one group, so images are spread and one must fit a task."""
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        raster = np.zeros((h, w))
        raster[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf["v"].to_numpy(float)
        out = pd.DataFrame(kernel(raster), columns=names)
        for c, v in reversed(list(zip(image, key, strict=True))):
            out.insert(0, c, v)
        return out

    return pixels.select(*image, "y", "x", "v").groupBy(*image).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in image), schema]))


def _pixels(values: np.ndarray) -> list[tuple]:
    return [(y, x, values[y, x]) for y in range(values.shape[0]) for x in range(values.shape[1])]


def whitened(pixels: DataFrame, image: list[str], alpha: float = 1.0, cut: float = 0.8) -> DataFrame:
    """``image, y, x, v`` of every image, its spectrum flattened (:func:`whiten`)."""
    return by_raster(pixels, image, lambda r: _pixels(whiten(r, alpha, cut)), "y int, x int, v double")


def superpixel_labels(pixels: DataFrame, image: list[str], size: int, regularizer: float = 0.1, least: int = 0) -> DataFrame:
    """``image, y, x, label`` of every image (:func:`superpixels`)."""
    return by_raster(pixels, image, lambda r: _pixels(superpixels(r, size, regularizer, least=least)), "y int, x int, label int")


def filled_regions(pixels: DataFrame, image: list[str], seed: tuple[int, int]) -> DataFrame:
    """``image, y, x``: the extremal region of one seed in every image (:func:`fill_region`)."""
    return by_raster(pixels, image, lambda r: [(int(y), int(x)) for y, x in zip(*np.nonzero(fill_region(r, seed)), strict=True)], "y int, x int")


def region_table(pixels: DataFrame, image: list[str], **options) -> DataFrame:
    """``image, y, x, level, area``: the seeds of every image's stable regions (:func:`stable_regions`)."""
    return by_raster(pixels, image, lambda r: [(*divmod(int(seed), r.shape[1]), int(level), int(area)) for seed, level, area in stable_regions(r, **options)], "y int, x int, level int, area int")


# Whole rasters, for use in one group's function.


def whiten(image: np.ndarray, alpha: float = 1.0, cut: float = 0.8) -> np.ndarray:
    """Flatten the power spectrum: multiply by |f|^alpha, roll off beyond ``cut``."""
    fy, fx = np.fft.fftfreq(image.shape[0])[:, None] * 2, np.fft.fftfreq(image.shape[1])[None, :] * 2
    f = np.hypot(fy, fx)
    return np.fft.ifft2(np.fft.fft2(image) * f**alpha * np.exp(-((f / cut) ** 4))).real


def superpixels(image: np.ndarray, size: int, regularizer: float = 0.1, rounds: int = 10, least: int = 0) -> np.ndarray:
    """Local k-means on colour and place around a grid of seeds; regions below ``least`` pixels
    join the neighbour they touch most."""
    h, w = image.shape[:2]
    image = image.reshape(h, w, -1).astype(float)
    yy, xx = np.mgrid[:h, :w]
    ys, xs = np.arange(size / 2, h, size), np.arange(size / 2, w, size)
    centres = [(y, x, image[int(y), int(x)]) for y in ys for x in xs]
    labels = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k, (cy, cx, c) in enumerate(centres):
            y0, y1, x0, x1 = max(0, int(cy - size)), min(h, int(cy + size) + 1), max(0, int(cx - size)), min(w, int(cx + size) + 1)
            d = ((image[y0:y1, x0:x1] - c) ** 2).sum(-1) + regularizer / size**2 * ((yy[y0:y1, x0:x1] - cy) ** 2 + (xx[y0:y1, x0:x1] - cx) ** 2)
            near = d < best[y0:y1, x0:x1]
            best[y0:y1, x0:x1][near] = d[near]
            labels[y0:y1, x0:x1][near] = k
        centres = [(yy[m].mean(), xx[m].mean(), image[m].mean(0)) if (m := labels == k).any() else c for k, c in enumerate(centres)]
    for k in np.flatnonzero(np.bincount(labels.ravel()) < least):
        m = labels == k
        if not m.any():
            continue
        edge = np.zeros_like(m)
        edge[1:] |= m[:-1]
        edge[:-1] |= m[1:]
        edge[:, 1:] |= m[:, :-1]
        edge[:, :-1] |= m[:, 1:]
        around = labels[edge & ~m]
        if len(around):
            labels[m] = np.bincount(around).argmax()
    return labels


def fill_region(image: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """The extremal region of a seed: the 4-connected pixels no brighter than it."""
    low, out, stack = image <= image[seed], np.zeros(image.shape, bool), [seed]
    while stack:
        y, x = stack.pop()
        if 0 <= y < image.shape[0] and 0 <= x < image.shape[1] and low[y, x] and not out[y, x]:
            out[y, x] = True
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def stable_regions(image: np.ndarray, delta: int = 5, most: float = 0.75, least: float = 0.0, variation: float = 0.25) -> list[tuple[int, int, int]]:
    """Maximally stable extremal regions as ``(seed, level, area)``: components of ``image <= level``
    whose growth over ``delta`` levels is a local minimum along their branch.

    Pixels join in order of brightness in a union-find whose components keep
    their area at each level.
    """
    flat, (h, w) = image.ravel().astype(int), image.shape
    order = np.argsort(flat, kind="stable")
    parent = np.full(flat.size, -1)
    area: dict[int, dict[int, int]] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.ones(flat.size, int)
    history: list[tuple[int, int, int]] = []
    at = 0
    for level in range(int(flat.min()), int(flat.max()) + 1):
        while at < len(order) and flat[order[at]] <= level:
            i = int(order[at])
            parent[i] = i
            y, x = divmod(i, w)
            for j in ((i - w) if y else -1, (i + w) if y + 1 < h else -1, (i - 1) if x else -1, (i + 1) if x + 1 < w else -1):
                if j >= 0 and parent[j] >= 0:
                    a, b = find(i), find(j)
                    if a != b:
                        # the darker, or else larger, branch keeps its name
                        if (flat[a], -size[a], a) > (flat[b], -size[b], b):
                            a, b = b, a
                        parent[b] = a
                        size[a] += size[b]
            at += 1
        for root in {find(int(i)) for i in order[:at]}:
            area.setdefault(root, {})[level] = int(size[root])
    for root, levels in area.items():
        growth = {v: (levels[v + delta] - n) / n for v, n in levels.items() if v + delta in levels}
        for v, g in growth.items():
            if g <= variation and g <= growth.get(v - 1, math.inf) and g < growth.get(v + 1, math.inf) and least * flat.size <= levels[v] <= most * flat.size:
                history.append((root, v, levels[v]))
    return sorted(history)
