"""Gradient descriptors on pixel tables (``[image,] y, x, v``): oriented-gradient cells and dense grids.

Everything is a composition of offset joins and aggregations: a pixel sends its
votes to the few cells or bins that it touches, so no raster is gathered in
one place and images are spread by their columns.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.images import by_raster, gaussian_weights, smooth
from trackloom.operators.windows import gradient

CLIP = 0.2


def gradients(pixels: DataFrame, image: list[str] | None = None) -> DataFrame:
    """``[image,] y, x, gx, gy``: central differences, one-sided at the borders."""
    image = image or []
    gx = gradient(pixels.select(*image, "y", "x", "v"), [*image, "y"], "x", "v").withColumnRenamed("g", "gx")
    return gradient(gx, [*image, "x"], "y", "v").withColumnRenamed("g", "gy").drop("v")


def _between(at: Column, n: int | None = None) -> Column:
    """The two places next to a real one, with linear weights (``array<struct<i, w>>``); modulo ``n`` if given."""
    low = F.floor(at).cast("int")
    wrap = (lambda i: F.pmod(i, F.lit(n))) if n else (lambda i: i)
    return F.array(F.struct(wrap(low).alias("i"), (1 - (at - low)).alias("w")), F.struct(wrap(low + 1).alias("i"), (at - low).alias("w")))


def cell_orientations(pixels: DataFrame, cell: int, orientations: int = 9, image: list[str] | None = None) -> DataFrame:
    """``[image,] cy, cx, o, h``: gradient magnitudes by cell and signed direction (``2 orientations`` of them).

    A pixel takes the direction whose axis its gradient follows most, and
    votes into the four cells around it bilinearly; votes beyond the image's
    cells are lost.  A cell that is more than half outside is none.
    """
    image = image or []
    g = gradients(pixels, image)
    turns = [math.pi * k / orientations for k in range(orientations)]
    along = F.array(*(F.struct(F.abs(F.col("gx") * math.cos(t) + F.col("gy") * math.sin(t)).alias("p"), F.lit(-k).alias("k"), (F.col("gx") * math.cos(t) + F.col("gy") * math.sin(t) < 0).alias("back")) for k, t in enumerate(turns)))
    # sums of equal parts may differ in their last bits, so ties are made on rounded ones
    best = F.array_max(F.transform(along, lambda s: F.struct(F.round(s["p"], 9).alias("p"), s["k"].alias("k"), s["back"].alias("back"))))
    place = lambda c: _between((F.col(c) + 0.5) / cell - 0.5)
    votes = g.withColumn("b", best).select(*image, "y", "x", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("m"), (F.when(F.col("b.back"), orientations).otherwise(0) - F.col("b.k")).alias("o"))
    votes = votes.where("m > 0").select(*image, "o", "m", F.explode(place("y")).alias("py"), place("x").alias("px")).select(*image, "o", "m", "py", F.explode("px").alias("px"))
    summed = votes.groupBy(*image, F.col("py.i").alias("cy"), F.col("px.i").alias("cx"), "o").agg(F.sum(F.col("m") * F.col("py.w") * F.col("px.w")).alias("h"))
    size = pixels.groupBy(*image).agg(*(F.floor((F.max(c) + 1 + cell // 2) / cell).alias(f"n{c}") for c in "yx"))
    inside = summed.join(size, image) if image else summed.crossJoin(F.broadcast(size))
    return inside.where("cy >= 0 AND cx >= 0 AND cy < ny AND cx < nx").drop("ny", "nx")


def oriented_gradients(cells: DataFrame, orientations: int = 9, variant: str = "uoctti", image: list[str] | None = None) -> DataFrame:
    """``[image,] cy, cx, f, v``: normalised histograms of oriented gradients of ``cy, cx, o, h``.

    Each cell is divided by the energy of the four blocks of 2 x 2 cells that
    hold it (at the border a block repeats the border's cells) and clipped at
    0.2.  ``uoctti``: directed entries, undirected entries (each half the sum
    of its four), and four texture sums.  ``dalaltriggs``: the undirected
    entries of the four blocks one after the other.
    """
    image = image or []
    u = cells.groupBy(*image, "cy", "cx", (F.col("o") % orientations).alias("o")).agg(F.sum("h").alias("h"))
    energy = u.groupBy(*image, "cy", "cx").agg(F.sum(F.col("h") ** 2).alias("e"))
    span = energy.groupBy(*image).agg(*(f(c).alias(n) for c in ("cy", "cx") for n, f in ((f"lo_{c}", F.min), (f"hi_{c}", F.max))))
    homes = energy.join(span, image) if image else energy.crossJoin(F.broadcast(span))
    corners = F.array(*(F.struct(F.lit(2 * (dy + 1) + dx + 1).alias("f"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0) for dx in (-1, 0)))
    four = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    clamp = lambda v, c: F.greatest(F.col(f"lo_{c}"), F.least(F.col(f"hi_{c}"), v))
    asked = homes.select(*image, F.col("cy").alias("hy"), F.col("cx").alias("hx"), *(c for c in span.columns if c not in image), F.explode(corners).alias("k")).select("*", F.explode(four).alias("q"))
    asked = asked.select(*image, "hy", "hx", "k.f", clamp(F.col("hy") + F.col("k.dy") + F.col("q.a"), "cy").alias("cy"), clamp(F.col("hx") + F.col("k.dx") + F.col("q.b"), "cx").alias("cx"))
    blocks = asked.join(energy, [*image, "cy", "cx"], "left").groupBy(*image, "hy", "hx", "f").agg(F.sqrt(F.sum(F.coalesce("e", F.lit(0.0))) + 1e-10).alias("n"))
    blocks = blocks.withColumnsRenamed({"hy": "cy", "hx": "cx"})
    clipped = lambda h: h.join(blocks, [*image, "cy", "cx"]).withColumn("c", F.least(F.lit(CLIP), F.col("h") / F.col("n")))
    at = [*image, "cy", "cx"]
    if variant == "dalaltriggs":
        return clipped(u).select(*at, (F.col("f") * orientations + F.col("o")).cast("int").alias("f"), F.col("c").alias("v"))
    directed, undirected = clipped(cells.select(*at, "o", "h")), clipped(u)
    halves = directed.groupBy(*at, F.col("o").cast("int").alias("f")).agg((F.sum("c") / 2).alias("v")).unionByName(undirected.groupBy(*at, (F.col("o") + 2 * orientations).cast("int").alias("f")).agg((F.sum("c") / 2).alias("v")))
    texture = directed.groupBy(*at, (F.col("f") + 3 * orientations).cast("int").alias("f")).agg((F.sum("c") / math.sqrt(2 * orientations)).alias("v"))
    return halves.unionByName(texture)


def dense_descriptors(pixels: DataFrame, size: int, step: int, image: list[str] | None = None) -> DataFrame:
    """``[image,] y, x, bin, v``: descriptors of 4 x 4 x 8 bins at every ``step``-th pixel.

    ``y, x`` is the centre of the first bin; bins are ``size`` pixels apart,
    and a pixel weighs in linearly up to ``size`` away, in place and in
    direction.  Descriptors have unit length, are clipped at 0.2, have unit
    length again, and are scaled to whole numbers of at most 255.  Bins without
    weight have no row.
    """
    image = image or []
    g = gradients(pixels, image)
    turn = F.pmod(F.atan2("gy", "gx") / (2 * math.pi) * 8, F.lit(8.0))
    maps = g.select(*image, "y", "x", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("m"), F.explode(_between(turn, 8)).alias("t")).where("m > 0").select(*image, "y", "x", F.col("t.i").alias("o"), (F.col("m") * F.col("t.w")).alias("m"))
    taps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(1 - abs(d) / size).alias("w")) for d in range(1 - size, size)))

    def spread(df: DataFrame, axis: str) -> DataFrame:
        other = "x" if axis == "y" else "y"
        sent = df.select(*image, other, "o", "m", axis, F.explode(taps).alias("t"))
        return sent.groupBy(*image, other, "o", (F.col(axis) + F.col("t.d")).alias(axis)).agg(F.sum(F.col("m") * F.col("t.w")).alias("m"))

    binned = spread(spread(maps, "y"), "x")
    ends = pixels.groupBy(*image).agg(F.max("y").alias("hy"), F.max("x").alias("hx"))
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(4) for b in range(4)))
    sent = binned.select(*image, "o", "m", F.col("y").alias("by"), F.col("x").alias("bx"), F.explode(offsets).alias("q")).select(*image, "m", (F.col("by") - size * F.col("q.a")).alias("y"), (F.col("bx") - size * F.col("q.b")).alias("x"), (32 * F.col("q.a") + 8 * F.col("q.b") + F.col("o")).cast("int").alias("bin"))
    sent = sent.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") % step == 0) & (F.col("x") % step == 0))
    inside = (sent.join(ends, image) if image else sent.crossJoin(F.broadcast(ends))).where(f"y + {3 * size} <= hy AND x + {3 * size} <= hx").select(*image, "y", "x", "bin", "m")
    at = [*image, "y", "x"]

    def unit(df: DataFrame, clip: bool) -> DataFrame:
        norms = df.groupBy(*at).agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("n"))
        m = F.col("m") / F.col("n")
        return df.join(norms, at).select(*at, "bin", (F.least(F.lit(CLIP), m) if clip else m).alias("m"))

    return unit(unit(inside, True), False).select(*at, "bin", F.least(F.lit(255), F.floor(512 * F.col("m") + 1e-6)).cast("int").alias("v"))


def multi_scale_descriptors(pixels: DataFrame, sizes: list[int], step: int, magnification: float = 6.0, image: list[str] | None = None) -> DataFrame:
    """``size, [image,] y, x, bin, v``: dense descriptors at several bin sizes, each of an image blurred by
    ``size / magnification``."""
    parts = [dense_descriptors(smooth(pixels, gaussian_weights(size / magnification), image=image), size, step, image).withColumn("size", F.lit(size)) for size in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intensity_orders(patch: np.ndarray, neighbours: int = 4, bins: int = 6, radius: float | None = None, threshold: float = 0.05) -> np.ndarray:
    """A square patch's histogram of local intensity orders: ``bins`` times ``neighbours``! numbers of unit length.

    Pixels in the disc that leaves room for the neighbours are ranked into
    bins by intensity.  Each votes for the order of its neighbours' values,
    which lie on a circle of ``radius`` from the direction away from the centre
    on, with the number of their pairs that differ by more than ``threshold``
    times the range of values.  Turning the patch changes nothing.
    """
    side = patch.shape[0]
    radius = radius if radius is not None else max(1.0, side / 7)
    middle = (side - 1) / 2
    yy, xx = np.mgrid[:side, :side] - middle
    inside = (np.hypot(yy, xx) <= middle - radius) & (np.hypot(yy, xx) > 0)  # the centre has no direction
    y, x, v = yy[inside], xx[inside], patch[inside]
    orders = {p: i for i, p in enumerate(permutations(range(neighbours)))}
    out = np.zeros((bins, len(orders)))
    if not len(v):
        return out.ravel()
    rank = np.argsort(np.argsort(v, kind="stable"), kind="stable")
    angle = np.arctan2(y, x)[:, None] + 2 * np.pi * np.arange(neighbours) / neighbours
    py, px = y[:, None] + radius * np.sin(angle) + middle, x[:, None] + radius * np.cos(angle) + middle
    y0, x0 = np.clip(np.floor(py).astype(int), 0, side - 2), np.clip(np.floor(px).astype(int), 0, side - 2)
    fy, fx = py - y0, px - x0
    around = (1 - fy) * ((1 - fx) * patch[y0, x0] + fx * patch[y0, x0 + 1]) + fy * ((1 - fx) * patch[y0 + 1, x0] + fx * patch[y0 + 1, x0 + 1])
    far = np.abs(around[:, :, None] - around[:, None, :]) > threshold * (np.ptp(patch) or 1.0)
    weight = far.sum((1, 2)) / 2
    for r, w, order in zip(rank, weight, np.argsort(np.round(around, 9), axis=1, kind="stable"), strict=True):
        out[r * bins // len(v), orders[tuple(order.tolist())]] += w
    size = np.linalg.norm(out)
    return (out / size if size else out).ravel()


def patch_descriptors(patches: DataFrame, image: list[str], **options) -> DataFrame:
    """``image, bin, v``: :func:`intensity_orders` of every square patch (``image, y, x, v``); zeros have no row."""
    return by_raster(patches, image, lambda r: [(i, float(v)) for i, v in enumerate(intensity_orders(r, **options)) if v], "bin int, v double")
