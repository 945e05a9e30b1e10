"""Neighbourhood windows: overlapping count windows, Gaussian bands, local maxima, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_windows(frame: Column, size: int, n_windows: Column | None = None) -> Column:
    """Windows (0-based) of ``size`` frames with half overlap that hold a 0-based frame."""
    hop = size // 2
    last = F.floor(frame / hop).cast("int")
    both = F.array(last - 1, last)
    return F.filter(both, lambda w: (w >= 0) & ((w < n_windows) if n_windows is not None else F.lit(True)))


def n_count_windows(n_frames: Column, size: int) -> Column:
    return (F.ceil(n_frames / (size / 2)) - 1).cast("int")


def gauss(x: Column, sigma: float, centre: float = 0.0) -> Column:
    if sigma == 0:
        raise ValueError("sigma must not be 0")
    return F.exp(-((x - centre) ** 2) / (2 * sigma**2))


def band_smooth(df: DataFrame, group: list[str], frame: str, value: str, span: int, sigma: float) -> DataFrame:
    """Gaussian average over the other frames within ``span``.

    The band is made by exploding offsets into an equi-join, so there is no
    nested loop and a row meets ``2 * span`` others at most.
    """
    offsets = F.sequence(F.lit(-span), F.lit(span))
    moved = df.select(*group, F.col(value).alias("__v"), F.col(frame).alias("__f"), F.explode(offsets).alias("__o")).where("__o != 0")
    moved = moved.select(*group, (F.col("__f") + F.col("__o")).alias(frame), "__v", gauss(F.col("__o"), sigma).alias("__w"))
    sums = moved.groupBy(*group, frame).agg(F.sum(F.col("__w") * F.col("__v")).alias("__s"), F.sum("__w").alias("weight"))
    return df.join(sums, [*group, frame]).select(*group, frame, value, (F.col("__s") / F.col("weight")).alias("smooth"), "weight")


def band_affinity(df: DataFrame, group: list[str], frame: str, dx: str, dy: str, span: int = 30, sigma_t: float = 10.0, sigma_d: float = 400.0) -> DataFrame:
    """Sparse affinities ``t, r, w`` of frames within ``span``: a Gaussian of their distance in
    time times one of their translation's distance; w(t, t) = 0 is not listed."""
    a = df.select(*group, F.col(frame).alias("t"), F.col(dx).alias("__x"), F.col(dy).alias("__y"), F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("__o")).where("__o != 0")
    b = df.select(*group, F.col(frame).alias("r"), F.col(dx).alias("__x2"), F.col(dy).alias("__y2"))
    joined = a.withColumn("r", F.col("t") + F.col("__o")).join(b, [*group, "r"])
    moved = F.abs(F.col("__x") - F.col("__x2")) + F.abs(F.col("__y") - F.col("__y2"))
    return joined.select(*group, "t", "r", (gauss(F.col("__o"), sigma_t) * gauss(moved, sigma_d)).alias("w"))


def local_maxima_1d(df: DataFrame, group: list[str], order: str, value: str, least: float = float("-inf")) -> DataFrame:
    """Rows greater than both neighbours and at least ``least``; the ends are left out."""
    w = W.partitionBy(*group).orderBy(order)
    around = df.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w))
    return around.where((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b")) & (F.col(value) >= least)).drop("__a", "__b")


EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def local_maxima_2d(pixels: DataFrame, value: str = "v", least: float = float("-inf"), image: list[str] | None = None) -> DataFrame:
    """Pixels ``y, x`` greater than all eight neighbours and at least ``least``.  Pixels
    without eight neighbours (borders) are left out.  Offsets, not a theta join."""
    image = image or []
    offsets = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in EIGHT))
    sent = pixels.select(*image, "y", "x", F.col(value).alias("__n"), F.explode(offsets).alias("o")).groupBy(*image, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.max("__n").alias("__m"), F.count("__n").alias("__c"))
    return pixels.join(sent, [*image, "y", "x"]).where((F.col("__c") == 8) & (F.col(value) > F.col("__m")) & (F.col(value) >= least)).select(*image, "y", "x", value)


def gradient(df: DataFrame, group: list[str], order: str, value: str, kind: str = "central") -> DataFrame:
    """``df`` with ``g``: central, forward or backward difference, one-sided at the ends."""
    w = W.partitionBy(*group).orderBy(order)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    g = {
        "central": F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2),
        "forward": F.when(after.isNull(), v - before).otherwise(after - v),
        "backward": F.when(before.isNull(), after - v).otherwise(v - before),
    }[kind]
    return df.withColumn("g", F.coalesce(g, F.lit(0.0)))


def smooth_rows(pixels: DataFrame, along: str, across: str, value: str, weights: list[float], image: list[str] | None = None) -> DataFrame:
    """One pass of a separable filter along an axis; the border value continues outwards.

    ``weights`` is odd in length; two passes, one for each axis, blur an image.
    """
    image, half = image or [], len(weights) // 2
    by = [*image, across]
    ends = pixels.groupBy(*by).agg(F.min(along).alias("__lo"), F.max(along).alias("__hi"))
    taps = F.array(*(F.struct(F.lit(i - half).alias("o"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)))
    wanted = pixels.join(ends, by).select(*by, along, F.explode(taps).alias("t"), "__lo", "__hi").select(*by, F.col(along).alias("__at"), F.greatest("__lo", F.least("__hi", F.col(along) + F.col("t.o"))).alias(along), F.col("t.w").alias("__w"))
    sums = wanted.join(pixels.select(*by, along, value), [*by, along]).groupBy(*by, "__at").agg(F.sum(F.col("__w") * F.col(value)).alias(value))
    return sums.withColumnRenamed("__at", along)


def path_product(df: DataFrame, group: list[str], order: str, matrix: str, out: str = "path") -> DataFrame:
    """Running product of 3 x 3 matrices (``array<double>`` of 9, row-major) along an order:
    path_f = H_f path_(f-1), divided by its last element; the first path is the identity.

    The product does not commute, so it is a fold over each group's ordered
    list; a group is one cell of one clip and so bounded by the clip.
    """
    identity = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))

    def times(a: Column, b: Column) -> Column:
        cells = [sum((a[3 * r + k] * b[3 * k + c] for k in range(1, 3)), a[3 * r] * b[c]) for r in range(3) for c in range(3)]
        return F.transform(F.array(*cells), lambda x: x / cells[8])

    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(matrix).alias("h"))))
    steps = df.groupBy(*group).agg(ordered.alias("__s"))
    fold = F.aggregate(
        F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0))),
        F.array(F.struct(F.element_at("__s", 1)["o"].alias("o"), identity.alias("p"))),
        lambda acc, s: F.concat(acc, F.array(F.struct(s["o"].alias("o"), times(s["h"], F.element_at(acc, -1)["p"]).alias("p")))),
    )
    return steps.select(*group, F.explode(fold).alias("f")).select(*group, F.col("f.o").alias(order), F.col("f.p").alias(out))
