"""Aggregated feature encodings: VLAD, Fisher vectors, kernel maps, segment means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vlad(data: DataFrame, centres: DataFrame, assign: DataFrame, normalize: bool = True, square_root: bool = False, components: bool = False, mass: bool = False) -> DataFrame:
    """``k, dim, val``: residual sums of ``data`` (``id, v``) at ``centres`` (``k, c``) under
    soft assignments ``id, k, a``: sum of a * x minus (sum of a) * centre.

    Options as usual: divide by the mass, L2-normalise each centre's part,
    signed square root, L2-normalise the whole (on by default).
    """
    moved = assign.join(data, "id").select("k", "a", F.posexplode("v").alias("dim", "x"))
    sums = moved.groupBy("k", "dim").agg(F.sum(F.col("a") * F.col("x").cast("double")).alias("s"), F.sum("a").alias("m"))
    cells = centres.select("k", F.posexplode("c").alias("dim", "mu"))
    val = cells.join(sums, ["k", "dim"], "left").select("k", "dim", F.coalesce(F.col("s") - F.col("m") * F.col("mu"), F.lit(0.0)).alias("val"), F.coalesce("m", F.lit(0.0)).alias("m"))
    if mass:
        val = val.withColumn("val", F.when(F.col("m") > 0, F.col("val") / F.col("m")).otherwise(0.0))
    if square_root:
        val = val.withColumn("val", F.signum("val") * F.sqrt(F.abs("val")))
    if components:
        val = _unit(val, ["k"])
    if normalize:
        val = _unit(val, [])
    return val.select("k", "dim", "val")


def _unit(val: DataFrame, by: list[str]) -> DataFrame:
    norms = val.groupBy(*by).agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("__n"))
    joined = val.join(norms, by) if by else val.crossJoin(F.broadcast(norms))  # one row
    return joined.withColumn("val", F.col("val") / F.greatest("__n", F.lit(1e-12))).drop("__n")


def posteriors(v: Column, mixture: list[tuple[list[float], list[float], float]]) -> Column:
    """Array of posterior probabilities under a diagonal mixture ``(mean, variance, prior)``."""
    logs = []
    for mean, var, prior in mixture:
        const = math.log(prior) - 0.5 * (len(mean) * math.log(2 * math.pi) + sum(map(math.log, var)))
        terms = F.zip_with(v, F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(1.0 / s).alias("i")) for m, s in zip(mean, var, strict=True))), lambda x, p: (x.cast("double") - p["m"]) * (x.cast("double") - p["m"]) * p["i"])
        logs.append(F.lit(const) - 0.5 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    every = F.array(*logs)
    up = F.transform(every, lambda x: F.exp(x - F.array_max(every)))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def fisher(data: DataFrame, mixture: list[tuple[list[float], list[float], float]], improved: bool = False) -> DataFrame:
    """``k, moment, dim, val``: first and second order statistics of ``data`` (``id, v``)
    under a diagonal mixture, divided by n sqrt(prior) and n sqrt(2 prior).

    ``improved`` takes the signed square root and L2-normalises.
    """
    q = data.select("v", posteriors(F.col("v"), mixture).alias("q")).select("v", F.posexplode("q").alias("k", "q"))
    params = data.sparkSession.createDataFrame([(k, list(map(float, m)), list(map(float, s)), float(p)) for k, (m, s, p) in enumerate(mixture)], "k int, mu array<double>, s2 array<double>, prior double")
    cells = params.select("k", "prior", F.posexplode(F.arrays_zip("mu", "s2")).alias("dim", "g")).select("k", "prior", "dim", F.col("g.mu").alias("mu"), F.col("g.s2").alias("s2"))
    sums = q.select("k", "q", F.posexplode("v").alias("dim", "x")).groupBy("k", "dim").agg(F.sum("q").alias("q0"), F.sum(F.col("q") * F.col("x").cast("double")).alias("q1"), F.sum(F.col("q") * F.col("x").cast("double") ** 2).alias("q2"))
    n = data.agg(F.count("*").alias("n"))
    stats = cells.join(sums, ["k", "dim"]).crossJoin(F.broadcast(n))  # one row
    first = (F.col("q1") - F.col("q0") * F.col("mu")) / F.sqrt("s2") / (F.col("n") * F.sqrt("prior"))
    second = ((F.col("q2") - 2 * F.col("mu") * F.col("q1") + F.col("q0") * F.col("mu") ** 2) / F.col("s2") - F.col("q0")) / (F.col("n") * F.sqrt(2 * F.col("prior")))
    out = stats.select("k", "dim", F.explode(F.array(F.struct(F.lit(1).alias("moment"), first.alias("val")), F.struct(F.lit(2).alias("moment"), second.alias("val")))).alias("o")).select("k", "o.moment", "dim", "o.val")
    if improved:
        out = _unit(out.withColumn("val", F.signum("val") * F.sqrt(F.abs("val"))), [])
    return out.select("k", "moment", "dim", "val")


def kernel_map(x: Column, n: int = 1, kernel: str = "chi2", gamma: float = 1.0, period: float | None = None) -> Column:
    """2n + 1 features whose dot product approximates a homogeneous kernel (chi2,
    intersection or js), with a rectangular window, from the kernel's
    closed-form spectrum sampled at multiples of 2 pi / period."""
    period = period or {"chi2": 5.86 * math.sqrt(n) + 3.65, "intersection": 8.80 * math.sqrt(n) + 4.44, "js": 6.64 * math.sqrt(n) + 7.24}[kernel]
    step = 2 * math.pi / period
    spectrum = {
        "chi2": lambda w: 2.0 / (math.exp(math.pi * w) + math.exp(-math.pi * w)),
        "intersection": lambda w: (2.0 / math.pi) / (1 + 4 * w * w),
        "js": lambda w: (2.0 / math.log(4.0)) * 2.0 / (math.exp(math.pi * w) + math.exp(-math.pi * w)) / (1 + 4 * w * w),
    }[kernel]
    size = F.abs(x.cast("double"))
    power, log = F.pow(size, F.lit(gamma)), F.log(size)
    cells = [F.sqrt(step * spectrum(0.0) * power)]
    for j in range(1, n + 1):
        amp = F.sqrt(2 * step * spectrum(j * step) * power)
        cells += [amp * F.cos(j * step * log), amp * F.sin(j * step * log)]
    return F.when(x == 0, F.array(*[F.lit(0.0)] * (2 * n + 1))).otherwise(F.transform(F.array(*cells), lambda c: F.signum(x.cast("double")) * c))


def segment_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``df`` with its value replaced by the mean over its segment, capped at 1."""
    means = df.groupBy(*by).agg((F.sum(value) / (F.count(value) + 2.220446049250313e-16)).alias("__m"))
    return df.join(means, by).withColumn(value, F.least(F.lit(1.0), F.col("__m"))).select(*df.columns)


def rescale(df: DataFrame, value: str) -> DataFrame:
    """``df`` with its value rescaled to [0, 1]; a constant becomes 0."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.crossJoin(F.broadcast(ends)).withColumn(value, F.when(span > 0, (F.col(value) - F.col("__lo")) / span).otherwise(0.0)).drop("__lo", "__hi")  # one row
