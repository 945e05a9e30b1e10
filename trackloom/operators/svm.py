"""Linear support vector machines: lambda / 2 |w|^2 + mean loss, on aggregated gradients."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Loss and its derivative in the score, of score z and label y.
LOSSES: dict[str, tuple[Callable, Callable]] = {
    "hinge": (lambda z, y: F.greatest(F.lit(0.0), 1 - y * z), lambda z, y: F.when(y * z < 1, -y).otherwise(0.0)),
    "hinge2": (lambda z, y: F.pow(F.greatest(F.lit(0.0), 1 - y * z), F.lit(2)), lambda z, y: F.when(y * z < 1, -2 * y * (1 - y * z)).otherwise(0.0)),
    "l1": (lambda z, y: F.abs(z - y), lambda z, y: F.signum(z - y)),
    "l2": (lambda z, y: (z - y) * (z - y), lambda z, y: 2 * (z - y)),
    "logistic": (lambda z, y: F.log1p(F.exp(-y * z)), lambda z, y: -y / (1 + F.exp(y * z))),
}


def score(x: Column, w: list[float], b: float) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, w))), lambda a, c: a.cast("double") * c), F.lit(float(b)), lambda s, t: s + t)


def train(data: DataFrame, lam: float, loss: str = "hinge", steps: int = 100, bias_multiplier: float = 1.0, weight: str | None = None, callback: Callable[[dict], None] | None = None, batch: float = 1.0) -> tuple[np.ndarray, float, float]:
    """Weights, bias and objective for ``x, y`` (y = 1 or -1).

    Subgradient steps 1 / (lambda t) with averaging of the second half, as in
    Pegasos; every step is one aggregation over all rows, and only its sums reach
    the driver.  ``callback`` gets the state of every tenth step.  The bias is
    regularised, scaled by its multiplier, like a constant feature.  With
    ``batch`` below 1 a step sees that share of the rows, another one by hash each
    time (stochastic descent); the objective returned is always of all rows.
    """
    value, slope = LOSSES[loss]
    data = data.where("x IS NOT NULL AND y IS NOT NULL")
    dims = len(data.first()["x"])
    w, kept, n_kept = np.zeros(dims + 1), np.zeros(dims + 1), 0
    scale = F.col(weight) if weight else F.lit(1.0)

    def sums(w: np.ndarray, t: int = 0):
        some = data.where(F.pmod(F.xxhash64("x", "y", F.lit(t)), F.lit(1 << 20)) < batch * (1 << 20)) if t and batch < 1 else data
        z = score(F.col("x"), w[:-1].tolist(), w[-1] * bias_multiplier)
        g = (slope(z, F.col("y")) * scale).alias("g")
        rows = some.select("x", g, (value(z, F.col("y")) * scale).alias("l"))
        r = rows.agg(F.count("*").alias("n"), F.sum("l").alias("l"), F.sum("g").alias("b"), *(F.sum(F.col("g") * F.col("x")[j]).alias(f"g{j}") for j in range(dims))).first()
        if not r["n"]:
            return 0.0, np.zeros(dims + 1)
        return r["l"] / r["n"], np.array([*(r[f"g{j}"] for j in range(dims)), r["b"] * bias_multiplier]) / r["n"]

    for t in range(1, steps + 1):
        mean_loss, g = sums(w, t)
        if callback and t % 10 == 1:
            callback({"step": t, "loss": mean_loss, "objective": lam / 2 * float(w @ w) + mean_loss})
        w = w - (lam * w + g) / (lam * (t + 1))
        size = np.linalg.norm(w)
        if loss == "hinge" and size > lam**-0.5:
            w *= lam**-0.5 / size
        if 2 * t > steps:
            kept, n_kept = kept + w, n_kept + 1
    w = kept / max(1, n_kept)
    mean_loss, _ = sums(w)
    return w[:-1], float(w[-1] * bias_multiplier), lam / 2 * float(w @ w) + mean_loss


def train_dual(data: DataFrame, lam: float, rounds: int = 10, bias_multiplier: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """Weights, bias and objective of the hinge loss by stochastic dual coordinate ascent.

    Every partition ascends in its own rows' dual variables from the common
    weights, and the changes are averaged over the partitions; the variables
    stay with their rows, in the shared folder, and only the weights' sums
    reach the driver.
    """
    from trackloom.plans.stages import durable

    rows = durable(data.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("a")))
    n, dims = rows.count(), len(rows.first()["x"])
    w = np.zeros(dims + 1)

    def ascend(w: np.ndarray, parts: int, turn: int):
        def run(batches):
            frames = list(batches)
            if not frames:
                return
            for pdf in frames:
                x = np.column_stack([np.stack(pdf["x"].to_numpy()).astype(float), np.full(len(pdf), bias_multiplier)])
                y, a, here = pdf["y"].to_numpy(), pdf["a"].to_numpy().copy(), w.copy()
                size = np.maximum((x * x).sum(1), 1e-12)
                for i in np.random.RandomState(seed + turn).permutation(len(pdf)):
                    to = min(1.0, max(0.0, a[i] + (1 - y[i] * (x[i] @ here)) * lam * n / size[i]))
                    here += (to - a[i]) * y[i] / (lam * n) * x[i]
                    a[i] = to
                yield pdf.assign(a=pdf["a"] + (a - pdf["a"]) / parts)

        return run

    for turn in range(rounds):
        # an Arrow batch ascends by itself, so batches are what is averaged over
        parts = max(1, rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.ceil(F.count("*") / 10_000).alias("b")).agg(F.sum("b")).first()[0] or 1)
        rows = durable(rows.mapInPandas(ascend(w, parts, turn), "x array<double>, y double, a double"))
        r = rows.agg(*(F.sum(F.col("a") * F.col("y") * F.col("x")[j]).alias(f"w{j}") for j in range(dims)), F.sum(F.col("a") * F.col("y") * bias_multiplier).alias("b")).first()
        w = np.array([*(r[f"w{j}"] for j in range(dims)), r["b"]]) / (lam * n)
    z = score(F.col("x"), w[:-1].tolist(), w[-1] * bias_multiplier)
    mean_loss = rows.agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col("y") * z))).first()[0]
    return w[:-1], float(w[-1] * bias_multiplier), lam / 2 * float(w @ w) + mean_loss


#: The names of an earlier interface.
pegasos = train


def predict(data: DataFrame, w: list[float], b: float) -> DataFrame:
    """``data`` with ``score``: the model applied, nothing fitted."""
    return data.withColumn("score", score(F.col("x"), list(w), b))
