"""Clustering: k-means (L2, L1, integer, hierarchical), diagonal GMM, AIB, quick shift, flat maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.vectors import pair_value
from trackloom.operators.distance import nearest_centre
from trackloom.plans.stages import durable


def _centres(df: DataFrame, k: int, seed: int) -> list[list[float]]:
    """Random selection of k distinct rows, by a seeded hash."""
    rows = df.where("v IS NOT NULL").select("v").distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(k).collect()
    return [[float(x) for x in r["v"]] for r in rows]


def plus_plus(df: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """k-means++: each next centre is a row drawn with probability proportional to its squared
    distance.  The draw is by exponential keys (the largest log(u) / d wins), so a
    round is one aggregation and repeats exactly."""
    chosen = _centres(df, 1, seed)
    for i in range(1, k):
        d = F.array_min(F.array(*(pair_value("l2", F.col("v"), F.array(*map(F.lit, c))) for c in chosen)))
        u = (F.pmod(F.xxhash64(F.lit(seed + i), "v"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        best = df.where("v IS NOT NULL").select("v", d.alias("d"), u.alias("u")).where("d > 0").agg(F.max_by("v", F.log("u") / F.col("d")).alias("v")).first()
        if best["v"] is None:
            break
        chosen.append([float(x) for x in best["v"]])
    return chosen


def kmeans(df: DataFrame, k: int, distance: str = "l2", init: str = "randsel", iterations: int = 20, min_change: float = 0.0, seed: int = 0, centres: list[list[float]] | None = None, integer: bool = False, repetitions: int = 1) -> tuple[list[list[float]], DataFrame, float]:
    """Lloyd's algorithm on ``id, v``: centres, assignments ``id, centre, d`` and the energy.

    Of several ``repetitions``, each from a start of its own, that of least energy is returned.

    A round is one grouped aggregation; only k centres reach the driver.  With
    ``l1`` a centre is the component-wise median.  Ties go to the lower
    centre; an empty cluster keeps its centre.  ``integer`` rounds centres
    down.  :func:`elkan_kmeans` computes fewer distances for the same rounds.
    """
    if repetitions > 1 and not centres:
        runs = (kmeans(df, k, distance, init, iterations, min_change, seed + r, None, integer) for r in range(repetitions))
        return min(runs, key=lambda run: run[2])
    centres = centres or (plus_plus(df, k, seed) if init == "plusplus" else _centres(df, k, seed))
    energy = math.inf
    rows = df.where("v IS NOT NULL").select("id", "v")
    dims = len(centres[0]) if centres else 0
    for _ in range(iterations):
        assigned = rows.withColumn("centre", nearest_centre(F.col("v"), list(enumerate(centres)), distance))
        literal = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("centre") + 1)
        scored = assigned.withColumn("d", pair_value(distance, F.col("v"), literal))
        middle = F.avg if distance == "l2" else F.median
        sums = scored.groupBy("centre").agg(F.array(*(middle(F.col("v")[j].cast("double")) for j in range(dims))).alias("c"), F.sum("d").alias("e")).collect()
        now = sum(r["e"] for r in sums)
        centres = [next(([float(math.floor(x)) if integer else float(x) for x in r["c"]] for r in sums if r["centre"] == i), c) for i, c in enumerate(centres)]
        if energy - now <= min_change * abs(energy) and energy != math.inf:
            break
        energy = now
    scored = rows.withColumn("centre", nearest_centre(F.col("v"), list(enumerate(centres)), distance))
    literal = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("centre") + 1)
    scored = scored.select("id", "centre", pair_value(distance, F.col("v"), literal).alias("d"))
    return centres, scored, scored.agg(F.sum("d")).first()[0] or 0.0


def hierarchical_kmeans(df: DataFrame, k: int, depth: int, iterations: int = 10, seed: int = 0) -> list[tuple[int, int, list[float]]]:
    """A tree of k-means as ``(node, parent, centre)``, nodes numbered breadth first from 1,
    root 0.  All nodes of a level are refined in the same aggregations."""
    tree: list[tuple[int, int, list[float]]] = []
    rows = df.where("v IS NOT NULL").select("id", "v").withColumn("parent", F.lit(0))
    number = 1
    dims = len(rows.first()["v"])
    for _ in range(depth):
        h = F.xxhash64(F.lit(seed), "v")
        ranked = rows.select("parent", "v", h.alias("h")).distinct()
        first = ranked.withColumn("r", F.row_number().over(W.partitionBy("parent").orderBy("h", "v"))).where(F.col("r") <= k).collect()
        level = sorted((r["parent"], r["r"], [float(x) for x in r["v"]]) for r in first)
        nodes = [(number + i, parent, c) for i, (parent, _, c) in enumerate(level)]
        number += len(nodes)
        for _ in range(iterations):
            placed = _to_children(rows, nodes)
            sums = {r["node"]: [float(x) for x in r["c"]] for r in placed.groupBy("node").agg(F.array(*(F.avg(F.col("v")[j].cast("double")) for j in range(dims))).alias("c")).collect()}
            nodes = [(n, p, sums.get(n, c)) for n, p, c in nodes]
        tree += nodes
        rows = durable(_to_children(rows, nodes).select("id", "v", F.col("node").alias("parent")))
    return tree


def _to_children(rows: DataFrame, nodes: list[tuple[int, int, list[float]]]) -> DataFrame:
    """Each row with the nearest child of its parent, taken where the row is."""
    table = rows.sparkSession.createDataFrame(nodes, "node int, parent int, c array<double>")
    children = table.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("node", "c"))).alias("__c"))
    best = F.array_min(F.transform("__c", lambda r: F.struct(pair_value("l2", F.col("v"), r["c"]).alias("d"), r["node"].alias("node"))))
    return rows.join(F.broadcast(children), "parent").select("id", "v", best["node"].alias("node"))


def _bounded(centres: np.ndarray, before: np.ndarray | None):
    """A round over ``id, v, centre, upper, lower``: the nearest centres, with ``computed`` distances for each row.

    ``upper`` is at least the distance to the row's centre, ``lower`` at most that to each; what a
    centre has moved since the last round is taken off, so the triangle inequality settles most
    rows without a distance.
    """
    k = len(centres)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) / 2
    alone = np.where(np.eye(k, dtype=bool), np.inf, apart).min(1) if k > 1 else np.full(1, np.inf)
    moved = np.zeros(k) if before is None else np.sqrt(((centres - before) ** 2).sum(1))
    slack = 1e-9

    def nearest(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        computed = np.zeros(len(x), np.int64)
        gap = lambda rows, j: np.sqrt(((x[rows] - centres[j]) ** 2).sum(-1))
        if before is None:
            for j in range(k):
                lower[:, j] = gap(slice(None), j)
            at[:], upper[:], computed[:] = lower.argmin(1), lower.min(1), k
            return computed
        np.maximum(lower - moved - slack, 0, out=lower)
        upper += moved[at] + slack
        open_ = np.nonzero(upper >= alone[at])[0]
        # rows that some other centre may claim have their own distance taken first
        claimed = (upper[open_, None] >= lower[open_]) & (upper[open_, None] >= apart[at[open_]])
        claimed[np.arange(len(open_)), at[open_]] = False
        open_ = open_[claimed.any(1)]
        upper[open_] = lower[open_, at[open_]] = gap(open_, at[open_])
        computed[open_] += 1
        for j in range(k):
            rows = open_[(at[open_] != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= apart[at[open_], j])]
            d = lower[rows, j] = gap(rows, j)
            computed[rows] += 1
            wins = (d < upper[rows]) | ((d == upper[rows]) & (j < at[rows]))
            at[rows[wins]], upper[rows[wins]] = j, d[wins]
        return computed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            at, upper = (batch.column(i).to_numpy().copy() for i in (2, 3))
            lower = batch.column(4).flatten().to_numpy().reshape(len(batch), -1).copy() if before is not None else np.zeros((len(batch), k))
            computed = nearest(x, at, upper, lower) if len(batch) else np.zeros(0, np.int64)
            cuts = pa.array(np.arange(0, len(batch) * k + 1, k), pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at), pa.array(upper), pa.ListArray.from_arrays(cuts, pa.array(lower.ravel())), pa.array(computed)], names=["id", "v", "centre", "upper", "lower", "computed"])

    return run


def elkan_kmeans(df: DataFrame, centres: list[list[float]], iterations: int = 20) -> tuple[list[list[float]], DataFrame, list[int]]:
    """Lloyd's rounds on ``id, v`` (vectors of one length) from given centres, with triangle-inequality bounds kept
    beside each row: the centres, the last round's assignments ``id, centre, d`` (to the centres that it
    began with), and the distances that each round computed.

    A round is written to the shared folder and read by the next; it stops early where no centre
    moves.  Ties go to the lower centre; an empty cluster keeps its centre; rows without a vector take no part.
    """
    kind = df.schema["id"].dataType.simpleString()
    state = df.where("v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("centre"), F.lit(0.0).alias("upper"), F.array().cast("array<double>").alias("lower"), F.lit(0).cast("long").alias("computed"))
    now, before, counted = np.array(centres, float), None, []
    for _ in range(iterations):
        state = durable(state.mapInArrow(_bounded(now, before), f"id {kind}, v array<double>, centre int, upper double, lower array<double>, computed long"))
        means = state.groupBy("centre").agg(F.array(*(F.avg(F.col("v")[j]) for j in range(now.shape[1]))).alias("c"), F.sum("computed").alias("computed")).collect()
        counted.append(sum(r["computed"] for r in means))
        before, now = now, now.copy()
        for r in means:
            now[r["centre"]] = r["c"]
        if (now == before).all():
            break
    began = F.broadcast(df.sparkSession.createDataFrame([(j, c) for j, c in enumerate((now if before is None else before).tolist())], "centre int, c array<double>"))
    return now.tolist(), state.join(began, "centre").select("id", "centre", pair_value("l2", F.col("v"), F.col("c")).alias("d")), counted


def gmm(df: DataFrame, means: list[list[float]], iterations: int = 10, bound: float = 1e-6) -> tuple[list[list[float]], list[list[float]], list[float], float]:
    """Diagonal-covariance mixture by EM from given means: means, variances, priors, log likelihood.

    A round is one aggregation of posterior sums over all rows.
    """
    dims, k = len(means[0]), len(means)
    rows = df.where("v IS NOT NULL").select("v")
    start = rows.agg(*(F.var_pop(F.col("v")[j].cast("double")).alias(f"v{j}") for j in range(dims))).first()
    covs = [[max(start[f"v{j}"], bound) for j in range(dims)] for _ in range(k)]
    priors, loglik = [1.0 / k] * k, -math.inf
    for _ in range(iterations):
        logs = [_log_density(F.col("v"), m, c) + math.log(p) for m, c, p in zip(means, covs, priors, strict=True)]
        top = F.greatest(*(F.col(f"l{i}") for i in range(k))) if k > 1 else F.col("l0")
        scored = rows.select("v", *(x.alias(f"l{i}") for i, x in enumerate(logs))).withColumn("top", top)
        total = sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in range(1, k)), F.exp(F.col("l0") - F.col("top")))
        scored = scored.withColumn("z", F.col("top") + F.log(total)).select("v", "z", *(F.exp(F.col(f"l{i}") - F.col("z")).alias(f"q{i}") for i in range(k)))
        x = lambda j: F.col("v")[j].cast("double")
        r = scored.agg(F.sum("z").alias("z"), F.count("*").alias("n"), *(F.sum(f"q{i}").alias(f"q{i}") for i in range(k)), *(F.sum(F.col(f"q{i}") * x(j)).alias(f"s{i}_{j}") for i in range(k) for j in range(dims)), *(F.sum(F.col(f"q{i}") * x(j) * x(j)).alias(f"t{i}_{j}") for i in range(k) for j in range(dims))).first()
        loglik = r["z"]
        weight = [max(r[f"q{i}"], 1e-300) for i in range(k)]
        priors = [w / r["n"] for w in weight]
        means = [[r[f"s{i}_{j}"] / weight[i] for j in range(dims)] for i in range(k)]
        covs = [[max(r[f"t{i}_{j}"] / weight[i] - means[i][j] ** 2, bound) for j in range(dims)] for i in range(k)]
    return means, covs, priors, loglik


def gmm_start(df: DataFrame, k: int, init: str = "rand", seed: int = 0) -> list[list[float]]:
    """Means to begin with: ``rand``, k rows by a seeded hash; ``kmeans``, the centres of k-means from such rows."""
    return kmeans(df, k, iterations=10, seed=seed)[0] if init == "kmeans" else _centres(df, k, seed)


def fit_gmm(df: DataFrame, k: int, init: str = "rand", iterations: int = 10, repetitions: int = 1, bound: float = 1e-6, seed: int = 0) -> tuple[list[list[float]], list[list[float]], list[float], float]:
    """:func:`gmm` from chosen starts (:func:`gmm_start`): of ``repetitions``, that of the highest likelihood."""
    return max((gmm(df, gmm_start(df, k, init, seed + r), iterations, bound) for r in range(repetitions)), key=lambda run: run[3])


def gmm_posteriors(df: DataFrame, means: list[list[float]], covs: list[list[float]], priors: list[float]) -> DataFrame:
    """``id, q``: the posterior of every component for ``id, v``; null vectors have none."""
    logs = F.array(*(_log_density(F.col("v"), m, c) + math.log(p) for m, c, p in zip(means, covs, priors, strict=True)))
    scored = df.select("id", F.when(F.col("v").isNotNull(), logs).alias("l"))
    scored = scored.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    return scored.select("id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, t: s + t)).alias("q"))


def _log_density(v, mean: list[float], cov: list[float]):
    """Log of a diagonal Gaussian."""
    const = -0.5 * (len(mean) * math.log(2 * math.pi) + sum(map(math.log, cov)))
    inv = F.array(*(F.lit(1 / c) for c in cov))
    d2 = F.zip_with(F.zip_with(v, F.array(*map(F.lit, mean)), lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), inv, lambda a, b: a * b)
    return F.lit(const) - 0.5 * F.aggregate(d2, F.lit(0.0), lambda s, t: s + t)


def mutual_information(counts: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """``mi`` (nats) of a co-occurrence table, in one row."""
    total = counts.agg(F.sum(n).alias("__t"))
    pa = counts.groupBy(a).agg(F.sum(n).alias("__a"))
    pb = counts.groupBy(b).agg(F.sum(n).alias("__b"))
    joined = counts.where(F.col(n) > 0).join(pa, a).join(pb, b).crossJoin(F.broadcast(total))
    p = F.col(n) / F.col("__t")
    return joined.agg(F.sum(p * F.log(F.col(n) * F.col("__t") / (F.col("__a") * F.col("__b")))).alias("mi"))


def aib(pcx: np.ndarray) -> tuple[list[int], list[float]]:
    """Agglomerative information bottleneck of P(c, x): parents of the 2 * n - 1 nodes
    (1-based, the root's is 1) and the information after each merge.

    The table has a row for each class and a column for each value; it is an
    aggregate, and the merging is sequential by nature, so it runs here.
    A merge takes the pair that loses least; ties go to the earlier pair.
    Values with zero probability are left out (parent 0).
    """
    p = np.asarray(pcx, np.float64)
    p = p / p.sum()
    n = p.shape[1]
    pc = p.sum(1)

    def info(col: np.ndarray) -> float:
        px, keep = col.sum(), col > 0
        return float((col[keep] * np.log(col[keep] / (pc[keep] * px))).sum()) if px > 0 else 0.0

    columns = {i: p[:, i] for i in range(n) if p[:, i].sum() > 0}
    parents, left = [0] * (2 * n - 1), {i: info(c) for i, c in columns.items()}
    steps, node = [sum(left.values())], n
    while len(columns) > 1:
        ids = sorted(columns)
        loss, a, b = min((left[i] + left[j] - info(columns[i] + columns[j]), i, j) for x, i in enumerate(ids) for j in ids[x + 1 :])
        columns[node] = columns.pop(a) + columns.pop(b)
        left[node] = info(columns[node])
        parents[a] = parents[b] = node + 1
        steps.append(steps[-1] - loss)
        node += 1
    parents[node - 1 if node > n else next(iter(columns), 0)] = 1
    return parents, steps


def aib_cut(parents: list[int], n: int) -> tuple[list[int], list[int]]:
    """The cut of a merge tree into ``n`` clusters: its nodes (1-based, ascending), and the
    cluster of every node (0 above the cut or for values left out)."""
    leaves = (len(parents) + 1) // 2
    kids: dict[int, list[int]] = {}
    for i, up in enumerate(parents, 1):
        if up not in (0, 1) or (up == 1 and i != max((j for j, x in enumerate(parents, 1) if x), default=1)):
            kids.setdefault(up, []).append(i)
    root = max((j for j, x in enumerate(parents, 1) if x), default=1)
    cut = [root]
    while len(cut) < n and any(c > leaves for c in cut):
        top = max(cut)  # merged last
        cut.remove(top)
        cut += kids.get(top, [])
    cut.sort()
    cluster = [0] * len(parents)
    for k, top in enumerate(cut, 1):
        stack = [top]
        while stack:
            x = stack.pop()
            cluster[x - 1] = k
            stack += kids.get(x, [])
    return cut, cluster


def flat_map(parents: DataFrame) -> DataFrame:
    """``node, root`` of a parent table ``node, parent`` whose roots are their own parents.
    Pointer doubling: the rounds are the logarithm of the depth."""
    at = parents.select("node", F.col("parent").alias("root"))
    while True:
        hop = at.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        onward = durable(at.join(hop, "root").select("node", F.col("__next").alias("root"), (F.col("__next") != F.col("root")).alias("__moved")))
        if onward.where("__moved").isEmpty():
            return onward.select("node", "root")
        at = onward.select("node", "root")


def quick_shift(points: DataFrame, sigma: float, max_dist: float, image: list[str] | None = None) -> DataFrame:
    """``y, x, density, parent_y, parent_x, gap``: each pixel links to the nearest pixel of
    higher density within ``max_dist`` (itself if there is none, gap infinite).

    ``points`` are pixels ``y, x, f`` with a feature array; distance is over
    position and feature.  The neighbourhood is a square of offsets exploded
    into an equi-join, so no pairs beyond it are made.  Densities are rounded to
    nine decimals, so that sums in another order tie alike, and equal ones are
    told apart by position.
    """
    image = image or []
    reach = max(1, math.ceil(max(3 * sigma, max_dist)))
    p = points.select(*image, "y", "x", "f")
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    sent = p.select(*image, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("f").alias("f0"), F.explode(offsets).alias("dy")).select("*", F.explode(offsets).alias("dx"))
    sent = sent.withColumn("y", F.col("y0") + F.col("dy")).withColumn("x", F.col("x0") + F.col("dx"))
    near = sent.join(p, [*image, "y", "x"]).select(*image, "y0", "x0", "y", "x", (F.col("dy") ** 2 + F.col("dx") ** 2 + pair_value("l2", F.col("f0"), F.col("f"))).alias("d2"))
    near = durable(near)
    density = durable(near.groupBy(*image, F.col("y0").alias("y"), F.col("x0").alias("x")).agg(F.round(F.sum(F.exp(-F.col("d2") / (2 * sigma * sigma))), 9).alias("density")))
    mine = density.select(*image, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("density").alias("own"))
    higher = near.join(density, [*image, "y", "x"]).join(mine, [*image, "y0", "x0"])
    up = (F.col("density") > F.col("own")) | ((F.col("density") == F.col("own")) & ((F.col("y") < F.col("y0")) | ((F.col("y") == F.col("y0")) & (F.col("x") < F.col("x0")))))
    best = higher.where(up & (F.col("d2") <= max_dist**2)).groupBy(*image, "y0", "x0").agg(F.min(F.struct("d2", "y", "x")).alias("m"))
    best = best.select(*image, F.col("y0").alias("y"), F.col("x0").alias("x"), F.col("m.y").alias("py"), F.col("m.x").alias("px"), F.sqrt("m.d2").alias("g"))
    joined = density.join(best, [*image, "y", "x"], "left")
    return joined.select(*image, "y", "x", "density", F.coalesce("py", "y").alias("parent_y"), F.coalesce("px", "x").alias("parent_x"), F.coalesce("g", F.lit(float("inf"))).alias("gap"))


def medoid_shift(points: DataFrame, sigma: float, image: list[str] | None = None) -> DataFrame:
    """``y, x, parent_y, parent_x, gap``: each pixel links to the medoid of its neighbourhood, the pixel of
    least Gaussian-weighted squared distance to the others in it.

    For squared distances that is the pixel next to the weighted mean, so a
    neighbourhood is averaged once and no triples are made.  Distances are
    rounded to nine decimals and ties go by position.
    """
    image, reach = image or [], max(1, math.ceil(3 * sigma))
    first = points.first()
    dims = len(first["f"]) if first else 0
    p = points.select(*image, "y", "x", "f")
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    sent = p.select(*image, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("f").alias("f0"), F.explode(offsets).alias("dy")).select("*", F.explode(offsets).alias("dx"))
    near = durable(sent.withColumn("y", F.col("y0") + F.col("dy")).withColumn("x", F.col("x0") + F.col("dx")).join(p, [*image, "y", "x"]).drop("dy", "dx"))
    at = [*image, "y0", "x0"]
    d2 = (F.col("y") - F.col("y0")) ** 2 + (F.col("x") - F.col("x0")) ** 2 + pair_value("l2", F.col("f0"), F.col("f"))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    means = near.withColumn("w", F.exp(-d2 / (2 * sigma * sigma))).groupBy(*at).agg(mean(F.col("y")).alias("my"), mean(F.col("x")).alias("mx"), F.array(*(mean(F.col("f")[k]) for k in range(dims))).alias("mf"))
    off = F.round((F.col("y") - F.col("my")) ** 2 + (F.col("x") - F.col("mx")) ** 2 + pair_value("l2", F.col("mf"), F.col("f")), 9)
    best = near.join(means, at).select(*at, F.struct(off.alias("d"), "y", "x", d2.alias("g")).alias("m")).groupBy(*at).agg(F.min("m").alias("m"))
    return best.select(*image, F.col("y0").alias("y"), F.col("x0").alias("x"), F.col("m.y").alias("parent_y"), F.col("m.x").alias("parent_x"), F.sqrt("m.g").alias("gap"))
