"""Grouped geometric fitting: homographies, RANSAC, mesh warps, bundled-path updates.

Each kernel fits one group (a pair of frames, a mesh) in numpy; the grouped
operators run it with ``applyInPandas``.  Random draws are seeded by the
group, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import cell_of

CONFIDENCE, MOST_TRIALS, MOST_DRAWS = 0.99, 1000, 100


def normalise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their centroid and scaled to mean distance sqrt 2, and the 3 x 3 map."""
    mid = p.mean(0)
    far = np.linalg.norm(p - mid, axis=1).mean()
    s = math.sqrt(2) / far if far > 0 else 1.0
    t = np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])
    return (p - mid) * s, t


def apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def dlt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The homography of least algebraic error that takes points ``a`` to ``b`` (4 or more), with h33 = 1."""
    if len(a) < 4:
        raise ValueError("a homography needs four points")
    (na, ta), (nb, tb) = normalise(a), normalise(b)
    x, y, one, zero = na[:, 0], na[:, 1], np.ones(len(a)), np.zeros(len(a))
    rows = []
    for u, v, sign in ((nb[:, 0], (x, y, one, zero, zero, zero), 1), (nb[:, 1], (zero, zero, zero, x, y, one), 1)):
        rows.append(np.stack([*v, -u * x * sign, -u * y * sign, -u * sign], axis=1))
    # the triangle has the rows' right singular vectors; their left ones would be a square of all points
    h = np.linalg.svd(np.linalg.qr(np.concatenate(rows), mode="r"))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def transfer_errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symmetric squared transfer errors; infinite for a singular map."""
    if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-15:
        return np.full(len(a), np.inf)
    with np.errstate(all="ignore"):
        d = ((apply(h, a) - b) ** 2).sum(1) + ((apply(np.linalg.inv(h), b) - a) ** 2).sum(1)
    return np.where(np.isfinite(d), d, np.inf)


def collinear(p: np.ndarray, eps: float = 1e-9) -> bool:
    """Are any three of four points on a line?"""
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        u, v = p[j] - p[i], p[k] - p[i]
        if abs(u[0] * v[1] - u[1] * v[0]) < eps:
            return True
    return False


def ransac(n: int, fit: Callable, errors: Callable, degenerate: Callable, s: int, t: float, seed: int, score: Callable | None = None, keep_ties: bool = False, pick: Callable | None = None):
    """The model with the best score over random samples of ``s`` of ``n`` rows, and its inliers.

    ``score`` judges an inlier mask (their number, by default).  The number of
    trials adapts to the best share of inliers at 99 % confidence, up to 1000;
    a degenerate sample is drawn again up to 100 times.  No model: (None, no
    inliers).
    """
    rng, best, found = np.random.RandomState(seed), -np.inf, (None, np.zeros(n, bool))
    score = score or np.sum
    trial, needed = 0, 1.0
    while n >= s and trial < min(needed, MOST_TRIALS):
        for _ in range(MOST_DRAWS):
            sample = pick(rng) if pick else rng.choice(n, s, replace=False)
            if sample is not None and not degenerate(sample):
                break
        else:
            break
        model = fit(sample)
        inliers = errors(model) < t
        value = score(inliers)
        if value > best or (keep_ties and value == best):
            best, found = value, (model, inliers)
            share = np.clip(inliers.mean(), 1e-6, 1 - 1e-9)
            needed = math.log(1 - CONFIDENCE) / math.log1p(-min(share**s, 1 - 1e-12))
        trial += 1
    return found


def ransac_homography(a: np.ndarray, b: np.ndarray, t: float, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """Normalise, RANSAC on four points, DLT on the inliers, denormalise."""
    if len(a) < 4:
        return None, np.zeros(len(a), bool)
    (na, ta), (nb, tb) = normalise(a), normalise(b)
    _, inliers = ransac(len(a), lambda s: dlt(na[s], nb[s]), lambda h: transfer_errors(h, na, nb), lambda s: collinear(na[s]) or collinear(nb[s]), 4, t, seed)
    if inliers.sum() < 4:
        return None, inliers
    h = np.linalg.inv(tb) @ dlt(na[inliers], nb[inliers]) @ ta
    return h / h[2, 2], inliers


def ransac_homography_cells(a: np.ndarray, b: np.ndarray, t: float, cells: np.ndarray, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """As :func:`ransac_homography`, but samples come from four different cells, an inlier set is
    judged by the cells it covers, and ``t`` doubles until the inliers cover 20
    cells and a third of those that have points (at most ten times)."""
    every = np.unique(cells)
    covered = lambda m: len(np.unique(cells[m]))

    def pick(rng):
        if len(every) < 4:
            return rng.choice(len(a), 4, replace=False)
        return np.array([rng.choice(np.flatnonzero(cells == c)) for c in rng.choice(every, 4, replace=False)])

    if len(a) < 4:
        return None, np.zeros(len(a), bool)
    (na, ta), (nb, tb) = normalise(a), normalise(b)
    for _ in range(10):
        _, inliers = ransac(len(a), lambda s: dlt(na[s], nb[s]), lambda h: transfer_errors(h, na, nb), lambda s: collinear(na[s]) or collinear(nb[s]), 4, t, seed, covered, True, pick)
        if covered(inliers) >= min(20, len(every)) and covered(inliers) >= 0.3 * len(every):
            break
        t *= 2
    if inliers.sum() < 4:
        return None, inliers
    h = np.linalg.inv(tb) @ dlt(na[inliers], nb[inliers]) @ ta
    return h / h[2, 2], inliers


def group_seed(*key) -> int:
    return zlib.crc32(repr(key).encode())


def fit_homographies(matches: DataFrame, keys: list[str], t: float = 0.005, cells: str | None = None) -> DataFrame:
    """``keys, h, n, inliers`` for matches ``xa, ya, xb, yb`` of every group; h is null where none fits.
    With a column ``cells`` samples and scores go by cells (:func:`ransac_homography_cells`)."""
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["xa", "ya", "xb", "yb"]).sort_values(["xa", "ya", "xb", "yb"])
        a, b, seed = pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float), group_seed(*map(str, key))
        h, inliers = ransac_homography_cells(a, b, t, pdf[cells].to_numpy(), seed) if cells else ransac_homography(a, b, t, seed)
        return pd.DataFrame([(*key, None if h is None else h.ravel().tolist(), len(pdf), int(inliers.sum()))], columns=[*keys, "h", "n", "inliers"])

    return matches.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", h array<double>, n long, inliers long")


def residual_filter(points: DataFrame, width: float, height: float, most: float = 1000.0) -> DataFrame:
    """Pre-warped points ``xa, ya`` in the frame whose squared distance to ``xb, yb`` is below ``most``."""
    near = (F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2 < most
    return points.where(near & (F.col("xa") > 0) & (F.col("ya") > 0) & (F.col("xa") < width) & (F.col("ya") < height))


def quad_smoothness(points: DataFrame, x: str, y: str, width: float, height: float, cells: int, smooth: float = 1.0) -> DataFrame:
    """``row, col, n, weight`` of every quad of a mesh: its points, and its smoothness, which falls with
    them within [0.2, 5] times ``smooth``."""
    row, col = cell_of(F.col(x) - 0.001, F.col(y) - 0.001, width / cells, height / cells, cells)
    counts = points.groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))
    mesh = points.sparkSession.range(cells * cells).select((F.floor(F.col("id") / cells) + 1).cast("int").alias("row"), (F.col("id") % cells + 1).cast("int").alias("col"))
    total = points.agg(F.count("*").alias("__total"))
    every = mesh.join(counts, ["row", "col"], "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))
    share = F.when(F.col("n") == 0, 5.0).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(0.2), F.col("__total") / cells**2 / F.col("n"))))
    return every.select("row", "col", "n", (smooth * share).alias("weight"))


def mesh_vertices(width: float, height: float, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertex coordinates of a ``cells`` x ``cells`` mesh, from 1 to the image's size."""
    return np.linspace(1, width, cells + 1), np.linspace(1, height, cells + 1)


def mesh_grid(sizes: DataFrame, keys: list[str], cells: int, width: str = "width", height: str = "height") -> DataFrame:
    """``keys, i, j, x, y``: the vertices of :func:`mesh_vertices` as rows, for every ``keys, width, height``."""
    place = lambda c, size: 1 + F.col(c) * ((F.col(size) - 1) / cells)
    rows = sizes.select(*keys, width, height, F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("j"))
    return rows.select(*keys, "i", "j", place("j", width).alias("x"), place("i", height).alias("y"))


#: The two corners that, with a quad's corner, make each of its eight triangles: (corner, (second, third)).
TRIANGLES = [((0, 0), ((1, 0), (1, 1))), ((0, 0), ((0, 1), (1, 1))), ((0, 1), ((0, 0), (1, 0))), ((0, 1), ((1, 1), (1, 0))), ((1, 0), ((0, 0), (0, 1))), ((1, 0), ((1, 1), (0, 1))), ((1, 1), ((1, 0), (0, 0))), ((1, 1), ((0, 1), (0, 0)))]


def similar_warp(a: np.ndarray, b: np.ndarray, width: float, height: float, cells: int = 8, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """As-similar-as-possible mesh warp from control points ``a`` to ``b``: vertices
    ``(cells + 1, cells + 1, 2)`` and a homography for each cell.

    One row pair for each triangle of a quad keeps its shape, one for each
    control point keeps its bilinear place.  The smoothness of a quad falls
    with the control points in it, within [0.2, 5].
    """
    xs, ys = mesh_vertices(width, height, cells)
    n = cells + 1
    index = lambda r, c: r * n + c
    col = np.clip(np.searchsorted(xs, a[:, 0], "right") - 1, 0, cells - 1)
    row = np.clip(np.searchsorted(ys, a[:, 1], "right") - 1, 0, cells - 1)
    counts = np.zeros((cells, cells))
    np.add.at(counts, (row, col), 1)
    expected = max(len(a) / cells**2, 1e-9)
    normal, right = np.zeros((2 * n * n, 2 * n * n)), np.zeros(2 * n * n)

    def add(entries: list[tuple[int, float]], value: float, weight: float) -> None:
        i, v = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
        normal[np.ix_(i, i)] += weight * np.outer(v, v)
        right[i] += weight * value * v

    for r in range(cells):
        for c in range(cells):
            weight = smooth * min(5.0, max(0.2, expected / max(counts[r, c], 1e-9)))
            for (r1, c1), ((r2, c2), (r3, c3)) in TRIANGLES:
                p1, p2, p3 = (np.array([xs[c + y], ys[r + x]]) for x, y in ((r1, c1), (r2, c2), (r3, c3)))
                e, d = p3 - p2, p1 - p2
                u, v = (d @ e) / (e @ e), (d[0] * e[1] - d[1] * e[0]) / (e @ e)
                i1, i2, i3 = (2 * index(r + x, c + y) for x, y in ((r1, c1), (r2, c2), (r3, c3)))
                # v1 = v2 + u (v3 - v2) + v R (v3 - v2), R a quarter turn
                add([(i1, 1.0), (i2, u - 1), (i3, -u), (i3 + 1, -v), (i2 + 1, v)], 0.0, weight)
                add([(i1 + 1, 1.0), (i2 + 1, u - 1), (i3 + 1, -u), (i3, v), (i2, -v)], 0.0, weight)
    fx = (a[:, 0] - xs[col]) / (xs[col + 1] - xs[col])
    fy = (a[:, 1] - ys[row]) / (ys[row + 1] - ys[row])
    # a point's four corners: products of their shares, and shares times its place, added up by corner
    corners = [(index(row + i, col + j), (fy if i else 1 - fy) * (fx if j else 1 - fx)) for i in (0, 1) for j in (0, 1)]
    for p, w in corners:
        for q, v in corners:
            held = np.bincount(p * n * n + q, w * v, n**4).reshape(n * n, n * n)
            for axis in (0, 1):
                normal[axis::2, axis::2] += held
        for axis in (0, 1):
            right[axis::2] += np.bincount(p, w * b[:, axis], n * n)
    solved = np.linalg.lstsq(normal, right, rcond=None)[0].reshape(n, n, 2)
    homographies = np.empty((cells, cells, 3, 3))
    for r in range(cells):
        for c in range(cells):
            src = np.array([(xs[c + j], ys[r + i]) for i in (0, 1) for j in (0, 1)])
            homographies[r, c] = dlt(src, solved[r : r + 2, c : c + 2].reshape(4, 2))
    return solved, homographies


def prewarped(a: np.ndarray, b: np.ndarray, width: float, height: float, cells: int = 8, smooth: float = 1.0, t: float = 0.005, seed: int = 0) -> np.ndarray:
    """Cell homographies of a global RANSAC warp followed by a mesh warp of what it leaves.

    Points with a squared residual of 1000 or more, or out of the frame, take
    no part in the mesh.  Without a global fit every cell is the identity.
    """
    pre, _ = ransac_homography(a, b, t, seed)
    if pre is None:
        return np.broadcast_to(np.eye(3), (cells, cells, 3, 3)).copy()
    moved = apply(pre, a)
    ok = (((moved - b) ** 2).sum(1) < 1000) & (moved > 0).all(1) & (moved[:, 0] < width) & (moved[:, 1] < height)
    if ok.sum() < 4:
        return np.broadcast_to(pre, (cells, cells, 3, 3)).copy()
    _, local = similar_warp(moved[ok], b[ok], width, height, cells, smooth)
    out = local @ pre
    return out / out[..., 2:, 2:]


def fit_meshes(matches: DataFrame, keys: list[str], width: float, height: float, cells: int = 8, smooth: float = 1.0) -> DataFrame:
    """``keys, row, col, h``: the cell homographies of every group of matches."""
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["xa", "ya", "xb", "yb"]).sort_values(["xa", "ya", "xb", "yb"])
        h = prewarped(pdf[["xa", "ya"]].to_numpy(float), pdf[["xb", "yb"]].to_numpy(float), width, height, cells, smooth, seed=group_seed(*map(str, key)))
        return pd.DataFrame([(*key, r + 1, c + 1, h[r, c].ravel().tolist()) for r in range(cells) for c in range(cells)], columns=[*keys, "row", "col", "h"])

    return matches.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row int, col int, h array<double>")


def smooth_paths(paths: DataFrame, affinity: DataFrame, rounds: int, weight: float = 1.0, neighbours: float = 0.0) -> DataFrame:
    """Jacobi rounds over bundled paths ``frame, row, col, c`` (array of 9): each path is
    the average of its original, of the frames that ``affinity`` (``t, r, w``) ties it
    to, and, by ``neighbours``, of the paths of the eight cells around it.

    A round is two equi-joins and an aggregation; rounds are written to the
    shared folder, so the plan does not grow.
    """
    from trackloom.operators.windows import EIGHT
    from trackloom.plans.stages import durable

    at = paths.withColumn("p", F.col("c"))
    flat = lambda df, w: df.select("frame", "row", "col", F.posexplode("p").alias("i", "x"), w.alias("w"))
    for _ in range(rounds):
        source = at.select(F.col("frame").alias("r"), "row", "col", "p")
        band = affinity.join(source, "r").select(F.col("t").alias("frame"), "row", "col", "p", (weight * F.col("w")).alias("w"))
        parts = flat(band, F.col("w")).unionAll(flat(at.withColumn("p", F.col("c")), F.lit(1.0)))
        if neighbours:
            offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in EIGHT))
            around = at.select("frame", F.explode(offsets).alias("o"), "row", "col", "p").select("frame", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "p")
            around = around.join(at.select("frame", "row", "col"), ["frame", "row", "col"], "left_semi")
            parts = parts.unionAll(flat(around, F.lit(float(neighbours))))
        means = parts.groupBy("frame", "row", "col", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
        moved = means.groupBy("frame", "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
        at = durable(paths.join(moved, ["frame", "row", "col"]).select("frame", "row", "col", "c", "p"))
    return at


def thin_plate(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Coefficients (n + 3, 2) of the thin-plate spline that takes ``src`` to ``dst``."""
    n = len(src)
    a = np.zeros((n + 3, n + 3))
    a[:n, :n] = plate_basis(src, src)
    a[:n, n], a[:n, n + 1 :] = 1, src
    a[n:, :n] = a[:n, n:].T
    return np.linalg.solve(a, np.r_[dst, np.zeros((3, 2))])


def plate_basis(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """U = r^2 log r^2, 0 at r = 0."""
    r2 = ((p[:, None] - centres[None]) ** 2).sum(-1)
    return np.where(r2 > 0, r2 * np.log(np.where(r2 > 0, r2, 1)), 0.0)


def plate_warp(p: np.ndarray, centres: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    n = len(centres)
    return plate_basis(p, centres) @ coefficients[:n] + coefficients[n] + p @ coefficients[n + 1 :]


def plate_unwarp(q: np.ndarray, centres: np.ndarray, coefficients: np.ndarray, steps: int = 5) -> np.ndarray:
    """Inverse of a spline warp by Newton steps with numerical derivatives."""
    p, eps = q.astype(float).copy(), 1e-5
    for _ in range(steps):
        gap = plate_warp(p, centres, coefficients) - q
        jx, jy = ((plate_warp(p + d, centres, coefficients) - plate_warp(p - d, centres, coefficients)) / (2 * eps) for d in (np.array([eps, 0]), np.array([0, eps])))
        p = p - np.stack([np.linalg.lstsq(np.stack([jx[i], jy[i]], 1), gap[i], rcond=None)[0] for i in range(len(p))])
    return p


def derivative(f: Callable, x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central finite differences of ``f`` at ``x``: a column for each variable."""
    x = np.asarray(x, float)
    return np.stack([(np.asarray(f(x + d)) - np.asarray(f(x - d))) / (2 * step) for d in np.eye(len(x)) * step], axis=-1)


def second_derivative(f: Callable, x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Finite second differences of a scalar ``f`` at ``x``: the matrix of second derivatives."""
    x = np.asarray(x, float)
    e = np.eye(len(x)) * step
    out = [[(f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * step * step) for b in e] for a in e]
    return np.array(out)


def triplets(*parts: DataFrame) -> DataFrame:
    """``i, j, v``: a sparse matrix from parts of ``i, j, v``, what falls on one place added up."""
    every = parts[0].select("i", "j", "v")
    for p in parts[1:]:
        every = every.unionByName(p.select("i", "j", "v"))
    return every.groupBy("i", "j").agg(F.sum("v").alias("v"))


def stitch_state(clips: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """The state that path optimisation begins with, a row for each frame and cell of every ``keys, frames, width,
    height``: ``frame, row, col``, the cell's ``left, top, quad_width, quad_height``, and identities ``p`` and ``c``."""
    eye = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    at = clips.where("frames > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("frames").cast("int"))).alias("frame"))
    at = at.select("*", F.explode(F.sequence(F.lit(1), F.lit(cells))).alias("row")).select("*", F.explode(F.sequence(F.lit(1), F.lit(cells))).alias("col"))
    wide, high = F.col("width") / cells, F.col("height") / cells
    return at.select(*keys, "frame", "row", "col", ((F.col("col") - 1) * wide).alias("left"), ((F.col("row") - 1) * high).alias("top"), wide.alias("quad_width"), high.alias("quad_height"), eye.alias("p"), eye.alias("c"))
