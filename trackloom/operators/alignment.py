"""Aligning two clips: path updates, control points, offsets, target meshes and scores.

Paths are ``frame, row, col, p, c``: the current and the original homography of a
mesh cell (``array<double>`` of 9, row-major).  Control points are ``frame, k,
xa, ya, xb, yb``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import cell_of, homography_point, inverse3
from trackloom.operators.tracks import robust_filter
from trackloom.operators.windows import EIGHT
from trackloom.plans.stages import durable


def matmul3(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 matrices."""
    return F.array(*(a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)))


def with_motion(paths: DataFrame, before: list[float] | None = None) -> DataFrame:
    """``paths`` with ``__b`` = P C^-1, or ``before`` P C^-1.  The steps are columns of their own,
    so that no product repeats the inverse in each of its terms."""
    out = paths.withColumn("__i", inverse3(F.col("c"))).withColumn("__b", matmul3(F.col("p"), F.col("__i"))).drop("__i")
    if before is None:
        return out
    return out.withColumn("__b", matmul3(F.array(*map(F.lit, map(float, before))), F.col("__b")))


def _added(*parts: DataFrame) -> DataFrame:
    """Element-wise sums by cell of ``frame, row, col, m, w``: the summed matrix and weight."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = every.select("frame", "row", "col", "w", F.posexplode("m").alias("i", "x"))
    cells = flat.groupBy("frame", "row", "col", "i").agg(F.sum("x").alias("x"), F.sum("w").alias("w"))
    return cells.groupBy("frame", "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"), F.max("w").alias("w"))


def coherence(paths: DataFrame, weight: float) -> DataFrame:
    """``frame, row, col, m, w``: for each of the up to eight neighbours n of a cell the matrix
    2 weight P_n C_n^-1 C.  Eight offsets and an equi-join, no theta join."""
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in EIGHT))
    sent = with_motion(paths).select("frame", F.col("__b").alias("b"), F.explode(offsets).alias("o"), "row", "col").select("frame", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "b")
    return sent.join(paths.select("frame", "row", "col", "c"), ["frame", "row", "col"]).withColumn("m", matmul3(F.col("b"), F.col("c"))).select("frame", "row", "col", F.transform("m", lambda x: 2 * weight * x).alias("m"), F.lit(2.0 * weight).alias("w"))


def update_paths(paths: DataFrame, affinity: DataFrame, smoothness: float, weight: float, stitch: DataFrame | None = None, stitchness: float = 1.0, span: int = 0, n_frames: int = 0) -> DataFrame:
    """One Jacobi round: each cell's path becomes the weighted mean of itself (more so near
    the ends, within ``span`` frames of them), of the frames that ``affinity`` (``t, r,
    w``) ties it to, of its neighbours, and of its stitching target ``stitch`` (``frame,
    row, col, s``: the homography to the other clip, applied to C; an optional
    column ``boost`` scales the target's weight)."""
    fixed = F.greatest(F.lit(0), span - F.col("frame") + 1, F.col("frame") - (n_frames - span)) if span else F.lit(0)
    own = paths.select("frame", "row", "col", F.transform("p", lambda x: x * (fixed + 1)).alias("m"), (fixed + 1.0).alias("w"))
    source = paths.select(F.col("frame").alias("r"), "row", "col", "p")
    band = affinity.join(source, "r").select(F.col("t").alias("frame"), "row", "col", F.transform("p", lambda x: 2 * smoothness * F.col("w") * x).alias("m"), (2 * smoothness * F.col("w")).alias("w"))
    parts = [own, band, coherence(paths, weight)]
    if stitch is not None:
        boost = F.col("boost") if "boost" in stitch.columns else F.lit(1.0)
        target = stitch.join(paths.select("frame", "row", "col", "c"), ["frame", "row", "col"]).withColumn("m", matmul3(F.col("s"), F.col("c")))
        parts.append(target.select("frame", "row", "col", F.transform("m", lambda x: x * boost * stitchness).alias("m"), (boost * stitchness).alias("w")))
    moved = _added(*parts).select("frame", "row", "col", F.transform("m", lambda x: x / F.col("w")).alias("p"))
    return paths.drop("p").join(moved, ["frame", "row", "col"]).select(*paths.columns)


def optimise_paths(paths: DataFrame, affinity: DataFrame, rounds: int, **options) -> DataFrame:
    """:func:`update_paths` ``rounds`` times, each round kept in the shared folder."""
    for _ in range(rounds):
        paths = durable(update_paths(paths, affinity, **options))
    return paths


def _through(points: DataFrame, paths: DataFrame, x: str, y: str, width: float, height: float, cells: int, name: str, before: list[float] | None = None) -> DataFrame:
    """``points`` with ``{name}x, {name}y``: (x, y) mapped by its cell's P C^-1, and then by ``before``."""
    row, col = cell_of(F.col(x) - 0.001, F.col(y) - 0.001, width / cells, height / cells, cells)
    maps = with_motion(paths, before).select("frame", F.col("row").alias("__row"), F.col("col").alias("__col"), "__b")
    joined = points.withColumn("__row", row).withColumn("__col", col).join(maps, ["frame", "__row", "__col"])
    u, v = homography_point(F.col(x), F.col(y), F.col("__b"))
    return joined.withColumn(f"{name}x", u).withColumn(f"{name}y", v).drop("__row", "__col", "__b")


def aligned_points(points: DataFrame, paths_a: DataFrame, paths_b: DataFrame, h: list[float], width: float, height: float, cells: int) -> DataFrame:
    """Control points with their places ``ux, uy`` and ``vx, vy`` on the common canvas, and their distance ``d``."""
    both = _through(_through(points, paths_a, "xa", "ya", width, height, cells, "u"), paths_b, "xb", "yb", width, height, cells, "v", h)
    return both.withColumn("d", F.sqrt((F.col("ux") - F.col("vx")) ** 2 + (F.col("uy") - F.col("vy")) ** 2))


def reject_points(aligned: DataFrame, least: int = 20) -> DataFrame:
    """The control points whose distance their frame's trimmed mean allows; frames left with
    fewer than ``least`` lose all.  Points at distance 0 take no part."""
    return robust_filter(aligned.where("d > 0"), ["frame"], "d", "k", least)


def alignment_summary(kept: DataFrame) -> DataFrame:
    """``n_points, error``: points kept, and half the mean of their frames' thresholds less 10."""
    frames = kept.groupBy("frame").agg(F.first("threshold").alias("t"), F.count("*").alias("n"))
    return frames.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"), (F.avg(F.col("t") - 10) / 2).alias("error"))


def points_per_cell(points: DataFrame, x: str, y: str, width: float, height: float, cells: int) -> DataFrame:
    """``frame, row, col, n, ks``: how many control points each cell has, and which."""
    row, col = cell_of(F.col(x) - 0.001, F.col(y) - 0.001, width / cells, height / cells, cells)
    return points.groupBy("frame", row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("ks"))


def mean_offset(paths: DataFrame) -> DataFrame:
    """One row ``offset``: the mean of P C^-1, normalised, over all frames and cells."""
    b = with_motion(paths).select(F.col("__b").alias("b")).select(F.posexplode(F.transform("b", lambda x: x / F.col("b")[8])).alias("i", "x"))
    means = b.groupBy("i").agg(F.avg("x").alias("x"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("offset"))


#: The mesh cell, from the mesh's size, whose map places each corner (x, y as shares of the frame).
CORNER_CELLS = [((0, 0), lambda m: (m, 1)), ((0, 1), lambda m: (1, 1)), ((1, 0), lambda m: (m, m)), ((1, 1), lambda m: (m, 1))]


def aligned_offset(paths_a: DataFrame, paths_b: DataFrame, h: list[float], width: float, height: float, cells: int) -> list[float]:
    """The common offset of two clips: the mean of P C^-1 of the first, set so that in the middle frame
    the mean of both clips' corners falls on the first's.  Four cells of each clip reach the driver."""
    import numpy as np

    from trackloom.operators.geometry import apply, dlt

    offset = np.array(mean_offset(paths_a).first()["offset"]).reshape(3, 3)
    middle = max(1, (paths_a.agg(F.max("frame")).first()[0] or 1) // 2)
    places = []
    for paths, before in ((paths_a, np.eye(3)), (paths_b, np.array(h, float).reshape(3, 3))):
        asked = with_motion(paths.where(F.col("frame") == middle).where(F.struct("row", "col").isin(*(F.struct(F.lit(r), F.lit(c)) for r, c in {cell(cells) for _, cell in CORNER_CELLS})))).select("row", "col", "__b").collect()
        maps = {(r["row"], r["col"]): np.linalg.inv(offset) @ before @ np.array(r["__b"]).reshape(3, 3) for r in asked}
        corner = lambda at: np.array([[1 + at[0] * (width - 1), 1 + at[1] * (height - 1)]])
        places.append(np.concatenate([apply(maps[cell(cells)], corner(at)) for at, cell in CORNER_CELLS]))
    a, b = places
    return (dlt((a + b) / 2, a) @ np.linalg.inv(offset)).ravel().tolist()


def stitched_points(points: DataFrame, valid: DataFrame, paths_a: DataFrame, paths_b: DataFrame, h: list[float], offset: list[float], width: float, height: float, cells: int, gap: float, head: int, tail: int) -> DataFrame:
    """``frame, k, ax, ay, bx, by`` for frames from head to tail: valid points on the padded
    canvas, -1 for the others (``valid`` has the frames and ks that are)."""
    asked = points.where(F.col("frame").between(head, tail))
    good = asked.join(valid.select("frame", "k"), ["frame", "k"], "left_semi")
    across = [sum(offset[3 * r + k] * h[3 * k + c] for k in range(3)) for r in range(3) for c in range(3)]
    mapped = _through(_through(good, paths_a, "xa", "ya", width, height, cells, "u", offset), paths_b, "xb", "yb", width, height, cells, "v", across)
    found = mapped.select("frame", "k", *((F.col(c) + gap).alias(n) for c, n in (("ux", "ax"), ("uy", "ay"), ("vx", "bx"), ("vy", "by"))))
    return asked.select("frame", "k").join(found, ["frame", "k"], "left").na.fill(-1.0, ["ax", "ay", "bx", "by"])


def closest_pair_mean(points: Column) -> Column:
    """The mean of the two closest of a few points (array of ``struct<x, y>``; ties to the first pair)."""
    n = F.size(points)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(F.sequence(F.lit(1), n), lambda j: j > i), lambda j: F.struct(((F.element_at(points, i)["x"] - F.element_at(points, j)["x"]) ** 2 + (F.element_at(points, i)["y"] - F.element_at(points, j)["y"]) ** 2).alias("d"), j.alias("j"), i.alias("i")))))
    best = F.array_min(pairs)
    a, b = F.element_at(points, best["i"]), F.element_at(points, best["j"])
    return F.when(n == 1, F.element_at(points, 1)).otherwise(F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))


def target_mesh(paths: DataFrame, width: float, height: float, cells: int, before: list[float] | None = None) -> DataFrame:
    """``frame, i, j, x, y``: where each mesh vertex goes.  A corner follows its one cell, an edge
    vertex the mean of its two cells, an inner vertex the closest pair of its four."""
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a in (0, 1) for c in (0, 1)))
    votes = with_motion(paths, before).select("frame", "row", "col", F.col("__b").alias("b"), F.explode(corners).alias("o")).select("frame", (F.col("row") - 1 + F.col("o.a")).alias("i"), (F.col("col") - 1 + F.col("o.c")).alias("j"), "row", "col", "b")
    x, y = homography_point(F.col("j") * (width / cells) + 1, F.col("i") * (height / cells) + 1, F.col("b"))
    placed = votes.groupBy("frame", "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", x.alias("x"), y.alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("q"))
    return placed.withColumn("m", closest_pair_mean(F.col("q"))).select("frame", "i", "j", "m.x", "m.y")


def mask_lookup(points: DataFrame, masks: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """``points`` with the value of ``masks`` (``frame, y, x, m``) at their rounded place; null outside."""
    m = masks.select("frame", F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("m").alias(name))
    return points.withColumn("__y", F.round(y).cast("int")).withColumn("__x", F.round(x).cast("int")).join(m, ["frame", "__y", "__x"], "left").drop("__y", "__x")


def refine_points(points: DataFrame, masks_a: DataFrame, masks_b: DataFrame, least: float = 0.5) -> DataFrame:
    """Control points that lie in the background of both clips."""
    both = mask_lookup(mask_lookup(points, masks_a, "xa", "ya", "__ma"), masks_b, "xb", "yb", "__mb")
    return both.where((F.col("__ma") > least) & (F.col("__mb") > least)).drop("__ma", "__mb")


def overlap_score(matches: DataFrame, overlap: DataFrame) -> DataFrame:
    """``score, frames``: the mean distance of matched features within the seam's overlap (pixels
    ``frame, y, x``) for each frame, averaged over the frames that have any."""
    inside = overlap.select("frame", "y", "x").withColumn("m", F.lit(1))
    seen = mask_lookup(mask_lookup(matches, inside, "xa", "ya", "__ma"), inside, "xb", "yb", "__mb").where("__ma = 1 AND __mb = 1")
    frames = seen.groupBy("frame").agg(F.avg(F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)).alias("d"))
    return frames.agg(F.avg("d").alias("score"), F.count("*").alias("frames"))


def flip_patterns(hist: Column) -> Column:
    """A histogram of the 58 uniform 8-neighbour patterns of the mirrored image.

    Pattern 7 i + j (from 1) is the run of j set bits from direction i; a mirror
    keeps its length and swaps its ends.
    """
    order = [0] * 58
    order[56], order[57] = 57, 58
    for i in range(8):
        for j in range(1, 8):
            order[7 * i + j - 1] = 7 * ((5 - i - j) % 8) + j
    return F.array(*(F.element_at(hist, k) for k in order))


def override(base: dict, update: dict, skip: bool = False, ignore_case: bool = False, strict: bool = False) -> dict:
    """``base`` with the values of ``update``, at the deepest level.  Unknown names are added,
    skipped, or an error if ``strict``."""
    out = dict(base)
    names = {k.lower(): k for k in base} if ignore_case else {k: k for k in base}
    for key, value in update.items():
        known = names.get(key.lower() if ignore_case else key)
        if known is None:
            if strict:
                raise KeyError(key)
            if not skip:
                out[key] = value
        elif isinstance(out[known], dict) and isinstance(value, dict):
            out[known] = override(out[known], value, skip, ignore_case, strict)
        else:
            out[known] = value
    return out
