"""Queries of clip alignment, masks, grouped fits, cuts and rasters."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import alignment as A
from trackloom.operators import coding as L
from trackloom.operators import flow as Q
from trackloom.operators import geometry as H
from trackloom.operators import images as I
from trackloom.operators import tracks as T
from trackloom.operators import windows as N
from trackloom.plans.stages import forget_at_exit, shared_folder, stage
from trackloom.plans.tables import GRID_SQL, TRACKS_SQL, day_grid, table, user_tracks
from trackloom.sources import frames as IO

#: Cells of the stand-in mesh, and the size of the stand-in frame.
CELLS, WIDTH, HEIGHT = 4, 500.0, 720.0
ACROSS = [1.0, 0.0, 2.5, 0.0, 1.0, -1.5, 0.0, 0.0, 1.0]
OFFSET = [1.0, 0.0, 10.0, 0.0, 1.0, 20.0, 0.0, 0.0, 1.0]


def _shift(x, y):
    """A translation as a matrix."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, zero, x, zero, one, y, zero, zero, one)


def _paths(spark, sf_dir):
    """Translations of a mesh of 4 x 4 cells over the days: ``frame, row, col, p, c``."""
    g = day_grid(spark, sf_dir).where("y < 16")
    at = g.select(F.col("x").alias("frame"), (F.floor(F.col("y") / 4) + 1).cast("int").alias("row"), (F.col("y") % 4 + 1).cast("int").alias("col"), "v")
    return at.select("frame", "row", "col", _shift((F.col("v") % 1000) / 10.0, (F.col("v") % 777) / 7.0).alias("p"), _shift((F.col("v") % 97) / 10.0, (F.col("v") % 55) / 10.0).alias("c"))


def _points(spark, sf_dir):
    """Control points ``frame, k, xa, ya, xb, yb`` on the days."""
    t = user_tracks(spark, sf_dir).where("frame <= 720")
    day = F.floor((F.col("frame") - 1) / 24).cast("int") + 1
    return t.select(day.alias("frame"), (F.col("track_id") * 24 + F.col("frame") % 24).alias("k"), ((F.col("x") % 50000) / 100.0 + 0.25).alias("xa"), (F.col("frame") - 0.75).alias("ya"), ((F.col("x") % 49000) / 98.0 + 0.25).alias("xb"), (F.col("frame") - 0.5).alias("yb"))


_PATHS_SQL = f"{GRID_SQL}, p AS (SELECT x AS frame, (y // 4 + 1)::INT AS row, (y % 4 + 1)::INT AS col, (v % 1000) / 10.0 AS px, (v % 777) / 7.0 AS py, (v % 97) / 10.0 AS cx, (v % 55) / 10.0 AS cy FROM g WHERE y < 16)"
_POINTS_SQL = f"{TRACKS_SQL}, c AS (SELECT ((frame - 1) // 24)::INT + 1 AS frame, track_id * 24 + frame % 24 AS k, (x % 50000) / 100.0 + 0.25::DOUBLE AS xa, frame - 0.75::DOUBLE AS ya, (x % 49000) / 98.0 + 0.25::DOUBLE AS xb, frame - 0.5::DOUBLE AS yb FROM t WHERE frame <= 720)"


def point_cells(spark, sf_dir):
    """Mesh cells of points by each of the four conventions at cell edges."""
    t = user_tracks(spark, sf_dir)
    cells = [S.cell_of(F.col("x"), F.col("frame"), 6250.0, 90.0, 8, eps, up) for eps, up in S.CELL_CONVENTIONS]
    return t.select(*(c.alias(f"{n}{i}") for i, pair in enumerate(cells) for n, c in zip(("row", "col"), pair, strict=True))).groupBy(*(f"{n}{i}" for i in range(4) for n in ("row", "col"))).agg(F.count("*").alias("n"))


def points_per_cell(spark, sf_dir):
    return A.points_per_cell(_points(spark, sf_dir), "xa", "ya", WIDTH, HEIGHT, CELLS).select("frame", "row", "col", "n", F.array_join("ks", ",").alias("ks"))


def quad_smoothness(spark, sf_dir):
    return H.quad_smoothness(_points(spark, sf_dir), "xa", "ya", WIDTH, HEIGHT, CELLS, 1.5).select("row", "col", "n", F.round("weight", 6).alias("weight"))


def frame_edges(spark, sf_dir):
    """Points in the frame by each convention at its edges."""
    p = _points(spark, sf_dir).select("frame", F.floor("xa").alias("x"), F.floor("ya").alias("y"))
    flags = [T.in_frame(F.col("x"), F.col("y"), 400.0, 700.0, low, high, closed) for low, high, closed in ((0.0, 0.0, True), (0.5, 0.5, False), (0.5, 0.5, True), (0.0, 0.0, False))]
    return p.groupBy(*(f.alias(f"f{i}") for i, f in enumerate(flags))).agg(F.count("*").alias("n"))


def residuals_kept(spark, sf_dir):
    return H.residual_filter(_points(spark, sf_dir), 400.0, 700.0, 100.0).select("frame", "k")


def track_ages(spark, sf_dir):
    """Tracks that retire at 100 frames."""
    return T.lifespans(user_tracks(spark, sf_dir), max_age=100)


def label_affinity(spark, sf_dir):
    t = user_tracks(spark, sf_dir).select(F.floor(F.col("frame") / 120).cast("int").alias("window"), "frame", (F.col("track_id") % 5).alias("k"), F.when(F.col("track_id") % 2 == 0, "a").otherwise("b").alias("side"), (F.col("track_id") % 3).alias("label"), (F.col("x") / 50000.0).alias("m"))
    points = t.select("window", "frame", "k").distinct()
    return T.label_affinity(points, t, 40, 0.3).select("window", "u", "v", F.round("w", 8).alias("w"))


def misclassification(spark, sf_dir):
    """Labels by quality and by toxicity under the best renaming."""
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return L.compare_labels(rows, "quality", "toxic").select("n", F.round("error", 9).alias("error"))


def _masks(spark):
    """Soft masks on a small raster of every day: ``frame, y, x, m``."""
    rows = spark.range(31 * 25 * 25).select((F.floor(F.col("id") / 625) + 1).cast("int").alias("frame"), (F.floor(F.col("id") / 25) % 25).cast("int").alias("y"), (F.col("id") % 25).cast("int").alias("x"))
    return rows.select("frame", "y", "x", (((F.col("frame") + F.col("x") * 2 + F.col("y")) % 4) / 3.0).alias("m"))


_MASKS_SQL = "m AS (SELECT (i // 625 + 1)::INT AS frame, ((i // 25) % 25)::INT AS y, (i % 25)::INT AS x, (((i // 625 + 1) + (i % 25) * 2 + (i // 25) % 25) % 4) / 3.0 AS m FROM range(19375) r(i))"


def _small_points(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("frame", "k", *((F.floor(F.col(c)) % 30 + 0.25).alias(c) for c in ("xa", "ya", "xb", "yb")))


_SMALL_SQL = f"{_POINTS_SQL}, s AS (SELECT frame, k, " + ", ".join(f"floor({c}) % 30 + 0.25::DOUBLE AS {c}" for c in ("xa", "ya", "xb", "yb")) + " FROM c)"


def mask_lookup(spark, sf_dir):
    return A.mask_lookup(_small_points(spark, sf_dir), _masks(spark), "xa", "ya", "m").select("frame", "k", F.round("m", 6).alias("m"))


def refined_points(spark, sf_dir):
    m = _masks(spark)
    return A.refine_points(_small_points(spark, sf_dir), m, m.withColumn("m", 1 - F.col("m"))).select("frame", "k")


def overlap_score(spark, sf_dir):
    return A.overlap_score(_small_points(spark, sf_dir), _masks(spark).where("m > 0.5")).select(F.round("score", 6).alias("score"), "frames")


def alignment_summary(spark, sf_dir):
    kept = A.reject_points(_points(spark, sf_dir).select("frame", "k", (F.abs(F.col("xa") - F.col("xb")) + 1).alias("d")), 3)
    return A.alignment_summary(kept).select("n_points", F.round("error", 6).alias("error"))


def coherence_terms(spark, sf_dir):
    terms = A.coherence(_paths(spark, sf_dir), 0.75)
    return terms.select("frame", "row", "col", *((F.round(F.col("m")[i], 6) + 0.0).alias(f"m{i}") for i in (0, 2, 5, 8)), "w")


def _affinity(spark):
    """Days within two of each other."""
    a = spark.range(1, 32).select(F.col("id").cast("int").alias("t"), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("o"))
    return a.select("t", (F.col("t") + F.col("o")).alias("r"), (1 / (1.0 + F.abs("o"))).alias("w")).where("r BETWEEN 1 AND 31")


def path_round(spark, sf_dir):
    """One round of path optimisation."""
    moved = A.update_paths(_paths(spark, sf_dir), _affinity(spark), 1.25, 0.5)
    return moved.select("frame", "row", "col", F.round(F.col("p")[2], 6).alias("x"), F.round(F.col("p")[5], 6).alias("y"), F.round(F.col("p")[8], 6).alias("one"))


def aligned_points(spark, sf_dir):
    p = _paths(spark, sf_dir)
    out = A.aligned_points(_points(spark, sf_dir), p, p, ACROSS, WIDTH, HEIGHT, CELLS)
    return out.select("frame", "k", *(F.round(c, 6).alias(c) for c in ("ux", "uy", "vx", "vy", "d")))


def stitched_points(spark, sf_dir):
    p, points = _paths(spark, sf_dir), _points(spark, sf_dir)
    out = A.stitched_points(points, points.where("k % 3 > 0"), p, p, ACROSS, OFFSET, WIDTH, HEIGHT, CELLS, 100.0, 3, 20)
    return out.select("frame", "k", *(F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by")))


def mean_offset(spark, sf_dir):
    o = F.col("offset")
    return A.mean_offset(_paths(spark, sf_dir)).select(F.round(o[2], 6).alias("x"), F.round(o[5], 6).alias("y"), F.round(o[0], 6).alias("a"), F.round(o[8], 6).alias("one"))


def target_mesh(spark, sf_dir):
    return A.target_mesh(_paths(spark, sf_dir), WIDTH, HEIGHT, CELLS).select("frame", "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def closest_pairs(spark, sf_dir):
    """The mean of the closest two of four points of every order."""
    place = lambda i: F.struct((F.col("o_totalprice") * (i + 1) % 101).alias("x"), ((F.col("o_custkey") * (2 * i + 1)) % 89 + 0.0).alias("y"))
    m = A.closest_pair_mean(F.array(*map(place, range(4))))
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.round("m.x", 5).alias("x"), F.round("m.y", 5).alias("y"))


def running_products(spark, sf_dir):
    """Products of the steps' translations, each a matrix that wants dividing by its last element."""
    t = user_tracks(spark, sf_dir)
    h = F.transform(_shift(F.col("x") / 1000.0, F.col("y") + 0.5), lambda x: x * (F.col("frame") % 3 + 1))
    out = N.path_product(t.select("track_id", "frame", h.alias("h")), ["track_id"], "frame", "h")
    return out.select("track_id", "frame", *(F.round(F.col("path")[i], 5).alias(f"p{i}") for i in (0, 2, 5, 8)))


def coding_plane(spark, sf_dir):
    """Coding length of each user's points in the plane."""
    t = user_tracks(spark, sf_dir).select("track_id", F.array(F.col("x") / 10000.0, F.col("y").cast("double")).alias("v"))
    return L.grouped_lengths(t, "track_id", "v", 0.5).select("track_id", "m", F.round("bits", 5).alias("bits"))


def coding_total(spark, sf_dir):
    """The whole segmentation's coding length."""
    t = user_tracks(spark, sf_dir).select((F.col("track_id") % 7).alias("label"), F.array(F.col("x") / 10000.0, F.col("y").cast("double")).alias("v"))
    return L.grouped_lengths(t, "label", "v", 0.5).agg(F.sum("m").alias("m"), F.round(F.sum("bits"), 4).alias("bits"))


def edge_ranks(spark, sf_dir):
    """Rank weights of single trajectories: a matrix of one column has rank 1."""
    t = user_tracks(spark, sf_dir).where("x > 0").select((F.col("frame") % 10).cast("int").alias("window"), F.col("track_id").cast("int").alias("u"), (F.col("track_id") % 3).cast("int").alias("v"), "track_id", "frame", F.col("x").cast("double"), F.col("y").cast("double"))
    return L.edge_ranks(t, 0.25).select("window", "u", "v", "n", F.round("w", 9).alias("w"))


PLANTED = [1.02, 0.03, 4.0, -0.02, 0.97, -3.0, 0.00002, 0.00001, 1.0]


def _planted(spark, sf_dir, h=PLANTED):
    """Matches that follow a planted map, one in eight of them not."""
    p = _points(spark, sf_dir).select("frame", "k", "xa", (F.col("ya") * 3 % 700).alias("ya"))
    x, y = S.homography_point(F.col("xa"), F.col("ya"), F.array(*map(F.lit, h)))
    off = F.when(F.col("k") % 8 == 0, (F.col("k") * 37) % 211 + 60.0).otherwise(0.0)
    return p.select("frame", "xa", "ya", (x + off).alias("xb"), (y - off).alias("yb"), (F.floor(F.col("xa") / 50) * 100 + F.floor(F.col("ya") / 70)).cast("int").alias("cell"))


def planted_homographies(spark, sf_dir):
    fit = H.fit_homographies(_planted(spark, sf_dir), ["frame"], 1e-6)
    return fit.select("frame", "n", "inliers", *(F.round(F.col("h")[i], 4).alias(f"h{i}") for i in range(9)))


def planted_homographies_cells(spark, sf_dir):
    fit = H.fit_homographies(_planted(spark, sf_dir), ["frame"], 1e-6, cells="cell")
    return fit.select("frame", "n", "inliers", *(F.round(F.col("h")[i], 4).alias(f"h{i}") for i in range(9)))


AFFINE = [1.01, 0.02, 3.0, -0.01, 0.98, 2.0, 0.0, 0.0, 1.0]


def planted_meshes(spark, sf_dir):
    """Mesh warps over matches that follow one affine map: every cell has it."""
    m = _planted(spark, sf_dir, AFFINE)
    clean = m.where(F.abs(F.col("xb") - (1.01 * F.col("xa") + 0.02 * F.col("ya") + 3)) < 1)
    fit = H.fit_meshes(clean, ["frame"], WIDTH, HEIGHT, 4)
    return fit.select("frame", "row", "col", *(F.round(F.col("h")[i], 3).alias(f"h{i}") for i in range(9)))


def max_flows(spark, sf_dir):
    """Maximum flows between kinds of events of every day."""
    ev = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("day"), (F.col("user_id") % 5).alias("src"), (F.hour("ts") % 5).cast("long").alias("dst"))
    edges = ev.where("src != dst").groupBy("day", "src", "dst").agg(F.count("*").cast("double").alias("cap")).withColumn("rev_cap", F.lit(0.0))
    ends = ev.groupBy("day", F.col("src").alias("node")).agg(F.count("*").alias("n")).select("day", "node", (F.when(F.col("node") < 2, F.col("n")).otherwise(0) * 2.0).alias("source"), (F.when(F.col("node") > 2, F.col("n")).otherwise(0) * 1.5).alias("sink"))
    cuts = Q.minimum_cuts(edges, ends, ["day"])
    return cuts.groupBy("day").agg(F.round(F.max("flow"), 6).alias("flow"))


def soft_masks(spark, sf_dir):
    """Share of good points around asked places."""
    p = _points(spark, sf_dir).select("frame", F.col("xa").alias("x"), F.col("ya").alias("y"), (F.col("k") % 3 == 0).alias("good"))
    at = p.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("frame", (F.col("i") * 20).alias("y"), (F.col("i") * 45).alias("x"))
    return I.soft_mask(p, at, 50.0).select("frame", "y", "x", F.round("m", 6).alias("m"))


def cross_fades(spark, sf_dir):
    g = day_grid(spark, sf_dir).select("y", "x", F.col("v").cast("double").alias("v"))
    return I.cross_fade(g, g.withColumn("v", F.col("v") * 0.5), 0.4, 15.0).select("y", "x", F.round("v", 5).alias("v"))


def mosaics(spark, sf_dir):
    """Every hour of the day as an image of one row, tiled five in a row."""
    g = day_grid(spark, sf_dir).select(F.col("y").alias("image"), F.floor((F.col("x") - 1) / 8).cast("int").alias("y"), ((F.col("x") - 1) % 8).cast("int").alias("x"), "v")
    return I.mosaic(g, "image", 5, 4, 8, 1).select("y", "x", "v")


def dark_dropped(spark, sf_dir):
    """Points outside the dark parts of an image."""
    g = day_grid(spark, sf_dir).select("y", "x", *((F.col("v") % m).cast("int").alias(c) for c, m in (("r", 60), ("g", 50), ("b", 40))))
    points = spark.range(24 * 31).select((F.floor(F.col("id") / 31) + 0.25).alias("y"), (F.col("id") % 31 + 1.25).alias("x"))
    return I.drop_dark(points, g, 0.5, 0.2).select("y", "x")


def gray_image(spark, sf_dir):
    """An image written as a bitmap file and read as gray."""
    rows = day_grid(spark, sf_dir).select("y", (F.col("x") - 1).alias("x"), "v").orderBy("y", "x").collect()
    px = [[(r["v"] % 256, r["v"] // 3 % 256, r["v"] // 7 % 256) for r in rows[31 * y : 31 * y + 31]] for y in range(24)]
    out = f"{shared_folder(spark)}/trackloom-stages/gray-{uuid.uuid4().hex}"
    frames = spark.createDataFrame([(1, IO.bitmap(px))], "frame_idx long, content binary")
    IO.write_frames(frames, out, "%03d.bmp").count()
    forget_at_exit(spark, out)
    return IO.read_gray(spark, out).select("y", "x", F.round("v", 6).alias("v"))


def frames_zipped(spark, sf_dir):
    """Two clips written as files, read by number and zipped."""
    out = f"{shared_folder(spark)}/trackloom-stages/frames-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("frame_idx"), F.col("html").cast("binary").alias("content"))
    IO.write_frames(rows, f"{out}/a", "%04d.jpg").count()
    IO.write_frames(rows.where("frame_idx % 3 > 0").withColumn("content", F.reverse(F.hex("content")).cast("binary")), f"{out}/b").count()
    forget_at_exit(spark, out)
    both = IO.zip_frames(IO.read_frames(spark, f"{out}/a"), IO.read_frames(spark, f"{out}/b"))
    return both.select(F.col("frame_idx").cast("long").alias("frame_idx"), F.md5("content_a").alias("a"), F.octet_length("content_b").cast("long").alias("n"))


def keypoints(spark, sf_dir):
    """Keypoint text files of both formats, one for each nation's next thousand suppliers, written and read."""
    out = f"{shared_folder(spark)}/trackloom-stages/keys-{uuid.uuid4().hex}"
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    bins = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: key * i % 19), " ")
    lines = {"ubc": F.concat_ws(" ", F.concat(key, F.lit(".5")), nation, F.lit("2.25 0.5"), bins), "oxford": F.concat_ws(" ", key, nation, F.lit("0.5 0.25"), key, F.lit("7 8"), nation)}
    read = []
    for form, line in lines.items():
        file = (F.floor(key / 1000) * 100 + nation).alias("frame_idx")
        held = table(spark, sf_dir, "supplier").groupBy(file).agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), line.alias("line")))).alias("p"))
        head = F.concat(F.size("p"), F.lit(" 16")) if form == "ubc" else F.concat(F.lit("3 "), F.size("p"))
        IO.write_frames(held.select("frame_idx", F.concat_ws("\n", head, F.transform("p", lambda x: x["line"])).cast("binary").alias("content")), f"{out}/{form}", "%d.txt").count()
        found = IO.read_keypoints(spark, f"{out}/{form}", form)
        read.append(found.select(F.lit(form).alias("form"), F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long").alias("file"), F.col("k").cast("int").alias("k"), F.array_join("descriptor", ",").alias("descriptor"), *(F.round(F.col("frame")[i], 6).alias(f"f{i}") for i in range(4))))
    forget_at_exit(spark, out)
    return read[0].unionByName(read[1])


def synthetic_images(spark, sf_dir):
    """Every synthetic image in a size of its own for every supplier."""
    sizes = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5 + 8).alias("height"), (F.col("s_suppkey") % 7 + 10).cast("int").alias("width"))
    return IO.patterns(sizes, ["s_suppkey"], ["step", "ramp", "checker", "disc", "stripes"]).select("s_suppkey", "kind", "y", "x", F.round("v", 6).alias("v"))


def stage_cached(spark, sf_dir):
    """A stage made once and then read: the second request finds the first's files."""
    folder = f"{shared_folder(spark)}/trackloom-stages/cache-{uuid.uuid4().hex}"
    made = []

    def make():
        made.append(1)
        return user_tracks(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n"))

    stage(spark, folder, "counts", {"size": 1}, make)
    out = stage(spark, folder, "counts", {"size": 1}, make)
    forget_at_exit(spark, folder)
    return out.withColumn("made", F.lit(len(made)))


QUERIES = {
    "point_cells": point_cells, "points_per_cell": points_per_cell, "quad_smoothness": quad_smoothness, "frame_edges": frame_edges, "residuals_kept": residuals_kept, "track_ages": track_ages,
    "label_affinity": label_affinity, "misclassification": misclassification, "mask_lookup": mask_lookup, "refined_points": refined_points, "overlap_score": overlap_score,
    "alignment_summary": alignment_summary, "coherence_terms": coherence_terms, "path_round": path_round, "aligned_points": aligned_points, "stitched_points": stitched_points, "mean_offset": mean_offset,
    "target_mesh": target_mesh, "closest_pairs": closest_pairs, "running_products": running_products, "coding_plane": coding_plane, "coding_total": coding_total, "edge_ranks": edge_ranks,
    "planted_homographies": planted_homographies, "planted_homographies_cells": planted_homographies_cells, "planted_meshes": planted_meshes, "max_flows": max_flows, "soft_masks": soft_masks,
    "cross_fades": cross_fades, "mosaics": mosaics, "dark_dropped": dark_dropped, "gray_image": gray_image, "frames_zipped": frames_zipped, "keypoints": keypoints, "synthetic_images": synthetic_images,
    "stage_cached": stage_cached,
}


def _sql_cell(v: str, size: float, cells: int, eps: float = 0.0, up: bool = False) -> str:
    at = f"ceil(({v}) / {size})" if up else f"floor(({v} - {eps}) / {size}) + 1"
    return f"least(greatest({at}, 1), {cells})::INT"


_ROW, _COL = (lambda y: _sql_cell(y, HEIGHT / CELLS, CELLS, 0.001)), (lambda x: _sql_cell(x, WIDTH / CELLS, CELLS, 0.001))
_EDGES = [(0.0, 0.0, True), (0.5, 0.5, False), (0.5, 0.5, True), (0.0, 0.0, False)]
_BITS = "(m + 2) / 2.0 * log2((1 + 2 / (0.25::DOUBLE * m) * xx) * (1 + 2 / (0.25::DOUBLE * m) * yy) - (2 / (0.25::DOUBLE * m) * xy) ** 2) - m * log2(m / total)"
_PLANE = "sum((x / 10000.0) ** 2) AS xx, sum(y::DOUBLE * y) AS yy, sum(x / 10000.0 * y) AS xy, count(*) AS m, (SELECT count(*) FROM t)::DOUBLE AS total"
_HALF = 2


def _sql_blurred() -> str:
    """The dark mask blurred by a Gaussian of 0.5 with edges repeated, at every pixel."""
    w = I.gaussian_weights(0.5)
    half = len(w) // 2
    taps = ", ".join(f"({i - half}, {v!r}::DOUBLE)" for i, v in enumerate(w))
    return f"""w(o, wt) AS (VALUES {taps}),
        k AS (SELECT y, x, (v % 60 < 20 AND v % 50 < 20 AND v % 40 < 20)::INT::DOUBLE AS m FROM g),
        kx AS (SELECT a.y, a.x, sum(wt * b.m) AS m FROM k a CROSS JOIN w JOIN k b ON b.y = a.y AND b.x = greatest(1, least(31, a.x + o)) GROUP BY 1, 2),
        ky AS (SELECT a.y, a.x, sum(wt * b.m) AS m FROM kx a CROSS JOIN w JOIN kx b ON b.x = a.x AND b.y = greatest(0, least(23, a.y + o)) GROUP BY 1, 2)"""


def _sql_literals(h: list[float], digits: int) -> str:
    return ", ".join(f"round({v!r}::DOUBLE, {digits}) AS h{i}" for i, v in enumerate(h))


_PLANTED_SQL = f"WITH {_POINTS_SQL} SELECT frame, count(*) AS n, count(*) FILTER (k % 8 <> 0) AS inliers, {_sql_literals(PLANTED, 4)} FROM c GROUP BY 1"
_FLOW_SQL = f"""
    WITH ev AS (SELECT day(ts) AS day, user_id % 5 AS src, hour(ts) % 5 AS dst FROM events), e AS (SELECT day, src, dst, count(*)::DOUBLE AS cap FROM ev WHERE src <> dst GROUP BY 1, 2, 3),
    n AS (SELECT day, src AS node, count(*) AS n FROM ev GROUP BY 1, 2), s AS (SELECT s FROM range(32) r(s)),
    cut AS (
        SELECT day, s, cap AS c FROM e, s WHERE (s >> src) & 1 = 1 AND (s >> dst) & 1 = 0
        UNION ALL SELECT day, s, n * 2.0 FROM n, s WHERE node < 2 AND (s >> node) & 1 = 0
        UNION ALL SELECT day, s, n * 1.5 FROM n, s WHERE node > 2 AND (s >> node) & 1 = 1
        UNION ALL SELECT day, s, 0 FROM (SELECT DISTINCT day FROM ev), s),
    total AS (SELECT day, s, sum(c)::DOUBLE AS c FROM cut GROUP BY 1, 2)
    SELECT day, round(min(c), 6) AS flow FROM total GROUP BY 1"""
_PAIRS = list(itertools.combinations(range(4), 2))
_UBC_BINS = "list_transform(range(0, 16), lambda i: (s_suppkey * (i - i % 8 + (8 - i % 8) % 8)) % 19)"

ORACLE_SQL = {
    "point_cells": f"WITH {TRACKS_SQL} SELECT " + ", ".join(f"{_sql_cell('frame', 90.0, 8, eps, up)} AS row{i}, {_sql_cell('x', 6250.0, 8, eps, up)} AS col{i}" for i, (eps, up) in enumerate(S.CELL_CONVENTIONS)) + ", count(*) AS n FROM t GROUP BY ALL",
    "points_per_cell": f"WITH {_POINTS_SQL} SELECT frame, {_ROW('ya')} AS row, {_COL('xa')} AS col, count(*) AS n, string_agg(k::BIGINT, ',' ORDER BY k) AS ks FROM c GROUP BY 1, 2, 3",
    "quad_smoothness": f"""
        WITH {_POINTS_SQL}, n AS (SELECT {_ROW('ya')} AS row, {_COL('xa')} AS col, count(*) AS n FROM c GROUP BY 1, 2), z AS (SELECT (a.i + 1)::INT AS row, (b.i + 1)::INT AS col FROM range(4) a(i), range(4) b(i))
        SELECT z.row, z.col, coalesce(n, 0)::BIGINT AS n, round(1.5::DOUBLE * CASE WHEN coalesce(n, 0) = 0 THEN 5 ELSE least(5, greatest(0.2::DOUBLE, (SELECT count(*) FROM c) / 16.0 / n)) END, 6) AS weight FROM z LEFT JOIN n ON n.row = z.row AND n.col = z.col""",
    "frame_edges": f"WITH {_POINTS_SQL}, q AS (SELECT floor(xa) AS x, floor(ya) AS y FROM c) SELECT "
    + ", ".join(f"x > {low} AND y > {low} AND x {'<=' if closed else '<'} {400 - high} AND y {'<=' if closed else '<'} {700 - high} AS f{i}" for i, (low, high, closed) in enumerate(_EDGES)) + ", count(*) AS n FROM q GROUP BY ALL",
    "residuals_kept": f"WITH {_POINTS_SQL} SELECT frame, k FROM c WHERE (xa - xb) ** 2 + (ya - yb) ** 2 < 100 AND xa > 0 AND ya > 0 AND xa < 400 AND ya < 700",
    "track_ages": f"WITH {TRACKS_SQL} SELECT track_id, min(frame) AS head, least(max(frame), min(frame) + 99) AS tail, least(max(frame), min(frame) + 99) - min(frame) + 1 AS len FROM t GROUP BY 1",
    "label_affinity": f"""
        WITH {TRACKS_SQL}, q AS (SELECT (frame // 120)::INT AS window_, frame, track_id % 5 AS k, track_id % 2 AS side, track_id % 3 AS label, x / 50000.0 AS m FROM t)
        SELECT a.window_ AS "window", a.label AS u, b.label AS v, round(exp(-0.3::DOUBLE * sum(a.m * b.m) / 40), 8) AS w FROM q a JOIN q b ON a.side = 0 AND b.side = 1 AND a.frame = b.frame AND a.k = b.k GROUP BY 1, 2, 3""",
    "misclassification": "SELECT count(*) AS n, round(1 - greatest(count(*) FILTER (quality = toxic), count(*) FILTER (quality <> toxic)) / count(*), 9) AS error FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "mask_lookup": f"WITH {_SMALL_SQL}, {_MASKS_SQL} SELECT s.frame, k, round(m.m, 6) AS m FROM s LEFT JOIN m ON m.frame = s.frame AND m.y = round(ya) AND m.x = round(xa)",
    "refined_points": f"WITH {_SMALL_SQL}, {_MASKS_SQL} SELECT s.frame, k FROM s JOIN m a ON a.frame = s.frame AND a.y = round(ya) AND a.x = round(xa) AND a.m > 0.5 JOIN m b ON b.frame = s.frame AND b.y = round(yb) AND b.x = round(xb) AND 1 - b.m > 0.5",
    "overlap_score": f"""
        WITH {_SMALL_SQL}, {_MASKS_SQL}, f AS (SELECT s.frame, avg(sqrt((xa - xb) ** 2 + (ya - yb) ** 2)) AS d FROM s JOIN m a ON a.frame = s.frame AND a.y = round(ya) AND a.x = round(xa) AND a.m > 0.5 JOIN m b ON b.frame = s.frame AND b.y = round(yb) AND b.x = round(xb) AND b.m > 0.5 GROUP BY 1)
        SELECT round(avg(d), 6) AS score, count(*) AS frames FROM f""",
    "alignment_summary": f"""
        WITH {_POINTS_SQL}, d AS (SELECT frame, k, abs(xa - xb) + 1 AS d FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d, k) AS r, count(*) OVER (PARTITION BY frame) AS n FROM d),
        l AS (SELECT frame, 2 * avg(d) FILTER (r >= greatest(floor(n * 2 / 5), 1) AND r <= floor(n * 16 / 20)) + 10 AS t FROM r GROUP BY 1),
        f AS (SELECT frame, count(*) AS n, min(t) AS t FROM d JOIN l USING (frame) WHERE d <= t GROUP BY 1 HAVING count(*) >= 3)
        SELECT sum(n)::BIGINT AS n_points, round(avg(t - 10) / 2, 6) AS error FROM f""",
    "coherence_terms": f"""
        WITH {_PATHS_SQL}, o AS (SELECT a.i - 1 AS dr, b.i - 1 AS dc FROM range(3) a(i), range(3) b(i) WHERE a.i <> 1 OR b.i <> 1)
        SELECT p.frame, p.row, p.col, round(1.5::DOUBLE, 6) AS m0, round(1.5::DOUBLE * (n.px - n.cx + p.cx), 6) + 0.0 AS m2, round(1.5::DOUBLE * (n.py - n.cy + p.cy), 6) + 0.0 AS m5, round(1.5::DOUBLE, 6) AS m8, 1.5::DOUBLE AS w
        FROM p CROSS JOIN o JOIN p n ON n.frame = p.frame AND n.row = p.row + dr AND n.col = p.col + dc""",
    "path_round": f"""
        WITH {_PATHS_SQL}, o AS (SELECT a.i - 1 AS dr, b.i - 1 AS dc FROM range(3) a(i), range(3) b(i) WHERE a.i <> 1 OR b.i <> 1),
        terms AS (
            SELECT frame, row, col, px AS x, py AS y, 1.0::DOUBLE AS w FROM p
            UNION ALL SELECT p.frame, p.row, p.col, r.px, r.py, 2.5::DOUBLE / (1 + abs(p.frame - r.frame)) FROM p JOIN p r ON r.row = p.row AND r.col = p.col AND abs(p.frame - r.frame) BETWEEN 1 AND 2
            UNION ALL SELECT p.frame, p.row, p.col, n.px - n.cx + p.cx, n.py - n.cy + p.cy, 1.0 FROM p CROSS JOIN o JOIN p n ON n.frame = p.frame AND n.row = p.row + dr AND n.col = p.col + dc)
        SELECT frame, row, col, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y, 1.0::DOUBLE AS one FROM terms GROUP BY 1, 2, 3""",
    "aligned_points": f"""
        WITH {_PATHS_SQL}, {_POINTS_SQL.replace("WITH ", "")}, q AS (SELECT c.frame, c.k, xa + a.px - a.cx AS ux, ya + a.py - a.cy AS uy, xb + b.px - b.cx + 2.5::DOUBLE AS vx, yb + b.py - b.cy - 1.5::DOUBLE AS vy
          FROM c JOIN p a ON a.frame = c.frame AND a.row = {_ROW('ya')} AND a.col = {_COL('xa')} JOIN p b ON b.frame = c.frame AND b.row = {_ROW('yb')} AND b.col = {_COL('xb')})
        SELECT frame, k, round(ux, 6) AS ux, round(uy, 6) AS uy, round(vx, 6) AS vx, round(vy, 6) AS vy, round(sqrt((ux - vx) ** 2 + (uy - vy) ** 2), 6) AS d FROM q""",
    "stitched_points": f"""
        WITH {_PATHS_SQL}, {_POINTS_SQL.replace("WITH ", "")}, q AS (SELECT c.frame, c.k, xa + a.px - a.cx + 110 AS ax, ya + a.py - a.cy + 120 AS ay, xb + b.px - b.cx + 112.5::DOUBLE AS bx, yb + b.py - b.cy + 118.5::DOUBLE AS by_
          FROM c JOIN p a ON a.frame = c.frame AND a.row = {_ROW('ya')} AND a.col = {_COL('xa')} JOIN p b ON b.frame = c.frame AND b.row = {_ROW('yb')} AND b.col = {_COL('xb')} WHERE c.k % 3 > 0)
        SELECT c.frame, c.k, round(coalesce(ax, -1), 6) AS ax, round(coalesce(ay, -1), 6) AS ay, round(coalesce(bx, -1), 6) AS bx, round(coalesce(by_, -1), 6) AS by FROM c LEFT JOIN q USING (frame, k) WHERE frame BETWEEN 3 AND 20""",
    "mean_offset": f"WITH {_PATHS_SQL} SELECT round(avg(px - cx), 6) AS x, round(avg(py - cy), 6) AS y, 1.0::DOUBLE AS a, 1.0::DOUBLE AS one FROM p",
    "target_mesh": f"""
        WITH {_PATHS_SQL}, o AS (SELECT a.i AS a, b.i AS b FROM range(2) a(i), range(2) b(i)),
        v AS (SELECT frame, (row - 1 + a)::INT AS i, (col - 1 + b)::INT AS j, row, col, (col - 1 + b) * 125.0 + 1 + px - cx AS x, (row - 1 + a) * 180.0 + 1 + py - cy AS y FROM p, o),
        r AS (SELECT *, row_number() OVER (PARTITION BY frame, i, j ORDER BY row, col) AS n FROM v),
        two AS (SELECT r.frame, r.i, r.j, (r.x + s.x) / 2 AS x, (r.y + s.y) / 2 AS y FROM r JOIN r s ON s.frame = r.frame AND s.i = r.i AND s.j = r.j AND s.n > r.n
                QUALIFY row_number() OVER (PARTITION BY r.frame, r.i, r.j ORDER BY (r.x - s.x) ** 2 + (r.y - s.y) ** 2, s.n, r.n) = 1),
        one AS (SELECT frame, i, j, x, y FROM r QUALIFY count(*) OVER (PARTITION BY frame, i, j) = 1)
        SELECT frame, i, j, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT * FROM two UNION ALL SELECT * FROM one)""",
    "closest_pairs": f"""
        WITH q AS (SELECT o_orderkey, {", ".join(f"(o_totalprice * {i + 1}) % 101 AS x{i}, (o_custkey * {2 * i + 1}) % 89 + 0.0::DOUBLE AS y{i}" for i in range(4))} FROM orders),
        p AS ({" UNION ALL ".join(f"SELECT o_orderkey, (x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2 AS d, {j} AS j, {i} AS i, (x{i} + x{j}) / 2 AS x, (y{i} + y{j}) / 2 AS y FROM q" for i, j in _PAIRS)})
        SELECT o_orderkey, round(x, 5) AS x, round(y, 5) AS y FROM p QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d, j, i) = 1""",
    "running_products": f"""
        WITH {TRACKS_SQL}, f AS (SELECT *, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
        SELECT track_id, frame, 1.0::DOUBLE AS p0, round(sum(CASE WHEN r > 1 THEN x / 1000.0 ELSE 0 END) OVER w, 5) AS p2, round(sum(CASE WHEN r > 1 THEN y + 0.5::DOUBLE ELSE 0 END) OVER w, 5) AS p5, 1.0::DOUBLE AS p8 FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame)""",
    "coding_plane": f"WITH {TRACKS_SQL}, q AS (SELECT track_id, {_PLANE} FROM t GROUP BY 1) SELECT track_id, m, round({_BITS}, 5) AS bits FROM q",
    "coding_total": f"WITH {TRACKS_SQL}, q AS (SELECT track_id % 7 AS label, {_PLANE} FROM t GROUP BY 1) SELECT sum(m)::BIGINT AS m, round(sum({_BITS}), 4) AS bits FROM q",
    "edge_ranks": f'WITH {TRACKS_SQL} SELECT (frame % 10)::INT AS "window", track_id::INT AS u, (track_id % 3)::INT AS v, count(DISTINCT track_id) AS n, round(exp(-0.25::DOUBLE) / 4, 9) AS w FROM t WHERE x > 0 GROUP BY 1, 2, 3',
    "planted_homographies": _PLANTED_SQL,
    "planted_homographies_cells": _PLANTED_SQL,
    "planted_meshes": f"WITH {_POINTS_SQL}, f AS (SELECT DISTINCT frame FROM c) SELECT frame, (a.i + 1)::INT AS row, (b.i + 1)::INT AS col, {_sql_literals(AFFINE, 3)} FROM f, range(4) a(i), range(4) b(i)",
    "max_flows": _FLOW_SQL,
    "soft_masks": f"""
        WITH {_POINTS_SQL}, places AS (SELECT frame, (i * 20)::INT AS y, (i * 45)::INT AS x FROM (SELECT DISTINCT frame FROM c), range(10) r(i)),
        q AS (SELECT q_.frame, q_.y, q_.x, k % 3 = 0 AS good, exp(-((xa - q_.x) ** 2 + (ya - q_.y) ** 2) / 5000.0) AS w FROM places q_ JOIN c ON c.frame = q_.frame)
        SELECT frame, y, x, round(CASE WHEN sum(w) > 0 THEN sum(CASE WHEN good THEN w ELSE 0 END) / sum(w) END, 6) AS m FROM q GROUP BY 1, 2, 3""",
    "cross_fades": f"WITH {GRID_SQL} SELECT y, x, round(v * (1 - 0.5::DOUBLE / (1 + exp(-0.4::DOUBLE * (x - 15)))), 5) AS v FROM g",
    "mosaics": f"WITH {GRID_SQL} SELECT (y // 5 * 5 + (x - 1) // 8)::INT AS y, (y % 5 * 9 + (x - 1) % 8)::INT AS x, v FROM g",
    "dark_dropped": f"WITH {GRID_SQL}, {_sql_blurred()} SELECT y + 0.25::DOUBLE AS y, x + 0.25::DOUBLE AS x FROM ky WHERE m <= 0.2",
    "gray_image": f"WITH {GRID_SQL} SELECT y, (x - 1)::INT AS x, round((0.299::DOUBLE * (v % 256) + 0.587::DOUBLE * (v // 3 % 256) + 0.114::DOUBLE * (v // 7 % 256)) / 255, 6) AS v FROM g",
    "frames_zipped": "SELECT page_id AS frame_idx, md5(html) AS a, 2 * strlen(html)::BIGINT AS n FROM pages WHERE page_id % 3 > 0 AND html IS NOT NULL",
    "keypoints": f"""
        WITH s AS (SELECT *, s_suppkey // 1000 * 100 + s_nationkey AS file, (row_number() OVER (PARTITION BY s_suppkey // 1000, s_nationkey ORDER BY s_suppkey) - 1)::INT AS k FROM supplier)
        SELECT 'ubc' AS form, file, k, list_aggregate({_UBC_BINS}, 'string_agg', ',') AS descriptor, s_nationkey + 1.0::DOUBLE AS f0, s_suppkey + 1.5::DOUBLE AS f1, 2.25::DOUBLE AS f2, -0.5::DOUBLE AS f3 FROM s
        UNION ALL SELECT 'oxford', file, k, '7,8,' || s_nationkey, s_suppkey + 1.0::DOUBLE, s_nationkey + 1.0::DOUBLE, round(s_suppkey / (0.5::DOUBLE * s_suppkey - 0.0625), 6), round(-0.25::DOUBLE / (0.5::DOUBLE * s_suppkey - 0.0625), 6) FROM s""",
    "synthetic_images": "WITH s AS (SELECT s_suppkey, s_nationkey % 5 + 8 AS h, (s_suppkey % 7 + 10)::INT AS w FROM supplier), p AS (SELECT s.*, a.i::INT AS y, b.i::INT AS x FROM s, range(12) a(i), range(16) b(i) WHERE a.i < h AND b.i < w) " + " UNION ALL ".join(
        f"SELECT s_suppkey, '{kind}' AS kind, y, x, round(({v})::DOUBLE, 6) AS v FROM p" for kind, v in (("step", "(x >= w // 2)::INT"), ("ramp", "x / (w - 1)"), ("checker", "(y // 8 + x // 8) % 2"), ("disc", "((y - h / 2) ** 2 + (x - w / 2) ** 2 <= (least(h, w) / 4) ** 2)::INT"), ("stripes", "0.5::DOUBLE + 0.5::DOUBLE * sin(x * 0.5::DOUBLE)"))
    ),
    "stage_cached": f"WITH {TRACKS_SQL} SELECT track_id, count(*) AS n, 1 AS made FROM t GROUP BY 1",
}
