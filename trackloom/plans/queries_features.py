"""Queries on scale-space features of many images, videos, rendered meshes, and points followed over clips."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import features as T
from trackloom.operators import images as I
from trackloom.operators import render as N
from trackloom.plans.stages import durable, forget_at_exit, shared_folder
from trackloom.plans.tables import table
from trackloom.sources import video as IO
from trackloom.streaming import tracks as R

#: Images that users' events are dealt to, their height and width, octaves, and the least response of a keypoint.
IMAGES, HEIGHT, WIDTH, OCTAVES, PEAK = 64, 24, 31, 2, 1.0


#: Side of a superpixel.
SIDE = 8


def user_images(spark, sf_dir):
    """``image, y, x, v``: the values of all events by hour and day, an image for users of equal remainder."""
    ev = table(spark, sf_dir, "events").where("value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL")
    at = ev.select(F.pmod("user_id", F.lit(IMAGES)).alias("image"), F.hour("ts").alias("y"), (F.dayofmonth("ts") - 1).alias("x"), F.round(F.col("value") * 100).cast("long").alias("c"))
    sums = at.groupBy("image", "y", "x").agg((F.sum("c") / 100).alias("v"))
    places = F.explode(F.expr(f"sequence(0, {HEIGHT * WIDTH - 1})"))
    empty = at.select("image").distinct().select("image", places.alias("p")).select("image", F.floor(F.col("p") / WIDTH).cast("int").alias("y"), (F.col("p") % WIDTH).cast("int").alias("x"))
    return empty.join(sums, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def oriented_features(spark, sf_dir):
    """Difference-of-blurs keypoints of every image with their directions and descriptors."""
    found = T.features(user_images(spark, sf_dir), T.Options(peak=PEAK), OCTAVES)
    return found.select(F.col("image").cast("int").alias("image"), F.col("octave").cast("int").alias("octave"), *(F.round(c, 4).alias(c) for c in ("y", "x", "sigma", "angle", "response")), F.array_join("d", ",").alias("d"))


def adapted_features(spark, sf_dir):
    """Hessian keypoints of every scale and image with the ellipses that make them round."""
    found = T.features(user_images(spark, sf_dir), T.Options("multiscale_hessian", peak=PEAK, affine=True), OCTAVES)
    shape = [F.round(F.col("shape")[i], 4).alias(n) for i, n in enumerate(("xx", "xy", "yx", "yy"))]
    return found.select(F.col("image").cast("int").alias("image"), "octave", *(F.round(c, 4).alias(c) for c in ("y", "x", "sigma", "angle", "response")), *shape, F.array_join("d", ",").alias("d"))


def whitened(spark, sf_dir):
    """Every image with its spectrum flattened."""
    return I.whitened(user_images(spark, sf_dir), ["image"]).select(F.col("image").cast("int").alias("image"), "y", "x", (F.round("v", 4) + 0.0).alias("v"))


def superpixel_labels(spark, sf_dir):
    return I.superpixel_labels(user_images(spark, sf_dir), ["image"], SIDE).select(F.col("image").cast("int").alias("image"), "y", "x", "label")


def filled_regions(spark, sf_dir):
    """Around the middle of every image, what is no brighter than it."""
    return I.filled_regions(user_images(spark, sf_dir), ["image"], (HEIGHT // 2, WIDTH // 2)).select(F.col("image").cast("int").alias("image"), "y", "x")


def region_table(spark, sf_dir):
    """The stable regions of every image after a blur, in 256 levels of its largest value."""
    images = I.smooth(user_images(spark, sf_dir), I.gaussian_weights(1.5), image=["image"])
    top = images.groupBy("image").agg(F.max("v").alias("top")).where("top > 0")
    gray = images.join(F.broadcast(top), "image").select("image", "y", "x", F.floor(255 * F.col("v") / F.col("top")).cast("double").alias("v"))
    return I.region_table(gray, ["image"]).select(F.col("image").cast("int").alias("image"), "y", "x", "level", "area")


#: Frames of a clip, their sides, the step of the window from frame to frame, and how much larger the grid is made.
FRAMES, SIDES, STEP, TIMES = 8, (64, 80), (1, 3), 4


def type_clips(spark, sf_dir):
    """``clip, frame, height, width, pixels``: a window that moves over the values by hour and day of each type of event."""
    ev = table(spark, sf_dir, "events").where("value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    sums = ev.groupBy(F.crc32("event_type").alias("image"), F.hour("ts").alias("y"), (F.dayofmonth("ts") - 1).alias("x")).agg(F.sum("value").alias("v"))
    places = F.explode(F.expr(f"sequence(0, {HEIGHT * WIDTH - 1})"))
    empty = sums.select("image").distinct().select("image", places.alias("p")).select("image", F.floor(F.col("p") / WIDTH).cast("int").alias("y"), (F.col("p") % WIDTH).cast("int").alias("x"))
    grid = empty.join(sums, ["image", "y", "x"], "left").select("image", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    for _ in range(int(math.log2(TIMES))):
        grid = I.smooth(I.up(grid, ["image"]), I.gaussian_weights(1.0), image=["image"])
    top = grid.groupBy("image").agg(F.max("v").alias("top"))
    gray = grid.join(F.broadcast(top), "image").select("image", "y", "x", F.round(255 * F.col("v") / F.col("top")).cast("int").alias("g"))
    seen = gray.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    seen = seen.select("image", "frame", (F.col("y") - STEP[0] * F.col("frame")).alias("y"), (F.col("x") - STEP[1] * F.col("frame")).alias("x"), "g").where(f"y BETWEEN 0 AND {SIDES[0] - 1} AND x BETWEEN 0 AND {SIDES[1] - 1}")
    rows = seen.groupBy("image", "frame").agg(F.array_sort(F.collect_list(F.struct("y", "x", "g"))).alias("p"))
    raw = F.unhex(F.array_join(F.transform("p", lambda s: F.lpad(F.hex(s["g"]), 2, "0")), ""))
    return rows.select(F.col("image").alias("clip"), F.col("frame").cast("long").alias("frame"), F.lit(SIDES[0]).alias("height"), F.lit(SIDES[1]).alias("width"), raw.alias("pixels"))


def stream_points(spark, sf_dir):
    """Points followed over every clip as a stream: the moves from frame to frame."""
    out = f"{shared_folder(spark)}/trackloom-stages/points-{uuid.uuid4().hex}"
    frames = durable(type_clips(spark, sf_dir))
    stream = spark.readStream.schema(frames.schema).parquet(frames.inputFiles()[0].rsplit("/", 1)[0])
    query = R.track_points(stream, mesh=4, demand=64).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    forget_at_exit(spark, out)
    forget_at_exit(spark, f"{out}-state")
    return spark.read.parquet(out).select("clip", "frame", "track_id", "age", *(F.round(c, 2).alias(c) for c in ("x", "y", "px", "py")))


#: Rows and columns of the mesh, its cells' height and width, and the canvas's margin.
MESH, CELL, GAP = (4, 5), (6.0, 6.2), 4


def moved_mesh(spark, sf_dir):
    """``image, i, j, x, y``: the vertices of every image's mesh, moved by up to two pixels, some over their neighbours."""
    images = user_images(spark, sf_dir).select("image").distinct()
    grid = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(MESH[0]))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(MESH[1]))).alias("j"))
    shift = lambda a, b, c: (F.pmod(F.col("image") * a + F.col("i") * b + F.col("j") * c, F.lit(9)) - 4) * 0.55
    return grid.select("image", "i", "j", (F.col("j") * CELL[1] + shift(7, 3, 5) + 0.3).alias("x"), (F.col("i") * CELL[0] + shift(4, 7, 2) - 0.2).alias("y"))


def rendered_meshes(spark, sf_dir):
    """Every image under its moved mesh, on a wider canvas."""
    found = N.render(user_images(spark, sf_dir), moved_mesh(spark, sf_dir), ["image"], HEIGHT, WIDTH, *CELL, gap=GAP)
    return found.select(F.col("image").cast("int").alias("image"), "y", "x", (F.round("v", 4) + 0.0).alias("v"))


#: Pages of a clip.
CLIP = 64


def video_frames(spark, sf_dir):
    """All pages as the frames of clips of 64, written as videos and read back by their sample tables."""
    out = f"{shared_folder(spark)}/trackloom-stages/videos-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / CLIP).alias("clip"), F.col("page_id").alias("frame_idx"), F.col("html").alias("content"))
    IO.write_videos(pages, out, rate=5)
    forget_at_exit(spark, out)
    clip = F.regexp_extract("path", "([0-9]+)[.]mp4$", 1).cast("long")
    return IO.read_video(spark, out).select(clip.alias("clip"), "frame_idx", F.round("pts", 4).alias("pts"), "length", F.md5("content").alias("digest"))


QUERIES = {"whitened": whitened, "superpixel_labels": superpixel_labels, "filled_regions": filled_regions, "region_table": region_table, "video_frames": video_frames, "rendered_meshes": rendered_meshes, "oriented_features": oriented_features, "adapted_features": adapted_features, "stream_points": stream_points}

_O = T.Options()
_LAYERS = _O.levels + 3


def _sql_weights(octave: int) -> str:
    """``s, k, w``: the taps of each layer's blur."""
    rows = []
    for s in range(-1, _LAYERS - 1):
        had = _O.blur if octave == 0 else _O.scale(-1)
        sigma = math.sqrt(max(_O.scale(s) ** 2 - had**2, 0)) if octave == 0 or s > -1 else 0
        half = max(1, math.ceil(4 * sigma)) if sigma else 0
        w = np.exp(-0.5 * (np.arange(-half, half + 1) / (sigma or 1)) ** 2)
        rows += [f"({s}, {k}, {float(v)!r}::DOUBLE)" for k, v in zip(range(-half, half + 1), w / w.sum(), strict=True)]
    return f"(VALUES {', '.join(rows)}) t(s, k, w)"


def _sql_octave(o: int, h: int, w: int) -> list[str]:
    """Layers, differences, fits and refined keypoints of an octave from its base ``b{o}``."""
    cell = lambda s, y, x: f"max(CASE WHEN os = {s} AND oy = {y} AND ox = {x} THEN n.r END)"
    names = {(s, y, x): f"v{'mzp'[s + 1]}{'mzp'[y + 1]}{'mzp'[x + 1]}" for s in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)}
    v = lambda s, y, x: names[s, y, x]
    steps = "(SELECT a AS os, b AS oy, c AS ox FROM range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) u(c))"
    out = [
        f"w{o} AS (SELECT * FROM {_sql_weights(o)})",
        f"p{o} AS (SELECT s, image, y, x, sum(w * b.v) AS v FROM (SELECT image, y, x, s, w, greatest(0, least({w - 1}, x + k)) AS sx FROM b{o}, w{o}) q JOIN (SELECT image, y, x AS sx, v FROM b{o}) b USING (image, y, sx) GROUP BY ALL)",
        f"l{o} AS MATERIALIZED (SELECT s, image, y, x, sum(w * b.v) AS v FROM (SELECT s, image, y, x, w, greatest(0, least({h - 1}, y + k)) AS sy FROM p{o} JOIN w{o} USING (s)) q JOIN (SELECT s, image, y AS sy, x, v FROM p{o}) b USING (s, image, sy, x) GROUP BY ALL)",
        f"b{o + 1} AS (SELECT image, y // 2 AS y, x // 2 AS x, v FROM l{o} WHERE s = {_O.levels - 1} AND y % 2 = 0 AND x % 2 = 0)",
        f"d{o} AS MATERIALIZED (SELECT a.s, a.image, a.y, a.x, b.v - a.v AS r FROM l{o} a JOIN l{o} b ON b.s = a.s + 1 AND b.image = a.image AND b.y = a.y AND b.x = a.x)",
        f"n{o} AS (SELECT a.image, a.s, a.y, a.x, {', '.join(f'{cell(*k)} AS {n}' for k, n in names.items())}, max(round(n.r, 9)) FILTER (os <> 0 OR oy <> 0 OR ox <> 0) AS hi, min(round(n.r, 9)) FILTER (os <> 0 OR oy <> 0 OR ox <> 0) AS lo "
        f"FROM d{o} a, {steps} k JOIN d{o} n ON n.image = a.image AND n.s = a.s + os AND n.y = a.y + oy AND n.x = a.x + ox WHERE a.s BETWEEN 0 AND {_O.levels - 1} AND a.y BETWEEN 1 AND {h - 2} AND a.x BETWEEN 1 AND {w - 2} GROUP BY ALL)",
        f"g{o} AS (SELECT *, {v(0, 0, 0)} AS c, ({v(0, 0, 1)} - {v(0, 0, -1)}) / 2 AS gx, ({v(0, 1, 0)} - {v(0, -1, 0)}) / 2 AS gy, ({v(1, 0, 0)} - {v(-1, 0, 0)}) / 2 AS gs, "
        f"{v(0, 0, 1)} + {v(0, 0, -1)} - 2 * {v(0, 0, 0)} AS xx, {v(0, 1, 0)} + {v(0, -1, 0)} - 2 * {v(0, 0, 0)} AS yy, {v(1, 0, 0)} + {v(-1, 0, 0)} - 2 * {v(0, 0, 0)} AS ss, "
        f"({v(0, 1, 1)} + {v(0, -1, -1)} - {v(0, -1, 1)} - {v(0, 1, -1)}) / 4 AS xy, ({v(1, 0, 1)} + {v(-1, 0, -1)} - {v(-1, 0, 1)} - {v(1, 0, -1)}) / 4 AS xs, ({v(1, 1, 0)} + {v(-1, -1, 0)} - {v(-1, 1, 0)} - {v(1, -1, 0)}) / 4 AS ys FROM n{o})",
        f"h{o} AS (SELECT *, nullif(xx * (yy * ss - ys * ys) - xy * (xy * ss - ys * xs) + xs * (xy * ys - yy * xs), 0) AS det FROM g{o})",
        f"f{o} AS MATERIALIZED (SELECT image, s, y, x, c, hi, lo, gx, gy, gs, xx, yy, xy, -(gx * (yy * ss - ys * ys) - xy * (gy * ss - ys * gs) + xs * (gy * ys - yy * gs)) / det AS dx, "
        f"-(xx * (gy * ss - gs * ys) - gx * (xy * ss - ys * xs) + xs * (xy * gs - gy * xs)) / det AS dy, -(xx * (yy * gs - ys * gy) - xy * (xy * gs - gy * xs) + gx * (xy * ys - yy * xs)) / det AS ds FROM h{o})",
        f"m{o}_0 AS (SELECT image, s, y, x, y AS y0, x AS x0 FROM f{o} WHERE round(c, 9) > hi AND round(c, 9) >= {0.8 * PEAK} OR round(c, 9) < lo AND -round(c, 9) >= {0.8 * PEAK})",
    ]
    step = lambda d, p, n: f"(coalesce({d}, 0) > 0.6 AND {p} < {n - 2})::INT - (coalesce({d}, 0) < -0.6 AND {p} > 1)::INT"
    for r in range(1, T.MOVES):
        out.append(f"m{o}_{r} AS (SELECT image, s, m.y + {step('dy', 'y', h)} AS y, m.x + {step('dx', 'x', w)} AS x, y0, x0 FROM m{o}_{r - 1} m JOIN f{o} USING (image, s, y, x))")
    out.append(
        f"k{o} AS (SELECT {o} AS octave, image, s AS s0, y0, x0, s + ds AS s, y + dy AS y, x + dx AS x, c + (gx * dx + gy * dy + gs * ds) / 2 AS response FROM m{o}_{T.MOVES - 1} JOIN f{o} USING (image, s, y, x) "
        f"WHERE abs(dx) < 1.5 AND abs(dy) < 1.5 AND abs(ds) < 1.5 AND xx * yy - xy * xy > 0 AND (xx + yy) * (xx + yy) * {_O.edge} < {(_O.edge + 1) ** 2} * (xx * yy - xy * xy) AND y + dy BETWEEN 0 AND {h - 1} AND x + dx BETWEEN 0 AND {w - 1})"
    )
    out.append(f"t{o} AS (SELECT {o} AS octave, a.s, a.image, a.y, a.x, (max(n.v) FILTER (ox = 1) - max(n.v) FILTER (ox = -1)) / 2 AS gx, (max(n.v) FILTER (oy = 1) - max(n.v) FILTER (oy = -1)) / 2 AS gy "
               f"FROM l{o} a, {steps} k JOIN l{o} n ON os = 0 AND abs(oy) + abs(ox) = 1 AND n.image = a.image AND n.s = a.s AND n.y = a.y + oy AND n.x = a.x + ox WHERE a.y BETWEEN 1 AND {h - 2} AND a.x BETWEEN 1 AND {w - 2} GROUP BY a.s, a.image, a.y, a.x)")  # fmt: skip
    return out


def _sql_smoothing() -> str:
    """Six circular means of three, as one."""
    w = np.ones(1)
    for _ in range(6):
        w = np.convolve(w, np.ones(3) / 3)
    return ", ".join(f"({k - 6}, {float(v)!r}::DOUBLE)" for k, v in enumerate(w))


_SQL_IMAGES = f"""ev AS (SELECT user_id % {IMAGES} AS image, hour(ts) AS y, day(ts) - 1 AS x, sum(round(value * 100)::BIGINT) / 100 AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
        b0 AS (SELECT image, y, x, coalesce(v, 0)::DOUBLE AS v FROM (SELECT image, (i // {WIDTH})::INT AS y, (i % {WIDTH})::INT AS x FROM (SELECT DISTINCT image FROM ev), range({HEIGHT * WIDTH}) r(i)) LEFT JOIN ev USING (image, y, x))"""
_SQL_KEYS = lambda d: f"CASE WHEN abs({d}) <= 1 THEN 1.5 * pow(abs({d}), 3) - 2.5 * pow({d}, 2) + 1 WHEN abs({d}) < 2 THEN -0.5 * pow(abs({d}), 3) + 2.5 * pow({d}, 2) - 4 * abs({d}) + 2 ELSE 0 END"


def _sql_rendered() -> str:
    shift = lambda a, b, c: f"((image * {a} + i * {b} + j * {c}) % 9 - 4) * 0.55::DOUBLE"
    corner = ", ".join(f"max(x) FILTER (a = {a} AND b = {b}) AS x{n}, max(y) FILTER (a = {a} AND b = {b}) AS y{n}" for n, (a, b) in enumerate(N.CORNERS))
    return f"""WITH {_SQL_IMAGES},
        v AS (SELECT image, i, j, j * {CELL[1]}::DOUBLE + {shift(7, 3, 5)} + 0.3 AS x, i * {CELL[0]}::DOUBLE + {shift(4, 7, 2)} - 0.2 AS y FROM (SELECT DISTINCT image FROM ev), range({MESH[0] + 1}) p(i), range({MESH[1] + 1}) q(j)),
        q AS (SELECT image, i - a AS r, j - b AS c, {corner} FROM v, range(2) p(a), range(2) q(b) WHERE i - a BETWEEN 0 AND {MESH[0] - 1} AND j - b BETWEEN 0 AND {MESH[1] - 1} GROUP BY ALL),
        c AS (SELECT p.y - {GAP} AS y, q.x - {GAP} AS x FROM range({HEIGHT + 2 * GAP}) p(y), range({WIDTH + 2 * GAP}) q(x)),
        o AS (SELECT q.*, c.y, c.x FROM q JOIN c ON c.x >= floor(least(x0, x1, x2, x3)) AND c.x < ceil(greatest(x0, x1, x2, x3)) AND c.y >= floor(least(y0, y1, y2, y3)) AND c.y < ceil(greatest(y0, y1, y2, y3)) QUALIFY row_number() OVER (PARTITION BY image, c.y, c.x ORDER BY r DESC, c DESC) = 1),
        s AS (SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS g, ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS h FROM o),
        m AS (SELECT image, y, x, r, c, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, x0 AS t, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e, y0 AS f, g, h FROM s),
        w AS (SELECT image, y, x, round((r + ((f * g - d) * x + (a - t * g) * y + t * d - a * f) / ((d * h - e * g) * x + (b * g - a * h) * y + a * e - b * d)) * {CELL[0]}::DOUBLE, 9) AS wy,
            round((c + ((e - f * h) * x + (t * h - b) * y + b * f - t * e) / ((d * h - e * g) * x + (b * g - a * h) * y + a * e - b * d)) * {CELL[1]}::DOUBLE, 9) AS wx FROM m),
        k AS (SELECT w.image, w.y, w.x, floor(wy) + i - 1 AS sy, floor(wx) + j - 1 AS sx, ({_SQL_KEYS("(wy - floor(wy) - i + 1)")}) * ({_SQL_KEYS("(wx - floor(wx) - j + 1)")}) AS weight FROM w, range(4) p(i), range(4) q(j) WHERE wy BETWEEN -1 AND {HEIGHT} AND wx BETWEEN -1 AND {WIDTH}),
        z AS (SELECT k.image, k.y, k.x, CASE WHEN count(b0.v) = count(*) THEN sum(weight * b0.v) END AS v FROM k LEFT JOIN b0 ON b0.image = k.image AND b0.y = sy AND b0.x = sx WHERE weight <> 0 GROUP BY ALL)
        SELECT image::INT AS image, w.y::INT AS y, w.x::INT AS x, round(z.v, 4) + 0.0 AS v FROM w LEFT JOIN z USING (image, y, x)"""


def _sql_features() -> str:
    sizes = [(HEIGHT, WIDTH)]
    for _ in range(OCTAVES - 1):
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    of = lambda c: " UNION ALL ".join(f"SELECT * FROM {c}{o}" for o in range(OCTAVES))
    turn, cells, bins, dirs = repr(T.TURN), T.CELLS, T.BINS, T.DIRECTIONS
    return ",\n".join([
        f"WITH {_SQL_IMAGES}",
        *(part for o, (h, w) in enumerate(sizes) for part in _sql_octave(o, h, w)),
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS id, octave, image, y, x, response, {_O.sigma} * pow(2, s / {_O.levels}) AS sigma, greatest(-1, least({_O.levels + 1}, floor(s + 0.5))) AS s FROM ({of('k')}))",
        f"g AS MATERIALIZED (SELECT octave, s, image, y, x, sqrt(gx * gx + gy * gy) AS m, atan2(gy, gx) AS a FROM ({of('t')}))",
        "ka AS (SELECT *, greatest(floor(3 * (1.5 * sigma)), 1) AS reach, floor(y + 0.5) AS yi, floor(x + 0.5) AS xi FROM k)",
        "oa AS (SELECT id, reach, sigma, m, a, (g.y - ka.y) * (g.y - ka.y) + (g.x - ka.x) * (g.x - ka.x) AS far FROM ka JOIN g USING (octave, image, s) WHERE abs(g.y - yi) <= reach AND abs(g.x - xi) <= reach)",
        f"ob AS (SELECT id, exp(-far / (2 * (1.5 * sigma) * (1.5 * sigma))) * m AS w, a / {turn} * {bins} - {bins} * floor(a / {turn}) AS p FROM oa WHERE far < reach * reach + 0.6)",
        f"oc AS (SELECT id, (floor(p - 0.5)::INT + {bins} + e) % {bins} AS bin, sum(w * CASE WHEN e = 0 THEN 1 - (p - floor(p - 0.5) - 0.5) ELSE p - floor(p - 0.5) - 0.5 END) AS h FROM ob, range(2) r(e) GROUP BY ALL)",
        f"od AS MATERIALIZED (SELECT id, ((bin + d + {bins}) % {bins})::INT AS bin, sum(h * w) AS h FROM oc, (VALUES {_sql_smoothing()}) t(d, w) GROUP BY ALL)",
        f"oe AS (SELECT a.id, a.bin, a.h, coalesce(b.h, 0) AS hb, coalesce(c.h, 0) AS hc, max(a.h) OVER (PARTITION BY a.id) AS top FROM od a LEFT JOIN od b ON b.id = a.id AND b.bin = (a.bin + {bins - 1}) % {bins} LEFT JOIN od c ON c.id = a.id AND c.bin = (a.bin + 1) % {bins})",
        f"kd AS MATERIALIZED (SELECT k.*, {turn} * (bin - 0.5 * (hc - hb) / (hc + hb - 2 * h) + 0.5) / {bins} AS angle, row_number() OVER () AS kid, {_O.magnify} * sigma AS cell FROM oe JOIN k USING (id) WHERE h > 0.8 * top AND h > hb AND h > hc)",
        f"da AS (SELECT kid, m, (cos(angle) * (g.x - kd.x) + sin(angle) * (g.y - kd.y)) / cell AS nx, (cos(angle) * (g.y - kd.y) - sin(angle) * (g.x - kd.x)) / cell AS ny, (a - angle) / {turn} - floor((a - angle) / {turn}) AS t "
        f"FROM kd JOIN g USING (octave, image, s) WHERE abs(g.y - floor(kd.y + 0.5)) <= floor(sqrt(2) * cell * {cells + 1} / 2 + 0.5) AND abs(g.x - floor(kd.x + 0.5)) <= floor(sqrt(2) * cell * {cells + 1} / 2 + 0.5))",
        f"db AS (SELECT kid, exp(-(nx * nx + ny * ny) / {2 * _O.window**2}) * m AS w, ny - 0.5 - floor(ny - 0.5) AS ry, nx - 0.5 - floor(nx - 0.5) AS rx, t * {dirs} - floor(t * {dirs}) AS rt, floor(ny - 0.5)::INT AS y, floor(nx - 0.5)::INT AS x, floor(t * {dirs})::INT AS t FROM da)",
        f"dc AS (SELECT kid, ((y + a + {cells // 2}) * {cells} + x + b + {cells // 2}) * {dirs} + (t + c) % {dirs} AS i, sum(w * abs(1 - a - ry) * abs(1 - b - rx) * abs(1 - c - rt)) AS h FROM db, range(2) p(a), range(2) q(b), range(2) u(c) "
        f"WHERE y + a BETWEEN {-cells // 2} AND {cells // 2 - 1} AND x + b BETWEEN {-cells // 2} AND {cells // 2 - 1} GROUP BY ALL)",
        f"dd AS (SELECT kid, i, coalesce(h, 0) AS h FROM (SELECT kid, i::BIGINT AS i FROM kd, range({cells * cells * dirs}) r(i)) LEFT JOIN dc USING (kid, i))",
        f"de AS (SELECT kid, i, least(coalesce(h / nullif(sqrt(sum(h * h) OVER (PARTITION BY kid)), 0), 0), {T.CLIP}) AS h FROM dd)",
        "df AS (SELECT kid, i, coalesce(h / nullif(sqrt(sum(h * h) OVER (PARTITION BY kid)), 0), 0) AS h FROM de)",
        "dg AS (SELECT kid, string_agg(least(floor(512 * h), 255)::INT, ',' ORDER BY i) AS d FROM df GROUP BY 1)",
    ]) + " SELECT image::INT AS image, octave, round(y * pow(2, octave), 4) AS y, round(x * pow(2, octave), 4) AS x, round(sigma * pow(2, octave), 4) AS sigma, round(angle, 4) AS angle, round(response, 4) AS response, d FROM kd JOIN dg USING (kid) WHERE abs(response) >= " + repr(PEAK)


def _sql_superpixels(rounds: int = 10) -> str:
    parts = [
        f"c0 AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS k, y::DOUBLE AS cy, x::DOUBLE AS cx, v AS c FROM b0 WHERE y % {SIDE} = {SIDE // 2} AND x % {SIDE} = {SIDE // 2})",
        "l0 AS (SELECT image, y, x, v, 0 AS k FROM b0)",
    ]
    for r in range(1, rounds + 1):
        parts += [
            f"a{r} AS MATERIALIZED (SELECT b0.image, y, x, k FROM b0 JOIN c{r - 1} c ON b0.image = c.image AND y BETWEEN greatest(0, trunc(cy - {SIDE})) AND trunc(cy + {SIDE}) AND x BETWEEN greatest(0, trunc(cx - {SIDE})) AND trunc(cx + {SIDE}) "
            f"QUALIFY row_number() OVER (PARTITION BY b0.image, y, x ORDER BY (v - c) * (v - c) + {0.1 / SIDE**2!r}::DOUBLE * ((y - cy) * (y - cy) + (x - cx) * (x - cx)), k) = 1)",
            f"l{r} AS MATERIALIZED (SELECT image, y, x, v, coalesce(a{r}.k, l{r - 1}.k) AS k FROM l{r - 1} LEFT JOIN a{r} USING (image, y, x))",
            f"c{r} AS MATERIALIZED (SELECT image, k, coalesce(m.cy, c.cy) AS cy, coalesce(m.cx, c.cx) AS cx, coalesce(m.c, c.c) AS c FROM c{r - 1} c LEFT JOIN (SELECT image, k, avg(y) AS cy, avg(x) AS cx, avg(v) AS c FROM l{r} GROUP BY ALL) m USING (image, k))",
        ]
    return f"WITH {_SQL_IMAGES}, {', '.join(parts)} SELECT image::INT AS image, y, x, k::INT AS label FROM l{rounds}"


def _sql_whitened() -> str:
    wave = lambda k, x, n: f"2 * pi() * {k} * {x} / {n}"
    part = lambda c, n: f"2.0::DOUBLE * (CASE WHEN {c} <= {(n - 1) // 2} THEN {c} ELSE {c} - {n} END) / {n}"
    h, w = HEIGHT, WIDTH
    return f"""WITH {_SQL_IMAGES},
        r AS (SELECT image, y, u, sum(v * cos({wave("u", "x", w)})) AS a, -sum(v * sin({wave("u", "x", w)})) AS b FROM b0, range({w}) p(u) GROUP BY ALL),
        f AS (SELECT image, t, u, sum(a * cos({wave("t", "y", h)}) + b * sin({wave("t", "y", h)})) AS a, sum(b * cos({wave("t", "y", h)}) - a * sin({wave("t", "y", h)})) AS b FROM r, range({h}) p(t) GROUP BY ALL),
        q AS (SELECT *, sqrt(pow({part("t", h)}, 2) + pow({part("u", w)}, 2)) AS rho FROM f), g AS (SELECT image, t, u, a * rho * exp(-pow(rho / 0.8, 4)) AS a, b * rho * exp(-pow(rho / 0.8, 4)) AS b FROM q),
        s AS (SELECT image, y, u, sum(a * cos({wave("t", "y", h)}) - b * sin({wave("t", "y", h)})) AS a, sum(b * cos({wave("t", "y", h)}) + a * sin({wave("t", "y", h)})) AS b FROM g, range({h}) p(y) GROUP BY ALL)
        SELECT image::INT AS image, y::INT AS y, x::INT AS x, round(sum(a * cos({wave("u", "x", w)}) - b * sin({wave("u", "x", w)})) / {h * w}, 4) + 0.0 AS v FROM s, range({w}) p(x) GROUP BY ALL"""


_SQL_FILLED = f"""WITH RECURSIVE {_SQL_IMAGES}, s AS (SELECT image, v AS top FROM b0 WHERE y = {HEIGHT // 2} AND x = {WIDTH // 2}),
        f AS (SELECT image, {HEIGHT // 2} AS y, {WIDTH // 2} AS x FROM s UNION SELECT n.image, n.y, n.x FROM f JOIN s USING (image) JOIN b0 n ON n.image = f.image AND abs(n.y - f.y) + abs(n.x - f.x) = 1 AND n.v <= top)
        SELECT image::INT AS image, y::INT AS y, x::INT AS x FROM f"""
_SQL_VIDEO = f"""
    WITH p AS (SELECT page_id // {CLIP} AS clip, row_number() OVER (PARTITION BY page_id // {CLIP} ORDER BY page_id) AS n, coalesce(html, '') AS html FROM pages)
    SELECT clip, n::INT AS frame_idx, round((n - 1) / 5.0::DOUBLE, 4) AS pts, octet_length(encode(html)) AS length, md5(html) AS digest FROM p"""
ORACLE_SQL = {"whitened": _sql_whitened(), "superpixel_labels": _sql_superpixels(), "filled_regions": _SQL_FILLED, "video_frames": _SQL_VIDEO, "oriented_features": _sql_features(), "rendered_meshes": _sql_rendered()}
