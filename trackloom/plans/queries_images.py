"""Queries on images, fits and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from trackloom.operators import cluster as C
from trackloom.operators import coding as L
from trackloom.operators import geometry as H
from trackloom.operators import images as I
from trackloom.operators import svm as V
from trackloom.operators import tracks as T
from trackloom.operators.images import gaussian_weights
from trackloom.plans.stages import forget_at_exit, shared_folder
from trackloom.plans.tables import GRID_SQL, TRACKS_SQL, day_grid, table, user_tracks, vectors
from trackloom.sources import frames as IO
from trackloom.streaming import tracks as R


def distance_transform(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", F.col("v").cast("double").alias("v"))
    return I.distance_transform(grid, 500.0, 0.0, 800.0, 0.0, 31).select("y", "x", F.round("v", 4).alias("v"))


def upsampled(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", (F.col("x") - 1).alias("x"), F.col("v").cast("double").alias("v"))
    return I.up(grid).select("y", "x", F.round("v", 4).alias("v"))


def blended(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", F.col("v").cast("double").alias("v"))
    return I.blend(grid.where("x <= 20"), grid.where("x >= 10").withColumn("v", F.col("v") * 2))


def patterns(spark, sf_dir):
    return I.local_binary_patterns(day_grid(spark, sf_dir), 8)


def harris(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", (F.col("v") / 10000.0).alias("v"))
    return I.harris(grid, 1.0).select("y", "x", F.round("r", 3).alias("r"))


def warped(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", F.col("v").cast("double").alias("v"))
    places = grid.select("y", "x", (F.col("y") * 0.9 + 0.5).alias("wy"), (F.col("x") * 0.8 + 2.25).alias("wx"))
    return I.backward_warp(grid, places).select("y", "x", F.round("v", 4).alias("v"))


def _places(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", F.col("v").cast("double").alias("v"))
    return grid, grid.select("y", "x", (F.col("y") * 0.9 + 0.53).alias("wy"), (F.col("x") * 0.8 + 2.27).alias("wx"))


def warped_cubic(spark, sf_dir):
    return I.backward_warp(*_places(spark, sf_dir), kernel="cubic").select("y", "x", F.round("v", 4).alias("v"))


def warp_slopes(spark, sf_dir):
    return I.backward_warp(*_places(spark, sf_dir), slopes=True).select("y", "x", *(F.round(c, 4).alias(c) for c in ("v", "vy", "vx")))


def labelled_sequence(spark, sf_dir):
    """Trajectories kept as a labelled sequence and read between -1 and 1."""
    out = f"{shared_folder(spark)}/trackloom-stages/sequence-{uuid.uuid4().hex}"
    user_tracks(spark, sf_dir).withColumn("label", F.col("track_id") % 3).withColumn("seen", F.col("y") > 1).write.parquet(out)
    forget_at_exit(spark, out)
    return IO.read_sequence(spark, out, normalise=True, masked=True).select("track_id", "frame", *(F.round(c, 8).alias(c) for c in "xy"), "label", "seen")


def _links(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", F.array((F.col("v") / 100000.0)).alias("f"))
    return C.quick_shift(grid, 1.0, 3.0)


def quick_shift(spark, sf_dir):
    return _links(spark, sf_dir).select("y", "x", F.round("density", 6).alias("density"), "parent_y", "parent_x", F.when(F.col("gap") < 1e9, F.round("gap", 6)).otherwise(1e9).alias("gap"))


def medoid_shift(spark, sf_dir):
    grid = day_grid(spark, sf_dir).select("y", "x", F.array((F.col("v") / 100000.0)).alias("f"))
    return C.medoid_shift(grid, 1.0).select("y", "x", "parent_y", "parent_x", F.round("gap", 6).alias("gap"))


def segments(spark, sf_dir):
    """Quick shift, cut where the gap is longer than 2, and flattened."""
    links = _links(spark, sf_dir)
    number = lambda y, x: F.col(y) * 1000 + F.col(x)
    parents = links.select(number("y", "x").alias("node"), F.when(F.col("gap") > 2, number("y", "x")).otherwise(number("parent_y", "parent_x")).alias("parent"))
    return C.flat_map(parents)


def homographies(spark, sf_dir):
    """A homography for each hour of the day, from steps of the trajectories."""
    s = T.steps(user_tracks(spark, sf_dir)).select((F.col("frame") % 24).alias("hour"), *(F.col(c).cast("double").alias(n) for c, n in (("x", "xa"), ("y", "ya"), ("x2", "xb"), ("y2", "yb"))))
    return H.fit_homographies(s, ["hour"], 0.05)


def svm(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("v").alias("x"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"), "id")
    w, b, _ = V.train(rows.select("x", "y"), 0.1, steps=10)
    return V.predict(rows, w, b).select("id", "y", F.round("score", 6).alias("score"))


def coding_bits(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", "v")
    return L.grouped_lengths(rows, "label", "v", 0.5).select("label", "m", F.round("bits", 4).alias("bits"))


def repaired_tracks(spark, sf_dir):
    """Users' weekly values by type of event, the weeks without one filled from users who have all."""
    ev = table(spark, sf_dir, "events").where("value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
    weeks = ev.groupBy("event_type", F.col("user_id").alias("track_id"), F.floor((F.dayofmonth("ts") - 1) / 8).alias("frame")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("v"))
    return L.repaired_tracks(weeks, ["event_type"]).select("event_type", "track_id", "frame", F.round("v", 4).alias("v"), "filled")


def stream_windows(spark, sf_dir):
    """Half-overlapping windows over events as a stream; windows that the watermark closes."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = f"{shared_folder(spark)}/trackloom-stages/stream-{uuid.uuid4().hex}"
    counted = R.sliding_counts(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir), "4 hours", "2 hours", "1 hour")
    query = counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    forget_at_exit(spark, out)
    forget_at_exit(spark, f"{out}-state")
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_tracks(spark, sf_dir):
    """Stretches of activity of every user from a stream: ended by a gap of a day, or by two idle days."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = f"{shared_folder(spark)}/trackloom-stages/tracks-{uuid.uuid4().hex}"
    frame = F.expr("cast(floor((unix_micros(cast(ts as timestamp)) - 1704067200000000L) / 3600000000L) as int) + 1")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("user_id").alias("track_id"), frame.alias("frame"), "ts")
    ended = R.track_lifecycle(events, max_age=10_000, gap=24, ts="ts", late="1 hour", idle_ms=48 * 3_600_000)
    query = ended.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    forget_at_exit(spark, out)
    forget_at_exit(spark, f"{out}-state")
    return spark.read.parquet(out)


QUERIES = {
    "stream_tracks": stream_tracks, "repaired_tracks": repaired_tracks, "medoid_shift": medoid_shift, "image_warp_cubic": warped_cubic, "image_warp_slopes": warp_slopes, "labelled_sequence": labelled_sequence,
    "image_distance_transform": distance_transform, "image_up": upsampled, "image_blend": blended, "image_patterns": patterns, "image_harris": harris, "image_warp": warped,
    "quick_shift": quick_shift, "quick_segments": segments, "homographies": homographies, "svm": svm, "coding_bits": coding_bits, "stream_windows": stream_windows,
}

_BLUR = gaussian_weights(1.0)
_TAPS = ", ".join(f"({i - len(_BLUR) // 2}, {v!r}::DOUBLE)" for i, v in enumerate(_BLUR))


def _sql_slope(c: str) -> str:
    return f"CASE WHEN lag(v) OVER w{c} IS NULL THEN lead(v) OVER w{c} - v WHEN lead(v) OVER w{c} IS NULL THEN v - lag(v) OVER w{c} ELSE (lead(v) OVER w{c} - lag(v) OVER w{c}) / 2 END AS g{c}"


_QUICK = f"""{GRID_SQL}, p AS (SELECT y, x, v / 100000.0 AS f FROM g),
    near AS (SELECT a.y AS y0, a.x AS x0, b.y, b.x, (a.y - b.y) ** 2 + (a.x - b.x) ** 2 + (a.f - b.f) ** 2 AS d2 FROM p a JOIN p b ON abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3),
    den AS (SELECT y0 AS y, x0 AS x, round(sum(exp(-d2 / 2)), 9) AS density FROM near GROUP BY 1, 2),
    up AS (SELECT n.y0, n.x0, n.y, n.x, n.d2 FROM near n JOIN den a ON a.y = n.y0 AND a.x = n.x0 JOIN den b ON b.y = n.y AND b.x = n.x
           WHERE n.d2 <= 9 AND (b.density > a.density OR b.density = a.density AND (n.y < n.y0 OR n.y = n.y0 AND n.x < n.x0))
           QUALIFY row_number() OVER (PARTITION BY n.y0, n.x0 ORDER BY n.d2, n.y, n.x) = 1),
    qs AS (SELECT den.y, den.x, density, coalesce(up.y, den.y) AS parent_y, coalesce(up.x, den.x) AS parent_x, coalesce(sqrt(d2), 1e9) AS gap FROM den LEFT JOIN up ON up.y0 = den.y AND up.x0 = den.x)"""

_RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]

_PLACES_SQL = f"{GRID_SQL}, p AS (SELECT y, x, y * 0.9::DOUBLE + 0.53::DOUBLE AS wy, x * 0.8::DOUBLE + 2.27::DOUBLE AS wx FROM g)"
_KEYS = lambda d: f"CASE WHEN abs({d}) <= 1 THEN 1.5::DOUBLE * abs({d}) ** 3 - 2.5::DOUBLE * abs({d}) ** 2 + 1 WHEN abs({d}) < 2 THEN -0.5::DOUBLE * abs({d}) ** 3 + 2.5::DOUBLE * abs({d}) ** 2 - 4 * abs({d}) + 2 ELSE 0 END"
_WHOLE = lambda n, e: f"round(CASE WHEN count(g.v) = count(*) THEN sum({e} * g.v) ELSE 'nan'::DOUBLE END, 4) AS {n}"

ORACLE_SQL = {
    "image_warp_cubic": f"""
        WITH {_PLACES_SQL}, c AS (SELECT y, x, wy, wx, (floor(wy) + a.i - 1)::INT AS cy, (floor(wx) + b.i - 1)::INT AS cx FROM p, range(4) a(i), range(4) b(i)),
        k AS (SELECT y, x, cy, cx, ({_KEYS('(wy - cy)')}) * ({_KEYS('(wx - cx)')}) AS w FROM c)
        SELECT k.y, k.x, {_WHOLE('v', 'w')} FROM k LEFT JOIN g ON g.y = cy AND g.x = cx WHERE w <> 0 GROUP BY 1, 2""",
    "image_warp_slopes": f"""
        WITH {_PLACES_SQL}, c AS (SELECT y, x, a.i AS i, b.i AS j, wy - floor(wy) AS fy, wx - floor(wx) AS fx, (floor(wy) + a.i)::INT AS cy, (floor(wx) + b.i)::INT AS cx FROM p, range(2) a(i), range(2) b(i)),
        k AS (SELECT y, x, cy, cx, 2 * i - 1 AS sy, 2 * j - 1 AS sx, CASE i WHEN 1 THEN fy ELSE 1 - fy END AS ay, CASE j WHEN 1 THEN fx ELSE 1 - fx END AS ax FROM c)
        SELECT k.y, k.x, {_WHOLE('v', 'ay * ax')}, {_WHOLE('vy', 'sy * ax')}, {_WHOLE('vx', 'ay * sx')} FROM k LEFT JOIN g ON g.y = cy AND g.x = cx GROUP BY 1, 2""",
    "labelled_sequence": f"""
        WITH {TRACKS_SQL}, e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM t)
        SELECT track_id, frame, round(2 * (x - lx) / (hx - lx) - 1, 8) AS x, round(CASE WHEN hy > ly THEN 2 * (y - ly) / (hy - ly) - 1 ELSE 0 END, 8) AS y, track_id % 3 AS label, y > 1 AS seen FROM t, e""",
    "image_distance_transform": f"WITH {GRID_SQL} SELECT a.y, a.x, round(min(b.v + 800.0::DOUBLE * (a.y - b.y) ** 2 + 500.0::DOUBLE * (a.x - b.x) ** 2), 4) AS v FROM g a, g b GROUP BY 1, 2",
    "image_up": f"""
        WITH {GRID_SQL}, t(dy, dx, w) AS (VALUES (-1, -1, .25), (-1, 0, .5), (-1, 1, .25), (0, -1, .5), (0, 0, 1.), (0, 1, .5), (1, -1, .25), (1, 0, .5), (1, 1, .25))
        SELECT 2 * y + dy AS y, 2 * (x - 1) + dx AS x, round(sum(w::DOUBLE * v) / sum(w::DOUBLE), 4) AS v FROM g, t WHERE 2 * y + dy >= 0 AND 2 * (x - 1) + dx >= 0 GROUP BY 1, 2""",
    "image_blend": f"WITH {GRID_SQL} SELECT y, x, CASE WHEN x < 10 THEN v WHEN x > 20 THEN 2.0::DOUBLE * v ELSE 1.5::DOUBLE * v END::DOUBLE AS v FROM g",
    "image_patterns": f"""
        WITH {GRID_SQL}, t(dy, dx, bit) AS (VALUES {", ".join(f"({a}, {b}, {1 << i})" for i, (a, b) in enumerate(_RING))}),
        p AS (SELECT a.y, a.x, sum(CASE WHEN b.v >= a.v THEN bit ELSE 0 END)::BIGINT AS pattern FROM g a CROSS JOIN t JOIN g b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2 HAVING count(*) = 8)
        SELECT floor(y / 8)::INT AS cy, floor(x / 8)::INT AS cx, pattern, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "image_harris": f"""
        WITH {GRID_SQL}, q AS (SELECT y, x, v / 10000.0 AS v FROM g), gr AS (SELECT y, x, {_sql_slope("x")}, {_sql_slope("y")} FROM q WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)),
        w(o, wt) AS (VALUES {_TAPS}), t AS (SELECT y, x, gx * gx AS a, gy * gy AS b, gx * gy AS c FROM gr),
        tx AS (SELECT k.y, k.x, sum(wt * t.a) AS a, sum(wt * t.b) AS b, sum(wt * t.c) AS c FROM t k CROSS JOIN w JOIN t ON t.y = k.y AND t.x = greatest(1, least(31, k.x + o)) GROUP BY 1, 2),
        ty AS (SELECT k.y, k.x, sum(wt * t.a) AS a, sum(wt * t.b) AS b, sum(wt * t.c) AS c FROM tx k CROSS JOIN w JOIN tx t ON t.x = k.x AND t.y = greatest(0, least(23, k.y + o)) GROUP BY 1, 2)
        SELECT y, x, round(a * b - c * c - 0.04::DOUBLE * (a + b) ** 2, 3) AS r FROM ty""",
    "image_warp": f"""
        WITH {GRID_SQL}, p AS (SELECT y, x, y * 0.9::DOUBLE + 0.5::DOUBLE AS wy, x * 0.8::DOUBLE + 2.25::DOUBLE AS wx FROM g), b(a) AS (VALUES (0), (1)),
        c AS (SELECT y, x, (floor(wy) + ya.a)::INT AS cy, (floor(wx) + xa.a)::INT AS cx, CASE ya.a WHEN 0 THEN 1 - (wy - floor(wy)) ELSE wy - floor(wy) END * CASE xa.a WHEN 0 THEN 1 - (wx - floor(wx)) ELSE wx - floor(wx) END AS w FROM p, b ya, b xa)
        SELECT c.y, c.x, round(CASE WHEN count(g.v) = count(*) THEN sum(w * g.v) ELSE 'nan'::DOUBLE END, 4) AS v FROM c LEFT JOIN g ON g.y = cy AND g.x = cx WHERE w > 0 GROUP BY 1, 2""",
    "stream_tracks": """
        WITH t AS (SELECT user_id AS track_id, floor((epoch_us(ts) - 1704067200000000) / 3600000000)::BIGINT + 1 AS frame, epoch_ms(ts) AS ms FROM events),
        d AS (SELECT track_id, frame, max(ms) AS ms, coalesce(frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) > 24, false)::INT AS cut FROM t GROUP BY track_id, frame),
        n AS (SELECT *, sum(cut) OVER (PARTITION BY track_id ORDER BY frame) AS part FROM d),
        s AS (SELECT track_id, part, min(frame) AS head, max(frame) AS tail, max(ms) AS ms FROM n GROUP BY 1, 2)
        SELECT track_id, head, tail, tail - head + 1 AS len FROM s QUALIFY part < max(part) OVER (PARTITION BY track_id) OR ms + 48 * 3600000 < (SELECT max(ms) FROM t) - 3600000""",
    "quick_shift": f"WITH {_QUICK} SELECT y, x, round(density, 6) AS density, parent_y, parent_x, round(gap, 6) AS gap FROM qs",
    "medoid_shift": f"""
        WITH {GRID_SQL}, p AS (SELECT y, x, v / 100000.0 AS f FROM g),
        n AS (SELECT a.y AS y0, a.x AS x0, b.y, b.x, b.f, (a.y - b.y) ** 2 + (a.x - b.x) ** 2 + (a.f - b.f) ** 2 AS d2 FROM p a JOIN p b ON abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3),
        m AS (SELECT y0, x0, sum(exp(-d2 / 2) * y) / sum(exp(-d2 / 2)) AS my, sum(exp(-d2 / 2) * x) / sum(exp(-d2 / 2)) AS mx, sum(exp(-d2 / 2) * f) / sum(exp(-d2 / 2)) AS mf FROM n GROUP BY 1, 2)
        SELECT n.y0 AS y, n.x0 AS x, n.y AS parent_y, n.x AS parent_x, round(sqrt(d2), 6) AS gap FROM n JOIN m ON m.y0 = n.y0 AND m.x0 = n.x0
        QUALIFY row_number() OVER (PARTITION BY n.y0, n.x0 ORDER BY round((n.y - my) ** 2 + (n.x - mx) ** 2 + (n.f - mf) ** 2, 9), n.y, n.x) = 1""",
    "quick_segments": f"""
        WITH RECURSIVE {_QUICK}, par AS (SELECT y * 1000 + x AS node, CASE WHEN gap > 2 THEN y * 1000 + x ELSE parent_y * 1000 + parent_x END AS parent FROM qs),
        up_(node, at_) AS (SELECT node, parent FROM par UNION SELECT u.node, p.parent FROM up_ u JOIN par p ON p.node = u.at_ WHERE p.parent <> u.at_)
        SELECT up_.node, at_ AS root FROM up_ JOIN par p ON p.node = at_ AND p.parent = at_""",
    "stream_windows": """
        WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - o * INTERVAL 2 HOUR AS start, event_type, value FROM events, (VALUES (0), (1)) t(o))
        SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM w WHERE start + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
}
