"""Queries on trajectories, windows and layered paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import graphpath as G
from trackloom.operators import tracks as T
from trackloom.operators import windows as N
from trackloom.plans.stages import durable
from trackloom.plans.tables import TRACKS_SQL, table, user_tracks

#: Frames of the stand-in clip (hours of 30 days), and the size of its windows.
FRAMES, SIZE = 720, 40
LAYERS = 6
TYPES = ["click", "error", "purchase", "signup", "view"]


def lifespans(spark, sf_dir):
    return T.lifespans(user_tracks(spark, sf_dir))


def trimmed(spark, sf_dir):
    return T.trim(lifespans(spark, sf_dir), 500)


def alive_counts(spark, sf_dir):
    """Tracks alive at every frame and the next: the tracks list their own frames."""
    spans = lifespans(spark, sf_dir)
    return spans.select(F.explode(F.sequence("head", "tail")).alias("frame"), "head", "tail").where(T.alive(F.col("frame"))).groupBy("frame").agg(F.count("*").alias("n"))


def window_members(spark, sf_dir):
    return T.window_members(lifespans(spark, sf_dir), SIZE, FRAMES)


def frame_windows(spark, sf_dir):
    t = user_tracks(spark, sf_dir)
    windows = N.count_windows(F.col("frame") - 1, SIZE, N.n_count_windows(F.lit(FRAMES), SIZE))
    return t.select("track_id", F.explode(windows).alias("window")).groupBy("window").agg(F.count("*").alias("n"))


def steps(spark, sf_dir):
    return T.steps(user_tracks(spark, sf_dir)).select("track_id", "frame", "x", "y", "x2", "y2")


def _labels(spark, sf_dir):
    """A track's label in a window: its event count there, capped at 3; 0 if it has none."""
    t = user_tracks(spark, sf_dir)
    windows = N.count_windows(F.col("frame") - 1, SIZE, N.n_count_windows(F.lit(FRAMES), SIZE))
    seen = t.select("track_id", F.explode(windows).alias("window")).groupBy("track_id", "window").agg(F.least(F.count("*"), F.lit(3)).cast("int").alias("label"))
    return T.window_members(T.lifespans(t), SIZE, FRAMES).join(seen, ["track_id", "window"], "left").select("track_id", "window", F.coalesce("label", F.lit(0)).alias("label"))


def co_membership(spark, sf_dir):
    return T.co_membership(_labels(spark, sf_dir))


def background(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return T.background_verdict(labels, labels.where("label = 3"))


def relabelled(spark, sf_dir):
    return T.relabel_small_groups(_labels(spark, sf_dir), ["window"], "label", 40)


def robust(spark, sf_dir):
    t = user_tracks(spark, sf_dir).withColumn("hour", F.col("frame") % 24).select("hour", "x", F.struct("frame", "track_id").alias("o"))
    return T.robust_filter(t, ["hour"], "x", "o", 5).select("hour", "x", F.col("o.frame").alias("frame"), F.col("o.track_id").alias("track_id"), F.round("threshold", 4).alias("threshold"))


def in_frame(spark, sf_dir):
    return user_tracks(spark, sf_dir).where(T.in_frame(F.col("x"), F.col("y"), 20000.0, 3.0))


def repeats_dropped(spark, sf_dir):
    return T.drop_repeats(user_tracks(spark, sf_dir), ["track_id"], "frame", 500.0)


def band_smooth(spark, sf_dir):
    hourly = user_tracks(spark, sf_dir).groupBy("frame").agg(F.sum("x").alias("x")).withColumn("clip", F.lit(1))
    return N.band_smooth(hourly, ["clip"], "frame", "x", 30, 10.0).select("frame", "x", F.round("smooth", 4).alias("smooth"))


def band_affinity(spark, sf_dir):
    hourly = user_tracks(spark, sf_dir).groupBy("frame").agg((F.sum("x") / 100).alias("x"), F.sum("y").alias("y")).withColumn("clip", F.lit(1))
    return N.band_affinity(hourly, ["clip"], "frame", "x", "y", 5).select("t", "r", F.round("w", 8).alias("w"))


def local_maxima_1d(spark, sf_dir):
    return N.local_maxima_1d(user_tracks(spark, sf_dir), ["track_id"], "frame", "x", 100)


def mesh_votes(spark, sf_dir):
    row, col = S.cell_of(F.col("x"), F.col("frame"), 6250.0, 90.0, 8)
    return user_tracks(spark, sf_dir).groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


def projected(spark, sf_dir):
    """Points through a fixed projective map and back."""
    h = F.array(*map(F.lit, [1.1, 0.02, 5.0, -0.03, 0.95, 7.0, 0.00001, 0.00002, 1.0]))
    x, y = S.homography_point(F.col("x"), F.col("frame"), h)
    return user_tracks(spark, sf_dir).select("track_id", "frame", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


def normalised(spark, sf_dir):
    """Centroid, mean distance and isotropic scale of every track: two passes of averages."""
    t = user_tracks(spark, sf_dir).select("track_id", F.col("x").cast("double"), F.col("frame").cast("double").alias("y"))
    mid = t.groupBy("track_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return t.join(mid, "track_id").groupBy("track_id", "cx", "cy").agg(F.avg(d).alias("m")).where("m > 0").select("track_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(F.sqrt(F.lit(2.0)) / F.col("m"), 9).alias("scale"))


def special_functions(spark, sf_dir):
    x = F.col("value") / 100 - 2
    return table(spark, sf_dir, "events").select("event_id", *(F.round(c, 9).alias(n) for n, c in (("g", S.gaussian(x)), ("dg", S.d_gaussian(x)), ("ddg", S.dd_gaussian(x)), ("s", S.sigmoid(x)), ("ds", S.d_sigmoid(x)), ("rcos", S.raised_cosine(0.5, x)))))


def _layered(spark, sf_dir):
    """Edges between event types of successive five-day windows for the two halves of the users
    (``video`` 0 and 1), and links between the halves in a window."""
    ev = table(spark, sf_dir, "events").select(F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("k"), (F.col("user_id") % 2).cast("int").alias("video"), "user_id", (F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).cast("int").alias("s")).where(f"k < {LAYERS}").distinct()
    ahead = ev.select((F.col("k") - 1).alias("k"), "video", "user_id", F.col("s").alias("t"))
    edges = ev.join(ahead, ["k", "video", "user_id"]).groupBy("video", "k", "s", "t").agg((1 / (1 + F.count("*"))).alias("w"))
    n = ev.groupBy("k", "video", "s").agg(F.count("*").alias("n"))
    links = n.where("video = 0").select("k", "s", F.col("n").alias("a")).join(n.where("video = 1").select("k", F.col("s").alias("t"), F.col("n").alias("b")), "k").select("k", "s", "t", (F.abs(F.col("a") - F.col("b")) / 100.0).alias("w"))
    return durable(edges), durable(links)


def _nodes(edges):
    return edges.select("k", "s").union(edges.select((F.col("k") + 1).alias("k"), F.col("t").alias("s"))).distinct()


def _single(forward):
    def run(spark, sf_dir):
        edges, _ = _layered(spark, sf_dir)
        edges = edges.where("video = 0").drop("video")
        return G.single_paths(edges, _nodes(edges), LAYERS, forward).select("k", "s", F.round("dist", 8).alias("dist"))

    return run


def through_node(spark, sf_dir):
    edges, _ = _layered(spark, sf_dir)
    edges = edges.where("video = 0").drop("video")
    nodes = _nodes(edges)
    return G.through_node(G.single_paths(edges, nodes, LAYERS), G.single_paths(edges, nodes, LAYERS, False)).select("k", "s", F.round("dist", 8).alias("dist"))


def coupled_paths(spark, sf_dir):
    edges, links = _layered(spark, sf_dir)
    a, b = (edges.where(f"video = {v}").drop("video") for v in (0, 1))
    return G.coupled_paths(a, b, links, LAYERS).select("k", "s", "t", F.round("dist", 8).alias("dist"))


def best_coupled_path(spark, sf_dir):
    edges, links = _layered(spark, sf_dir)
    a, b = (edges.where(f"video = {v}").drop("video") for v in (0, 1))
    best = G.best_path(G.coupled_paths(a, b, links, LAYERS), LAYERS - 1)
    return best.select(F.round("dist", 8).alias("dist"), F.array_join("path_a", ",").alias("path_a"), F.array_join("path_b", ",").alias("path_b"))


def nearest_label(spark, sf_dir):
    edges, _ = _layered(spark, sf_dir)
    return G.nearest_label(edges.where("video = 0")).select("k", "s", "t", F.round("w", 8).alias("w"))


def good_labels(spark, sf_dir):
    edges, _ = _layered(spark, sf_dir)
    edges = edges.where("video = 0").drop("video")
    nodes = _nodes(edges)
    ahead, back = G.single_paths(edges, nodes, LAYERS), G.single_paths(edges, nodes, LAYERS, False)
    through = durable(G.through_node(ahead, back))
    best = through.agg(F.min("dist")).first()[0] or 0.0
    return G.good_labels(through, edges, best, 1.5, 0.0)


def every_path(spark, sf_dir):
    """The cheapest of all pairs of paths through three windows, found by writing them all out."""
    edges, links = _layered(spark, sf_dir)
    a, b = (edges.where(f"video = {v}").drop("video") for v in (0, 1))
    every = G.every_path(a, b, links, 3)
    return every.agg(F.count("*").alias("n"), F.round(F.min("dist"), 8).alias("dist"))


QUERIES = {
    "every_path": every_path,
    "track_lifespans": lifespans, "track_trim": trimmed, "track_alive": alive_counts, "track_windows": window_members, "frame_windows": frame_windows, "track_steps": steps,
    "label_co_membership": co_membership, "background_verdict": background, "relabel_small_groups": relabelled, "robust_filter": robust, "in_frame": in_frame, "repeats_dropped": repeats_dropped,
    "band_smooth": band_smooth, "band_affinity": band_affinity, "local_maxima_1d": local_maxima_1d, "mesh_votes": mesh_votes, "projected_points": projected, "normalised_points": normalised,
    "special_functions": special_functions, "paths_forward": _single(True), "paths_backward": _single(False), "paths_through_node": through_node, "coupled_paths": coupled_paths,
    "best_coupled_path": best_coupled_path, "nearest_label": nearest_label, "good_labels": good_labels,
}

_SPANS = f"{TRACKS_SQL}, l AS (SELECT track_id, min(frame) AS head, max(frame) AS tail, max(frame) - min(frame) + 1 AS len FROM t GROUP BY 1)"
_MID = f"(w * 20 + 1 + least(w * 20 + {SIZE}, {FRAMES})) / 2.0"
_MEMBERS = f"{_SPANS}, m AS (SELECT track_id, w::INT AS window FROM l, range(35) r(w) WHERE head < {_MID} AND tail > {_MID} AND len > 20)"
_FRAME_WINDOWS = "f AS (SELECT track_id, w::INT AS window FROM t, range(35) r(w) WHERE frame - 1 >= w * 20 AND frame - 1 < w * 20 + 40)"
_LABELS = f'{_MEMBERS}, {_FRAME_WINDOWS}, c AS (SELECT track_id, "window", least(count(*), 3)::INT AS label FROM f GROUP BY 1, 2), lab AS (SELECT track_id, "window", coalesce(label, 0) AS label FROM m LEFT JOIN c USING (track_id, "window"))'
_NUMBER = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"
_LAYERED = f"""ev AS (SELECT DISTINCT floor((day(ts) - 1) / 5)::INT AS k, (user_id % 2)::INT AS video, user_id, {_NUMBER} AS s FROM events WHERE day(ts) <= 30),
    edges AS (SELECT a.video, a.k, a.s, b.s AS t, 1 / (1 + count(*)) AS w FROM ev a JOIN ev b ON b.k = a.k + 1 AND b.video = a.video AND b.user_id = a.user_id GROUP BY ALL),
    n AS (SELECT k, video, s, count(*) AS n FROM ev GROUP BY ALL),
    links AS (SELECT a.k, a.s, b.s AS t, abs(a.n - b.n) / 100.0 AS w FROM n a JOIN n b ON a.k = b.k AND a.video = 0 AND b.video = 1)"""


def _unrolled(forward: bool, name: str) -> str:
    first = 0 if forward else LAYERS - 1
    node = f"(SELECT s FROM edges WHERE video = 0 AND k = {first})" if forward else f"(SELECT t AS s FROM edges WHERE video = 0 AND k = {first - 1})"
    out = [f"{name}{first} AS (SELECT DISTINCT s, 0.0::DOUBLE AS dist FROM {node})"]
    for i in range(1, LAYERS):
        k = first + i * (1 if forward else -1)
        if forward:
            out.append(f"{name}{k} AS (SELECT e.t AS s, min(p.dist + e.w) AS dist FROM {name}{k - 1} p JOIN edges e ON e.video = 0 AND e.k = {k - 1} AND e.s = p.s GROUP BY 1)")
        else:
            out.append(f"{name}{k} AS (SELECT e.s, min(p.dist + e.w) AS dist FROM {name}{k + 1} p JOIN edges e ON e.video = 0 AND e.k = {k} AND e.t = p.s GROUP BY 1)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, s, dist FROM {name}{k}" for k in range(LAYERS))
    return ", ".join(out) + f", {name} AS ({every})"


def _unrolled_coupled() -> str:
    out = ["q0 AS (SELECT s, t, w AS dist, [s] AS pa, [t] AS pb FROM links WHERE k = 0)"]
    for k in range(1, LAYERS):
        ways = f"SELECT a.t AS s, b.t AS t, q.dist + a.w + b.w + l.w AS dist, list_append(q.pa, a.t) AS pa, list_append(q.pb, b.t) AS pb FROM q{k - 1} q JOIN edges a ON a.video = 0 AND a.k = {k - 1} AND a.s = q.s JOIN edges b ON b.video = 1 AND b.k = {k - 1} AND b.s = q.t JOIN links l ON l.k = {k} AND l.s = a.t AND l.t = b.t"
        out.append(f"q{k} AS (SELECT s, t, dist, pa, pb FROM ({ways}) QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY dist, pa, pb) = 1)")
    return ", ".join(out)


ORACLE_SQL = {
    "track_lifespans": f"WITH {_SPANS} SELECT track_id, head, tail, len FROM l",
    "track_trim": f"WITH {_SPANS} SELECT track_id, head, least(tail, 500) AS tail, least(tail, 500) - head + 1 AS len FROM l WHERE head <= 500",
    "track_alive": f"WITH {_SPANS} SELECT f::INT AS frame, count(*) AS n FROM range(1, 721) r(f) JOIN l ON head <= f AND tail > f GROUP BY 1",
    "track_windows": f'WITH {_MEMBERS} SELECT track_id, "window" FROM m',
    "frame_windows": f'WITH {TRACKS_SQL}, {_FRAME_WINDOWS} SELECT "window", count(*) AS n FROM f GROUP BY 1',
    "track_steps": f"WITH {TRACKS_SQL} SELECT a.track_id, a.frame, a.x, a.y, b.x AS x2, b.y AS y2 FROM t a JOIN t b ON b.track_id = a.track_id AND b.frame = a.frame + 1",
    "label_co_membership": f'WITH {_LABELS} SELECT a."window", a.label AS u, b.label AS v, count(*) AS n, CASE WHEN count(*) < 10 THEN 1e8::DOUBLE END AS pruned FROM lab a JOIN lab b ON a.track_id = b.track_id AND b."window" = a."window" + 1 GROUP BY 1, 2, 3',
    "background_verdict": f"""
        WITH {_LABELS}, v AS (SELECT track_id, count(*) FILTER (label <> 0) AS seen, count(*) FILTER (label = 3) AS good FROM lab GROUP BY 1)
        SELECT track_id, seen, good, CASE WHEN seen = 0 THEN 0 WHEN good >= ceil(seen * 0.7::DOUBLE) THEN 1 ELSE -1 END AS verdict FROM v""",
    "relabel_small_groups": f"""
        WITH {_LABELS}, n AS (SELECT "window", label, count(*) AS n FROM lab GROUP BY 1, 2), b AS (SELECT "window", label, dense_rank() OVER (PARTITION BY "window" ORDER BY label) AS r FROM n WHERE n > 40),
        o AS (SELECT "window", max(r) AS k FROM b GROUP BY 1)
        SELECT lab."window", lab.label, track_id, coalesce(r, coalesce(k, 0) + 1)::INT AS new_label FROM lab LEFT JOIN b USING ("window", label) LEFT JOIN o USING ("window")""",
    "robust_filter": f"""
        WITH {TRACKS_SQL}, h AS (SELECT track_id, frame, frame % 24 AS hour, x FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY x, frame, track_id) AS r, count(*) OVER (PARTITION BY hour) AS n FROM h),
        l AS (SELECT hour, 2 * avg(x) FILTER (r >= greatest(floor(n * 2 / 5), 1) AND r <= floor(n * 16 / 20)) + 10 AS threshold FROM r GROUP BY 1)
        SELECT hour, x, frame, track_id, round(threshold, 4) AS threshold FROM h JOIN l USING (hour) WHERE x <= threshold QUALIFY count(*) OVER (PARTITION BY hour) >= 5""",
    "in_frame": f"WITH {TRACKS_SQL} SELECT * FROM t WHERE x > 0 AND x < 20000 AND y > 0 AND y < 3",
    "repeats_dropped": f"""
        WITH {TRACKS_SQL}, n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
        SELECT track_id, frame, x, y FROM n WHERE NOT coalesce(abs(x - x2) < 500 AND abs(y - y2) < 500, false)""",
    "band_smooth": f"""
        WITH {TRACKS_SQL}, h AS (SELECT frame, sum(x)::BIGINT AS x FROM t GROUP BY 1)
        SELECT a.frame, a.x, round(sum(exp(-((a.frame - b.frame) ** 2) / 200.0) * b.x) / sum(exp(-((a.frame - b.frame) ** 2) / 200.0)), 4) AS smooth FROM h a JOIN h b ON b.frame <> a.frame AND abs(a.frame - b.frame) <= 30 GROUP BY 1, 2""",
    "band_affinity": f"""
        WITH {TRACKS_SQL}, h AS (SELECT frame, sum(x) / 100 AS x, sum(y) AS y FROM t GROUP BY 1)
        SELECT a.frame AS t, b.frame AS r, round(exp(-((a.frame - b.frame) ** 2) / 200.0) * exp(-((abs(a.x - b.x) + abs(a.y - b.y)) ** 2) / 320000.0), 8) AS w FROM h a JOIN h b ON b.frame <> a.frame AND abs(a.frame - b.frame) <= 5""",
    "local_maxima_1d": f"""
        WITH {TRACKS_SQL}, n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
        SELECT track_id, frame, x, y FROM n WHERE x > a AND x > b AND x >= 100""",
    "mesh_votes": f"WITH {TRACKS_SQL} SELECT least(greatest(floor(frame / 90) + 1, 1), 8)::INT AS row, least(greatest(floor(x / 6250) + 1, 1), 8)::INT AS col, count(*) AS n FROM t GROUP BY 1, 2",
    "projected_points": f"""
        WITH {TRACKS_SQL}, p AS (SELECT *, 0.00001::DOUBLE * x + 0.00002::DOUBLE * frame + 1 AS w FROM t)
        SELECT track_id, frame, round((1.1::DOUBLE * x + 0.02::DOUBLE * frame + 5) / w, 6) AS px, round((-0.03::DOUBLE * x + 0.95::DOUBLE * frame + 7) / w, 6) AS py FROM p""",
    "normalised_points": f"""
        WITH {TRACKS_SQL}, c AS (SELECT track_id, avg(x) AS cx, avg(frame) AS cy FROM t GROUP BY 1)
        SELECT track_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(2) / avg(sqrt((x - cx) ** 2 + (frame - cy) ** 2)), 9) AS scale FROM t JOIN c USING (track_id) GROUP BY track_id, c.cx, c.cy HAVING avg(sqrt((x - cx) ** 2 + (frame - cy) ** 2)) > 0""",
    "special_functions": """
        WITH v AS (SELECT event_id, value / 100 - 2 AS x FROM events), g AS (SELECT *, exp(-0.5::DOUBLE * x * x) / sqrt(2 * pi()) AS g, 1 / (1 + exp(-x)) AS s FROM v)
        SELECT event_id, round(g, 9) AS g, round(-x * g, 9) AS dg, round((x * x - 1) * g, 9) AS ddg, round(s, 9) AS s, round(s * (1 - s), 9) AS ds,
               round(CASE WHEN abs(x) < 0.5 THEN 1 WHEN abs(x) <= 1 THEN 0.5::DOUBLE * (1 + cos(pi() * (0.5::DOUBLE - abs(x)) / 0.5::DOUBLE)) ELSE 0 END, 9) AS rcos FROM g""",
    "paths_forward": f"WITH {_LAYERED}, {_unrolled(True, 'p')} SELECT k, s, round(dist, 8) AS dist FROM p",
    "paths_backward": f"WITH {_LAYERED}, {_unrolled(False, 'p')} SELECT k, s, round(dist, 8) AS dist FROM p",
    "paths_through_node": f"WITH {_LAYERED}, {_unrolled(True, 'p')}, {_unrolled(False, 'b')} SELECT k, s, round(p.dist + b.dist, 8) AS dist FROM p JOIN b USING (k, s)",
    "coupled_paths": f"WITH {_LAYERED}, {_unrolled_coupled()} " + " UNION ALL ".join(f"SELECT {k} AS k, s, t, round(dist, 8) AS dist FROM q{k}" for k in range(LAYERS)),
    "best_coupled_path": f"WITH {_LAYERED}, {_unrolled_coupled()} SELECT round(dist, 8) AS dist, array_to_string(pa, ',') AS path_a, array_to_string(pb, ',') AS path_b FROM q{LAYERS - 1} ORDER BY q{LAYERS - 1}.dist, pa, pb LIMIT 1",
    "good_labels": f"""
        WITH {_LAYERED}, {_unrolled(True, 'p')}, {_unrolled(False, 'b')}, th AS (SELECT k, s, p.dist + b.dist AS dist FROM p JOIN b USING (k, s)),
        ch AS (SELECT k, s FROM th WHERE dist < 1.5::DOUBLE * (SELECT min(dist) FROM th)),
        fw AS (SELECT k, s, t FROM edges WHERE video = 0 QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY w, t) = 1),
        bw AS (SELECT k + 1 AS k, t AS s, s AS p FROM edges WHERE video = 0 QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY w, s) = 1)
        SELECT k, s FROM ch UNION SELECT fw.k + 1, fw.t FROM fw JOIN ch USING (k, s) UNION SELECT bw.k - 1, bw.p FROM bw JOIN ch USING (k, s)""",
    "every_path": f"""
        WITH {_LAYERED} SELECT count(*) AS n, round(min(l0.w + a0.w + b0.w + l1.w + a1.w + b1.w + l2.w), 8) AS dist FROM links l0
        JOIN edges a0 ON a0.video = 0 AND a0.k = 0 AND a0.s = l0.s JOIN edges b0 ON b0.video = 1 AND b0.k = 0 AND b0.s = l0.t JOIN links l1 ON l1.k = 1 AND l1.s = a0.t AND l1.t = b0.t
        JOIN edges a1 ON a1.video = 0 AND a1.k = 1 AND a1.s = l1.s JOIN edges b1 ON b1.video = 1 AND b1.k = 1 AND b1.s = l1.t JOIN links l2 ON l2.k = 2 AND l2.s = a1.t AND l2.t = b1.t WHERE l0.k = 0""",
    "nearest_label": f"WITH {_LAYERED} SELECT k, s, t, round(w, 8) AS w FROM edges WHERE video = 0 QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY w, t) = 1",
}
