"""Queries on binning and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import binning as B
from trackloom.operators import encode as E
from trackloom.operators import windows as N
from trackloom.plans.tables import DENSE_SQL, GRID_SQL, day_grid, dense, table

EDGES = [0.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0]
TYPES = ["click", "error", "purchase", "signup", "view"]
#: A merge tree over five leaves (1 to 5): 6 = 1 + 2, 7 = 3 + 4, 8 = 6 + 7, 9 = 5 + 8.
MERGES = [(1, 6), (2, 6), (3, 7), (4, 7), (5, 9), (6, 8), (7, 8), (8, 9), (9, 0)]
CUT = [(1, 1), (2, 1), (3, 2), (4, 0)]
BOXES = [("all", 0, 1, 23, 31), ("morning", 6, 1, 11, 15), ("point", 12, 10, 12, 10), ("empty", 5, 5, 4, 9)]

_BIN = "CASE WHEN isnan(value) THEN 0 ELSE " + " + ".join(f"(value >= {e})::INT" for e in EDGES) + " END"
_TYPE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " ELSE 0 END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _type_number():
    found = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type"))
    return F.coalesce(found, F.lit(0)).cast("int")


def bin_search(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", B.bin_search(F.col("value"), EDGES).alias("bin"))


def bin_sum(spark, sf_dir):
    acc = spark.range(1, len(EDGES) + 1).select(F.col("id").cast("int").alias("bin"), (F.col("id") * 10).alias("h"))
    obs = _events(spark, sf_dir).select(B.bin_search(F.col("value"), EDGES).alias("bin"), F.round(F.col("value") * 100).cast("long").alias("x"))
    return B.bin_sum(acc, obs)


def weighted_histogram(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return B.weighted_histogram(line, F.col("l_quantity"), F.col("l_linenumber").cast("double"), [1.0, 5.0, 10.0, 20.0, 40.0, 50.0])


def grid_votes(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return B.grid_votes(ev, F.col("value"), F.hour("ts") + F.lit(0.5), 500.0, 24.0, 8)


def histogram_marginal(spark, sf_dir):
    cube = _events(spark, sf_dir).groupBy("event_type", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("h"))
    return B.marginal(cube, ["event_type", "hour"])


def label_counts(spark, sf_dir):
    labels = _events(spark, sf_dir).select(_type_number().alias("d1"), F.hour("ts").alias("d2"))
    return B.label_counts(labels, ["d1", "d2"])


def label_lookup(spark, sf_dir):
    labels = _events(spark, sf_dir).select(_type_number().alias("d1"), F.hour("ts").alias("d2"))
    wanted = spark.range(0, 6 * 26).select((F.col("id") / 26).cast("int").alias("d1"), (F.col("id") % 26).cast("int").alias("d2"))
    return B.label_lookup(wanted, B.label_counts(labels, ["d1", "d2"]), ["d1", "d2"])


def tree_histogram(spark, sf_dir):
    return B.tree_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def merge_tree_histogram(spark, sf_dir):
    parents = spark.createDataFrame(MERGES, "node int, parent int")
    return B.merge_tree_histogram(parents, _events(spark, sf_dir).select(_type_number().alias("x")))


def _cut(nulls):
    def run(spark, sf_dir):
        cut = spark.createDataFrame(CUT, "x int, cluster int")
        return B.cut_histogram(cut, _events(spark, sf_dir).select(_type_number().alias("x")), 2, nulls)

    return run


def integral_image(spark, sf_dir):
    return B.integral_image(day_grid(spark, sf_dir)).select("y", "x", "v", "s")


def _labels(spark, sf_dir):
    return _events(spark, sf_dir).select(F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x"), _type_number().alias("label"))


def integral_histogram(spark, sf_dir):
    return B.integral_histogram(_labels(spark, sf_dir).union(dense(spark).withColumn("label", F.lit(0))))


def sample_integral(spark, sf_dir):
    boxes = spark.createDataFrame(BOXES, "box string, y0 int, x0 int, y1 int, x1 int")
    return B.sample_integral(integral_histogram(spark, sf_dir), boxes, ["label"])


def gradient(spark, sf_dir):
    return N.gradient(day_grid(spark, sf_dir), ["y"], "x", "v").select("y", "x", "v", "g")


def local_maxima(spark, sf_dir):
    return N.local_maxima_2d(day_grid(spark, sf_dir), "v", 1000)


def blurred(spark, sf_dir):
    w = [0.25, 0.5, 0.25]
    grid = day_grid(spark, sf_dir)
    return N.smooth_rows(N.smooth_rows(grid, "x", "y", "v", w), "y", "x", "v", w).select("y", "x", F.round("v", 4).alias("v"))


def downsampled(spark, sf_dir):
    return day_grid(spark, sf_dir).groupBy(F.floor(F.col("y") / 2).alias("y"), F.floor((F.col("x") - 1) / 2).alias("x")).agg(F.round(F.avg("v"), 4).alias("v"))


def segment_means(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "event_type", (F.col("value") / 500).alias("v"))
    return E.segment_means(ev, ["event_type"], "v").select("event_id", F.round("v", 8).alias("v"))


def rescaled(spark, sf_dir):
    return E.rescale(_events(spark, sf_dir).select("event_id", "value"), "value").select("event_id", F.round("value", 8).alias("value"))


QUERIES = {
    "bin_search": bin_search, "bin_sum": bin_sum, "weighted_histogram": weighted_histogram, "grid_votes": grid_votes, "histogram_marginal": histogram_marginal,
    "label_counts": label_counts, "label_lookup": label_lookup, "tree_histogram": tree_histogram, "merge_tree_histogram": merge_tree_histogram,
    "cut_histogram_drop": _cut("drop"), "cut_histogram_append": _cut("append"), "cut_histogram_first": _cut("first"),
    "integral_image": integral_image, "integral_histogram": integral_histogram, "sample_integral": sample_integral, "gradient": gradient, "local_maxima": local_maxima,
    "image_smooth": blurred, "image_down": downsampled, "segment_means": segment_means, "image_rescale": rescaled,
}

_CUT_SQL = """
WITH m AS (SELECT {type} AS x FROM events), c(x, cluster) AS (VALUES (1, 1), (2, 1), (3, 2), (4, 0)),
k AS (SELECT {cluster} AS cluster FROM m LEFT JOIN c USING (x))
SELECT r.cluster::INT AS cluster, count(k.cluster) AS n FROM range(1, {last} + 1) r(cluster) LEFT JOIN k ON k.cluster = r.cluster GROUP BY 1
"""

ORACLE_SQL = {
    "bin_search": f"SELECT event_id, {_BIN} AS bin FROM events",
    "bin_sum": f"WITH o AS (SELECT {_BIN} AS bin, round(value * 100)::BIGINT AS x FROM events) SELECT r.bin::INT AS bin, r.bin * 10 + coalesce(sum(x), 0)::BIGINT AS h FROM range(1, 8) r(bin) LEFT JOIN o ON o.bin = r.bin GROUP BY r.bin",
    "weighted_histogram": """
        WITH k AS (SELECT (l_quantity >= 1)::INT + (l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT + (l_quantity >= 50)::INT AS bin, l_quantity, l_linenumber FROM lineitem)
        SELECT r.bin::INT AS bin, coalesce(sum(l_linenumber), 0)::DOUBLE AS h FROM range(1, 7) r(bin) LEFT JOIN k ON k.bin = r.bin AND NOT (k.bin = 6 AND l_quantity > 50) GROUP BY r.bin""",
    "grid_votes": """
        WITH v AS (SELECT floor((hour(ts) + 0.5) / 3)::INT AS row, floor(value / 62.5)::INT AS col FROM events)
        SELECT (i // 8)::INT AS row, (i % 8)::INT AS col, count(v.row) AS votes FROM range(64) r(i) LEFT JOIN v ON v.row = i // 8 AND v.col = i % 8 GROUP BY i""",
    "histogram_marginal": "SELECT event_type, hour(ts)::INT AS hour, count(*) AS h FROM events GROUP BY 1, 2",
    "label_counts": f"WITH l AS (SELECT {_TYPE} AS d1, hour(ts)::INT AS d2 FROM events) SELECT d1, d2, count(*) AS n FROM l WHERE NOT (d1 = 0 AND d2 = 0) GROUP BY 1, 2",
    "label_lookup": f"""
        WITH l AS (SELECT {_TYPE} AS d1, hour(ts)::INT AS d2 FROM events), c AS (SELECT d1, d2, count(*) AS n FROM l WHERE NOT (d1 = 0 AND d2 = 0) GROUP BY 1, 2),
        q AS (SELECT (i // 26)::INT AS d1, (i % 26)::INT AS d2 FROM range(156) r(i))
        SELECT d1, d2, coalesce(n, 0) AS n FROM q LEFT JOIN c USING (d1, d2)""",
    "tree_histogram": """
        SELECT (3 - bit_count(grouping_id(l_returnflag, l_linestatus, l_linenumber)))::INT AS depth, l_returnflag, l_linestatus, l_linenumber, count(*) AS n
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""",
    "merge_tree_histogram": f"""
        WITH RECURSIVE p(node, parent) AS (VALUES (1, 6), (2, 6), (3, 7), (4, 7), (5, 9), (6, 8), (7, 8), (8, 9), (9, 0)),
        up AS (SELECT node, node AS ancestor FROM p UNION SELECT up.node, p.parent FROM up JOIN p ON p.node = up.ancestor WHERE p.parent <> 0),
        d AS (SELECT {_TYPE} AS x FROM events)
        SELECT p.node, count(d.x) AS n FROM p JOIN up ON up.ancestor = p.node LEFT JOIN d ON d.x = up.node GROUP BY p.node""",
    "cut_histogram_drop": _CUT_SQL.format(type=_TYPE, cluster="nullif(coalesce(cluster, 0), 0)", last=2),
    "cut_histogram_append": _CUT_SQL.format(type=_TYPE, cluster="CASE WHEN coalesce(cluster, 0) = 0 THEN 3 ELSE cluster END", last=3),
    "cut_histogram_first": _CUT_SQL.format(type=_TYPE, cluster="coalesce(cluster, 0) + 1", last=3),
    "integral_image": f"WITH {GRID_SQL} SELECT y, x, v, (SELECT sum(v) FROM g b WHERE b.y <= a.y AND b.x <= a.x)::BIGINT AS s FROM g a",
    "integral_histogram": f"""
        WITH l AS (SELECT hour(ts)::INT AS y, day(ts)::INT AS x, {_TYPE} AS label FROM events),
        c AS (SELECT y, x, label, count(*) AS v FROM l WHERE label <> 0 GROUP BY ALL),
        {DENSE_SQL}, d AS (SELECT a.y, a.x, b.label FROM z a, (SELECT DISTINCT label FROM l WHERE label <> 0) b)
        SELECT d.y, d.x, d.label, coalesce((SELECT sum(v) FROM c WHERE c.y <= d.y AND c.x <= d.x AND c.label = d.label), 0)::BIGINT AS n FROM d""",
    "sample_integral": f"""
        WITH l AS (SELECT hour(ts)::INT AS y, day(ts)::INT AS x, {_TYPE} AS label FROM events WHERE {_TYPE} <> 0),
        b(box, y0, x0, y1, x1) AS (VALUES ('all', 0, 1, 23, 31), ('morning', 6, 1, 11, 15), ('point', 12, 10, 12, 10), ('empty', 5, 5, 4, 9))
        SELECT box, k.label, count(l.y) AS n FROM b CROSS JOIN (SELECT DISTINCT label FROM l) k LEFT JOIN l ON l.label = k.label AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1, 2""",
    "gradient": f"""
        WITH {GRID_SQL}, w AS (SELECT *, lag(v) OVER (PARTITION BY y ORDER BY x) AS a, lead(v) OVER (PARTITION BY y ORDER BY x) AS b FROM g)
        SELECT y, x, v, coalesce(CASE WHEN a IS NULL THEN (b - v)::DOUBLE WHEN b IS NULL THEN (v - a)::DOUBLE ELSE (b - a) / 2.0 END, 0)::DOUBLE AS g FROM w""",
    "local_maxima": f"""
        WITH {GRID_SQL} SELECT a.y, a.x, a.v FROM g a JOIN g b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x)
        WHERE a.v >= 1000 GROUP BY ALL HAVING count(*) = 8 AND a.v > max(b.v)""",
    "image_smooth": f"""
        WITH {GRID_SQL}, t(o, w) AS (VALUES (-1, .25), (0, .5), (1, .25)),
        h AS (SELECT a.y, a.x, sum(w::DOUBLE * b.v) AS v FROM g a CROSS JOIN t JOIN g b ON b.y = a.y AND b.x = greatest(1, least(31, a.x + o)) GROUP BY 1, 2)
        SELECT a.y, a.x, round(sum(w::DOUBLE * b.v), 4) AS v FROM h a CROSS JOIN t JOIN h b ON b.x = a.x AND b.y = greatest(0, least(23, a.y + o)) GROUP BY 1, 2""",
    "image_down": f"WITH {GRID_SQL} SELECT floor(y / 2)::BIGINT AS y, floor((x - 1) / 2)::BIGINT AS x, round(avg(v), 4) AS v FROM g GROUP BY 1, 2",
    "segment_means": "SELECT event_id, round(least(1.0, sum(value / 500) OVER w / (count(*) OVER w + 2.220446049250313e-16)), 8) AS v FROM events WINDOW w AS (PARTITION BY event_type)",
    "image_rescale": "SELECT event_id, round((value - lo) / (hi - lo), 8) AS value FROM events, (SELECT min(value) lo, max(value) hi FROM events)",
}
