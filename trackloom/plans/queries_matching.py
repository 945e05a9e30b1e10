"""Queries on distances, matching, neighbours, clustering and encodings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import cluster as C
from trackloom.operators import distance as D
from trackloom.operators import encode as E
from trackloom.operators import forest as K
from trackloom.operators import inverted as V
from trackloom.plans.tables import VECTORS_SQL, table, vectors

METRICS = ["l2", "l1", "l0", "linf", "chi2", "hell", "js", "kl2", "kl1", "kchi2", "khell", "kjs"]


def _centres(spark, sf_dir):
    """``centre, c``: the mean vector of each label."""
    moved = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    means = moved.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("x"))
    return means.groupBy(F.col("label").alias("centre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))


def pair_distances(spark, sf_dir):
    """All metrics between every vector and every label's mean (absolute values, so all are defined)."""
    positive = lambda c: F.transform(c, lambda x: F.abs(x.cast("double")))
    rows = vectors(spark, sf_dir).select("id", positive("v").alias("v"))
    refs = _centres(spark, sf_dir).select("centre", positive("c").alias("c"))
    return D.to_references(rows, refs, METRICS).select("id", "centre", *(F.round(m, 5).alias(m) for m in METRICS))


def _queries(rows):
    return rows.where(F.col("id") % 100 == 0)


def ratio_match(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "v")
    return D.ratio_match(_queries(rows), rows, 1.1, skip_self=True).select("k1", "k2", F.round("d2", 5).alias("d2"))


def nearest_neighbours(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "v")
    return D.nearest_neighbours(_queries(rows), rows, 7).select("q", "rank", "id", F.round("d2", 5).alias("d2"))


def approximate_neighbours(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "v")
    forest = K.build(rows)
    found = K.query(_queries(rows), K.index(rows, forest), forest, 7, 24, bounded=True)
    return found.select("q", "rank", "id", F.round("d2", 5).alias("d2"))


def indexed_neighbours(spark, sf_dir):
    """Seven nearest rows by inverted lists over residual codes; nearly those of ``nearest_neighbours``."""
    rows = vectors(spark, sf_dir).select("id", "v")
    return V.query(_queries(rows), V.index(rows), 7).select("q", "rank", "id", F.round("d2", 5).alias("d2"))


def nearest_centre(spark, sf_dir):
    return D.push_centres(vectors(spark, sf_dir).select("id", "v"), _centres(spark, sf_dir)).select("id", "centre", F.round("d", 5).alias("d"))


def centre_tree(spark, sf_dir):
    """Two levels: the means of even and of odd labels, then the labels' own means below them."""
    c = _centres(spark, sf_dir)
    low = c.select((F.col("centre") + 3).alias("node"), (F.col("centre") % 2 + 1).alias("parent"), "c")
    cells = c.select((F.col("centre") % 2 + 1).alias("node"), F.posexplode("c").alias("i", "x")).groupBy("node", "i").agg(F.round(F.avg("x"), 6).alias("x"))
    top = cells.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).select("node", F.lit(0).alias("parent"), "c")
    found = D.push_tree(vectors(spark, sf_dir).select("id", "v"), top.union(low), 2)
    return found.select("id", F.col("path")[0].alias("level1"), F.col("path")[1].alias("level2"))


def vlad(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centres = _centres(spark, sf_dir).select(F.col("centre").alias("k"), "c")
    near = D.push_centres(rows.select("id", "v"), _centres(spark, sf_dir)).select("id", F.col("centre").alias("k"), F.lit(1.0).alias("a"))
    return E.vlad(rows.select("id", "v"), centres, near).select("k", "dim", F.round("val", 6).alias("val"))


def kmeans_energy(spark, sf_dir):
    """Energy after each point goes to its nearest label mean, by centre."""
    near = D.push_centres(vectors(spark, sf_dir).select("id", "v"), _centres(spark, sf_dir))
    return near.groupBy("centre").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("energy"))


def kmeans_step(spark, sf_dir):
    """One Lloyd update from the labels' means: the new centres."""
    rows = vectors(spark, sf_dir)
    near = D.push_centres(rows.select("id", "v"), _centres(spark, sf_dir)).select("id", "centre")
    return near.join(rows, "id").select("centre", F.posexplode("v").alias("dim", "x")).groupBy("centre", "dim").agg(F.round(F.avg("x"), 6).alias("x"))


def kmeans(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "v")
    _, assigned, _ = C.kmeans(rows, 8, iterations=5)
    return assigned


def gmm(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "v")
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    means, covs, priors, loglik = C.gmm(rows, [[0.5] * dims, [-0.5] * dims], iterations=4)
    return spark.createDataFrame([(k, float(p), m, c, float(loglik)) for k, (m, c, p) in enumerate(zip(means, covs, priors, strict=True))], "k int, prior double, mean array<double>, variance array<double>, loglik double")


def mutual_information(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return C.mutual_information(counts, "event_type", "hour").select(F.round("mi", 8).alias("mi"))


def bottleneck(spark, sf_dir):
    """AIB over hours against event types: the merge tree."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n")).collect()
    types = sorted({r["event_type"] for r in rows})
    p = np.zeros((len(types), 24))
    for r in rows:
        p[types.index(r["event_type"]), r["h"]] = r["n"]
    parents, _ = C.aib(p)
    return spark.createDataFrame(list(enumerate(parents, 1)), "node int, parent int")


QUERIES = {
    "ratio_match": ratio_match, "pair_distances": pair_distances, "nearest_neighbours": nearest_neighbours, "approximate_neighbours": approximate_neighbours, "indexed_neighbours": indexed_neighbours, "nearest_centre": nearest_centre, "centre_tree": centre_tree,
    "vlad": vlad, "kmeans_energy": kmeans_energy, "kmeans_step": kmeans_step, "kmeans": kmeans, "gmm": gmm,
    "mutual_information": mutual_information, "bottleneck": bottleneck,
}

_D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_CENTRES = f"""{VECTORS_SQL}, x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
    mean AS (SELECT label, i, round(avg(x), 6) AS x FROM x GROUP BY 1, 2), c AS (SELECT label AS centre, list(x ORDER BY i) AS c FROM mean GROUP BY 1)"""
_NEAR = f"""{_CENTRES}, n AS (SELECT e.id, e.v, c.centre, list_sum(list_transform(list_zip(e.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e, c),
    near AS (SELECT id, v, centre, d FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, centre) = 1)"""


def _term(expr: str) -> str:
    return f"round(list_sum(list_transform(z, lambda p: {expr})), 5)"


_P = lambda t: t.replace("x", "p[1]").replace("y", "p[2]")
_LOG = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN {a} * log2({a} / ({b})) ELSE 0 END"
_TERMS = {
    "l2": _P("(x - y) * (x - y)"), "l1": _P("abs(x - y)"), "l0": _P("(x <> y)::INT::DOUBLE"), "chi2": _P("CASE WHEN x + y = 0 THEN 0 ELSE (x - y) * (x - y) / (x + y) END"),
    "hell": _P("(sqrt(x) - sqrt(y)) * (sqrt(x) - sqrt(y))"), "kl2": _P("x * y"), "kl1": _P("least(x, y)"), "kchi2": _P("CASE WHEN x + y = 0 THEN 0 ELSE 2 * x * y / (x + y) END"), "khell": _P("sqrt(x * y)"),
    "js": _LOG("p[1]", "(p[1] + p[2]) / 2") + " + " + _LOG("p[2]", "(p[1] + p[2]) / 2"),
    "kjs": "0.5 * (CASE WHEN p[1] > 0 THEN p[1] * log2((p[1] + p[2]) / p[1]) ELSE 0 END + CASE WHEN p[2] > 0 THEN p[2] * log2((p[1] + p[2]) / p[2]) ELSE 0 END)",
}

ORACLE_SQL = {
    "ratio_match": f"""
        WITH {VECTORS_SQL}, d AS (SELECT a.id AS k1, b.id AS k2, {_D2} AS d2 FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id),
        r AS (SELECT *, row_number() OVER w AS r, lead(d2) OVER w AS second FROM d WINDOW w AS (PARTITION BY k1 ORDER BY d2, k2))
        SELECT k1, k2, round(d2, 5) AS d2 FROM r WHERE r = 1 AND (second IS NULL OR 1.1 * d2 < second)""",
    "pair_distances": f"WITH {_CENTRES}, k AS (SELECT e.id, c.centre, list_zip(list_transform(e.v, lambda q: abs(q)), list_transform(c.c, lambda q: abs(q))) AS z FROM e, c) SELECT id, centre, "
    + ", ".join(f"{_term(t)} AS {m}" for m, t in _TERMS.items())
    + ", round(list_max(list_transform(z, lambda p: abs(p[1] - p[2]))), 5) AS linf FROM k",
    "nearest_neighbours": f"""
        WITH {VECTORS_SQL}, d AS (SELECT a.id AS q, b.id, {_D2} AS d2 FROM e a, e b WHERE a.id % 100 = 0)
        SELECT q, (row_number() OVER (PARTITION BY q ORDER BY d2, id))::INT AS rank, id, round(d2, 5) AS d2 FROM d QUALIFY rank <= 7""",
    "nearest_centre": f"WITH {_NEAR} SELECT id, centre, round(d, 5) AS d FROM near",
    "vlad": f"""
        WITH {_NEAR}, q AS (SELECT centre AS k, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM near), s AS (SELECT k, dim, sum(x) AS s, count(*) AS m FROM q GROUP BY 1, 2),
        mu AS (SELECT centre AS k, generate_subscripts(c, 1) - 1 AS dim, unnest(c) AS mu FROM c),
        r AS (SELECT k, dim, coalesce(s - m * mu, 0) AS val FROM mu LEFT JOIN s USING (k, dim))
        SELECT k, dim::INT AS dim, round(val / greatest(sqrt((SELECT sum(val * val) FROM r)), 1e-12), 6) AS val FROM r""",
    "centre_tree": f"""
        WITH {_CENTRES}, u AS (SELECT label % 2 + 1 AS node, i, round(avg(x), 6) AS x FROM mean GROUP BY 1, 2), top AS (SELECT node, list(x ORDER BY i) AS c FROM u GROUP BY 1),
        a AS (SELECT e.id, e.v, node, list_sum(list_transform(list_zip(e.v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e, top),
        l AS (SELECT id, v, node AS level1 FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, node) = 1),
        b AS (SELECT id, level1, centre + 3 AS node, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM l JOIN c ON centre % 2 + 1 = level1)
        SELECT id, level1, node AS level2 FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, node) = 1""",
    "kmeans_energy": f"WITH {_NEAR} SELECT centre, count(*) AS n, round(sum(d), 4) AS energy FROM near GROUP BY 1",
    "kmeans_step": f"WITH {_NEAR}, q AS (SELECT centre, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM near) SELECT centre, dim::INT AS dim, round(avg(x), 6) AS x FROM q GROUP BY 1, 2",
    "mutual_information": """
        WITH c AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT round(sum(n / t * ln(n * t / (a * b))), 8) AS mi FROM (SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY event_type)::DOUBLE AS a, sum(n) OVER (PARTITION BY h)::DOUBLE AS b FROM c)""",
}
#: The bounded query visits every leaf that can matter, so its result is exact.
ORACLE_SQL["approximate_neighbours"] = ORACLE_SQL["nearest_neighbours"]
