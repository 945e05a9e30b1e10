"""Queries of iterated learners by fixed rounds, of whole vectors, and of descriptors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackloom.operators import cluster as C
from trackloom.operators import descriptors as V
from trackloom.operators import encode as E
from trackloom.operators import keypoints as K
from trackloom.operators import svm as M
from trackloom.operators.images import gaussian_weights
from trackloom.plans.queries_matching import _CENTRES, _centres
from trackloom.plans.tables import GRID_SQL, VECTORS_SQL, day_grid, vectors

ROUNDS, STEPS, LAMBDA, DIMS = 3, 10, 0.1, 64
CELL, ORIENTATIONS, BIN, STEP = 8, 9, 3, 4


def _start(spark, sf_dir, scale: float = 1.0, whole: bool = False):
    rows = sorted(_centres(spark, sf_dir).collect(), key=lambda r: r["centre"])
    return [[math.floor(x * scale) if whole else x * scale for x in r["c"]] for r in rows]


def kmeans_rounds(spark, sf_dir):
    """Three Lloyd rounds from the labels' means."""
    rows = vectors(spark, sf_dir).select("id", "v")
    _, assigned, _ = C.kmeans(rows, 10, iterations=ROUNDS, min_change=-1.0, centres=_start(spark, sf_dir))
    return assigned.select("id", "centre", F.round("d", 5).alias("d"))


def bounded_kmeans_rounds(spark, sf_dir):
    """The same three rounds with bounds beside the rows, and the nearest of their centres."""
    _, assigned, _ = C.elkan_kmeans(vectors(spark, sf_dir).select("id", "v"), _start(spark, sf_dir), ROUNDS + 1)
    return assigned.select("id", "centre", F.round("d", 5).alias("d"))


def integer_kmeans_rounds(spark, sf_dir):
    """The same on whole numbers, with centres rounded down."""
    rows = vectors(spark, sf_dir).select("id", F.transform("v", lambda x: F.floor(x * 100).cast("double")).alias("v"))
    _, assigned, _ = C.kmeans(rows, 10, iterations=ROUNDS, min_change=-1.0, centres=_start(spark, sf_dir, 100.0, True), integer=True)
    return assigned.select("id", "centre", F.round("d", 5).alias("d"))


def gmm_rounds(spark, sf_dir):
    """Two EM rounds from fixed means."""
    means, covs, priors, loglik = C.gmm(vectors(spark, sf_dir).select("id", "v"), [[0.1] * DIMS, [-0.1] * DIMS], iterations=2)
    rows = [(k, i, float(p), float(m), float(c), float(loglik)) for k, (ms, cs, p) in enumerate(zip(means, covs, priors, strict=True)) for i, (m, c) in enumerate(zip(ms, cs, strict=True))]
    out = spark.createDataFrame(rows, "k int, dim int, prior double, mean double, variance double, loglik double")
    return out.select("k", "dim", *(F.round(c, 6).alias(c) for c in ("prior", "mean", "variance")), F.round("loglik", 3).alias("loglik"))


def _signed(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("v").alias("x"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"), "id")


def pegasos_scores(spark, sf_dir):
    """Scores after ten subgradient steps, by the earlier name."""
    rows = _signed(spark, sf_dir)
    w, b, _ = M.pegasos(rows.select("x", "y"), LAMBDA, steps=STEPS)
    return M.predict(rows, w, b).select("id", "y", F.round("score", 6).alias("score"))


def gmm_posteriors(spark, sf_dir):
    """Posteriors of two fixed components."""
    q = C.gmm_posteriors(vectors(spark, sf_dir).select("id", "v"), [[0.1] * DIMS, [-0.1] * DIMS], [[0.9] * DIMS, [1.2] * DIMS], [0.25, 0.75])
    return q.select("id", F.round(F.col("q")[0], 6).alias("q0"), F.round(F.col("q")[1], 6).alias("q1"))


def svm_trace(spark, sf_dir):
    """What the training callback is told."""
    told = []
    M.train(_signed(spark, sf_dir).select("x", "y"), LAMBDA, steps=STEPS + 1, callback=told.append)
    return spark.createDataFrame([(t["step"], float(t["loss"]), float(t["objective"])) for t in told], "step int, loss double, objective double").select("step", F.round("loss", 6).alias("loss"), F.round("objective", 6).alias("objective"))


def fisher_whole(spark, sf_dir):
    """Fisher encoding over all components."""
    mixture = [([0.0] * DIMS, [1.0] * DIMS, 0.5), ([0.05] * DIMS, [1.1] * DIMS, 0.5)]
    return E.fisher(vectors(spark, sf_dir).select("id", "v"), mixture).select("k", "moment", "dim", F.round("val", 6).alias("val"))


def kernel_map_whole(spark, sf_dir):
    """The homogeneous kernel map of every component."""
    rows = vectors(spark, sf_dir).select("id", F.posexplode("v").alias("dim", "x")).select("id", "dim", E.kernel_map(F.col("x"), 1, "chi2").alias("m"))
    return rows.select("id", "dim", *(F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(3)))


def _image(spark, sf_dir):
    return day_grid(spark, sf_dir).select("y", (F.col("x") - 1).alias("x"), (F.col("v") / 1000.0).alias("v"))


def _hog(variant):
    def run(spark, sf_dir):
        cells = V.cell_orientations(_image(spark, sf_dir), CELL, ORIENTATIONS)
        return V.oriented_gradients(cells, ORIENTATIONS, variant).select(F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"), "f", F.round("v", 6).alias("v")).where("v > 0")

    return run


def dense_descriptors(spark, sf_dir):
    return V.dense_descriptors(_image(spark, sf_dir), BIN, STEP).where("v > 0").select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "bin", "v")


#: Sigmas of the keypoint queries' layers.
SCALES = [0.6, 0.8, 1.1, 1.5, 2.0, 2.7]


def _keypoints(method):
    def run(spark, sf_dir):
        found = K.detect(_image(spark, sf_dir), method, SCALES, 0.05)
        return found.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("sigma", 6).alias("sigma"), F.round("r", 4).alias("r"))

    return run


QUERIES = {
    "dog_keypoints": _keypoints("dog"), "hessian_keypoints": _keypoints("hessian"),
    "kmeans_rounds": kmeans_rounds, "bounded_kmeans_rounds": bounded_kmeans_rounds, "integer_kmeans_rounds": integer_kmeans_rounds, "gmm_rounds": gmm_rounds, "svm_trace": svm_trace, "pegasos_scores": pegasos_scores, "gmm_posteriors": gmm_posteriors, "fisher": fisher_whole, "fisher_whole": fisher_whole,
    "kernel_map": kernel_map_whole, "kernel_map_whole": kernel_map_whole, "hog": _hog("uoctti"), "hog_dalal_triggs": _hog("dalaltriggs"), "dense_descriptors": dense_descriptors,
}


def _sql_lloyd(rows: str, start: str, whole: bool) -> str:
    out = [f"c0 AS ({start})"]
    distance = "list_sum(list_transform(list_zip(e.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    middle = "floor(avg(x))" if whole else "avg(x)"
    for r in range(1, ROUNDS + 2):
        out.append(f"a{r} AS (SELECT id, v, centre, d FROM (SELECT e.id, e.v, c.centre, {distance} AS d FROM {rows} e, c{r - 1} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, centre) = 1)")
        out.append(f"u{r} AS (SELECT centre, i, {middle} AS x FROM (SELECT centre, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{r}) GROUP BY 1, 2)")
        out.append(f"c{r} AS (SELECT c.centre, coalesce(m.c, c.c) AS c FROM c{r - 1} c LEFT JOIN (SELECT centre, list(x ORDER BY i) AS c FROM u{r} GROUP BY 1) m USING (centre))")
    return ", ".join(out) + f" SELECT id, centre::INT AS centre, round(d, 5) AS d FROM a{ROUNDS + 1}"


def _sql_em(rounds: int) -> str:
    out = [
        "x AS (SELECT id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM e)",
        "g0 AS (SELECT k, i, CASE k WHEN 0 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END AS mu, greatest(var_pop(x), 1e-6) AS s2, 0.5::DOUBLE AS p FROM x, range(2) r(k) GROUP BY 1, 2)",
    ]
    for r in range(1, rounds + 1):
        out += [
            f"l{r} AS (SELECT id, k, ln(min(p)) - 0.5 * sum(ln(2 * pi() * s2) + (x - mu) ** 2 / s2) AS l FROM x JOIN g{r - 1} USING (i) GROUP BY 1, 2)",
            f"z{r} AS (SELECT *, max(l) OVER w + ln(sum(exp(l - m)) OVER w) AS z FROM (SELECT *, max(l) OVER (PARTITION BY id) AS m FROM l{r}) WINDOW w AS (PARTITION BY id))",
            f"q{r} AS (SELECT id, k, exp(l - z) AS q FROM z{r})", f"n{r} AS (SELECT k, sum(q) AS n FROM q{r} GROUP BY 1)",
            f"s{r} AS (SELECT k, i, sum(q * x) AS a, sum(q * x * x) AS b FROM q{r} JOIN x USING (id) GROUP BY 1, 2)",
            f"g{r} AS (SELECT k, i, a / n AS mu, greatest(b / n - (a / n) ** 2, 1e-6) AS s2, n / (SELECT count(*) FROM e) AS p FROM s{r} JOIN n{r} USING (k))",
        ]
    return ", ".join(out) + f" SELECT k::INT AS k, i::INT AS dim, round(p, 6) AS prior, round(mu, 6) AS mean, round(s2, 6) AS variance, round((SELECT sum(z) FROM (SELECT DISTINCT id, z FROM z{rounds})), 3) AS loglik FROM g{rounds}"


def _sql_descent(steps: int) -> str:
    """``w0`` to ``w{steps}``: (i, w) after each step; the bias is component 65."""
    out = [
        f"f AS (SELECT id, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e UNION ALL SELECT id, CASE WHEN label < 5 THEN 1 ELSE -1 END, {DIMS + 1}, 1.0 FROM e)",
        f"w0 AS (SELECT i, 0.0::DOUBLE AS w FROM range(1, {DIMS + 2}) r(i))",
    ]
    for t in range(1, steps + 1):
        out += [
            f"z{t} AS (SELECT id, min(y) AS y, sum(x * w) AS z FROM f JOIN w{t - 1} USING (i) GROUP BY 1)",
            f"d{t} AS (SELECT i, sum(CASE WHEN z{t}.y * z < 1 THEN -z{t}.y * x ELSE 0 END) / (SELECT count(*) FROM e) AS g FROM f JOIN z{t} USING (id) GROUP BY 1)",
            f"v{t} AS (SELECT i, w - ({LAMBDA}::DOUBLE * w + g) / ({LAMBDA}::DOUBLE * {t + 1}) AS w FROM w{t - 1} JOIN d{t} USING (i))",
            f"w{t} AS (SELECT i, w * (SELECT least(1, 1 / sqrt({LAMBDA}::DOUBLE) / sqrt(sum(w * w))) FROM v{t}) AS w FROM v{t})",
        ]
    return ", ".join(out)


def _sql_gradients() -> str:
    d = lambda c: f"CASE WHEN lag(v) OVER w{c} IS NULL THEN lead(v) OVER w{c} - v WHEN lead(v) OVER w{c} IS NULL THEN v - lag(v) OVER w{c} ELSE (lead(v) OVER w{c} - lag(v) OVER w{c}) / 2 END AS g{c}"
    return f"im AS (SELECT y, x - 1 AS x, v / 1000.0 AS v FROM g), gr AS (SELECT y, x, {d('x')}, {d('y')} FROM im WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"


def _sql_hog(variant: str) -> str:
    axes = ", ".join(f"({k}, {math.cos(math.pi * k / ORIENTATIONS)!r}::DOUBLE, {math.sin(math.pi * k / ORIENTATIONS)!r}::DOUBLE)" for k in range(ORIENTATIONS))
    head = f"""WITH {GRID_SQL}, {_sql_gradients()}, ax(k, c, s) AS (VALUES {axes}),
        o AS (SELECT y, x, sqrt(gx ** 2 + gy ** 2) AS m, k + CASE WHEN gx * c + gy * s < 0 THEN {ORIENTATIONS} ELSE 0 END AS o FROM gr, ax WHERE gx <> 0 OR gy <> 0
              QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY round(abs(gx * c + gy * s), 9) DESC, k) = 1),
        p AS (SELECT *, (y + 0.5) / {CELL} - 0.5 AS hy, (x + 0.5) / {CELL} - 0.5 AS hx FROM o), b(a) AS (VALUES (0), (1)),
        vt AS (SELECT floor(hy) + ya.a AS cy, floor(hx) + xa.a AS cx, o, m * CASE ya.a WHEN 0 THEN 1 - (hy - floor(hy)) ELSE hy - floor(hy) END * CASE xa.a WHEN 0 THEN 1 - (hx - floor(hx)) ELSE hx - floor(hx) END AS m FROM p, b ya, b xa),
        h AS (SELECT cy, cx, o, sum(m) AS h FROM vt WHERE cy BETWEEN 0 AND {(24 + CELL // 2) // CELL - 1} AND cx BETWEEN 0 AND {(31 + CELL // 2) // CELL - 1} GROUP BY 1, 2, 3),
        u AS (SELECT cy, cx, o % {ORIENTATIONS} AS o, sum(h) AS h FROM h GROUP BY 1, 2, 3), en AS (SELECT cy, cx, sum(h * h) AS e FROM u GROUP BY 1, 2),
        hi AS (SELECT min(cy) AS ly, max(cy) AS hy, min(cx) AS lx, max(cx) AS hx FROM en),
        n AS (SELECT en.cy, en.cx, 2 * fy.a + fx.a AS f, sqrt(sum(coalesce(o.e, 0)) + 1e-10) AS n FROM en, hi, b fy, b fx, b qy, b qx LEFT JOIN en o ON o.cy = greatest(ly, least(hy, en.cy + fy.a - 1 + qy.a)) AND o.cx = greatest(lx, least(hx, en.cx + fx.a - 1 + qx.a)) GROUP BY 1, 2, 3),
        cu AS (SELECT u.cy, u.cx, o, f, least(0.2::DOUBLE, h / n) AS c FROM u JOIN n ON n.cy = u.cy AND n.cx = u.cx), cd AS (SELECT h.cy, h.cx, o, f, least(0.2::DOUBLE, h / n) AS c FROM h JOIN n ON n.cy = h.cy AND n.cx = h.cx)"""
    if variant == "dalaltriggs":
        every = f"SELECT cy, cx, f * {ORIENTATIONS} + o AS f, c AS v FROM cu"
    else:
        every = f"""SELECT cy, cx, o AS f, sum(c) / 2 AS v FROM cd GROUP BY 1, 2, 3 UNION ALL SELECT cy, cx, o + {2 * ORIENTATIONS}, sum(c) / 2 FROM cu GROUP BY 1, 2, 3
            UNION ALL SELECT cy, cx, f + {3 * ORIENTATIONS}, sum(c) / sqrt({2 * ORIENTATIONS}) FROM cd GROUP BY 1, 2, 3"""
    return f"{head} SELECT cy::INT AS cy, cx::INT AS cx, f::INT AS f, round(v, 6) AS v FROM ({every}) WHERE round(v, 6) > 0"


_DENSE = f"""WITH {GRID_SQL}, {_sql_gradients()}, b(a) AS (VALUES (0), (1)),
    o AS (SELECT y, x, sqrt(gx ** 2 + gy ** 2) AS m, atan2(gy, gx) / (2 * pi()) * 8 AS q FROM gr WHERE gx <> 0 OR gy <> 0),
    t AS (SELECT y, x, m, CASE WHEN q < 0 THEN q + 8 ELSE q END AS q FROM o),
    s AS (SELECT y, x, (floor(q)::INT + a) % 8 AS o, m * CASE a WHEN 0 THEN 1 - (q - floor(q)) ELSE q - floor(q) END AS m FROM t, b),
    k AS (SELECT (ky * {STEP})::INT AS y, (kx * {STEP})::INT AS x FROM range(8) a(ky), range(8) c(kx) WHERE ky * {STEP} + {3 * BIN} <= 23 AND kx * {STEP} + {3 * BIN} <= 30),
    d AS (SELECT k.y, k.x, (32 * i + 8 * j + s.o)::INT AS bin, sum(m * (1 - abs(s.y - k.y - {BIN} * i) / {BIN}) * (1 - abs(s.x - k.x - {BIN} * j) / {BIN})) AS m
          FROM k, range(4) a(i), range(4) c(j), s WHERE abs(s.y - k.y - {BIN} * i) < {BIN} AND abs(s.x - k.x - {BIN} * j) < {BIN} GROUP BY 1, 2, 3),
    n AS (SELECT y, x, bin, least(0.2::DOUBLE, m / sqrt(sum(m * m) OVER (PARTITION BY y, x))) AS m FROM d),
    fin AS (SELECT y, x, bin, m / sqrt(sum(m * m) OVER (PARTITION BY y, x)) AS m FROM n)
    SELECT y, x, bin, least(255, floor(512 * m + 1e-6))::INT AS v FROM fin WHERE floor(512 * m + 1e-6) > 0"""

def _sql_layers() -> str:
    """``lay``: (s, y, x, v), the image blurred by each of ``SCALES``."""
    parts, out = [], []
    for s, sigma in enumerate(SCALES):
        w = gaussian_weights(sigma)
        taps = ", ".join(f"({i - len(w) // 2}, {v!r}::DOUBLE)" for i, v in enumerate(w))
        out += [
            f"w{s}(o, wt) AS (VALUES {taps})", f"bx{s} AS (SELECT a.y, a.x, sum(wt * b.v) AS v FROM im a CROSS JOIN w{s} JOIN im b ON b.y = a.y AND b.x = greatest(0, least(30, a.x + o)) GROUP BY 1, 2)",
            f"by{s} AS (SELECT a.y, a.x, sum(wt * b.v) AS v FROM bx{s} a CROSS JOIN w{s} JOIN bx{s} b ON b.x = a.x AND b.y = greatest(0, least(23, a.y + o)) GROUP BY 1, 2)",
        ]
        parts.append(f"SELECT {s} AS s, y, x, v FROM by{s}")
    return f"WITH {GRID_SQL}, im AS (SELECT y, x - 1 AS x, v / 1000.0 AS v FROM g), " + ", ".join(out) + f", lay AS ({' UNION ALL '.join(parts)})"


def _sql_extrema(minima: bool) -> str:
    low = " OR a.r < min(b.r)" if minima else ""
    names = " ".join(f"WHEN {s} THEN {v}" for s, v in enumerate(SCALES))
    return f"""SELECT a.y::INT AS y, a.x::INT AS x, round(CASE a.s {names} END::DOUBLE, 6) AS sigma, round(a.r, 4) AS r FROM res a JOIN res b ON abs(a.s - b.s) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.s = b.s AND a.y = b.y AND a.x = b.x)
        WHERE abs(a.r) >= 0.05 GROUP BY a.s, a.y, a.x, a.r HAVING count(*) = 26 AND (a.r > max(b.r){low})"""


def _sql_at(dy: int, dx: int) -> str:
    return f"max(CASE WHEN b.y = a.y + ({dy}) AND b.x = a.x + ({dx}) THEN b.v END)"


_SQL_HESSIAN = f"""h AS (SELECT a.s, a.y, a.x, {_sql_at(0, 1)} + {_sql_at(0, -1)} - 2 * {_sql_at(0, 0)} AS xx, {_sql_at(1, 0)} + {_sql_at(-1, 0)} - 2 * {_sql_at(0, 0)} AS yy,
    ({_sql_at(1, 1)} + {_sql_at(-1, -1)} - {_sql_at(1, -1)} - {_sql_at(-1, 1)}) / 4 AS xy FROM lay a JOIN lay b ON a.s = b.s AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9),
    res AS (SELECT s, y, x, (CASE s {" ".join(f"WHEN {s} THEN {v!r}::DOUBLE" for s, v in enumerate(SCALES))} END) ** 4 * (xx * yy - xy * xy) AS r FROM h)"""

ORACLE_SQL = {
    "dog_keypoints": f"{_sql_layers()}, res AS (SELECT a.s, a.y, a.x, b.v - a.v AS r FROM lay a JOIN lay b ON b.s = a.s + 1 AND b.y = a.y AND b.x = a.x) {_sql_extrema(True)}",
    "hessian_keypoints": f"{_sql_layers()}, {_SQL_HESSIAN} {_sql_extrema(False)}",
    "kmeans_rounds": f"WITH {_CENTRES}, {_sql_lloyd('e', 'SELECT centre, c FROM c', False)}",
    "bounded_kmeans_rounds": f"WITH {_CENTRES}, {_sql_lloyd('e', 'SELECT centre, c FROM c', False)}",
    "integer_kmeans_rounds": f"WITH {_CENTRES}, w AS (SELECT id, list_transform(v, lambda q: floor(q * 100)) AS v FROM e), {_sql_lloyd('w', 'SELECT centre, list_transform(c, lambda q: floor(q * 100)) AS c FROM c', True)}",
    "gmm_rounds": f"WITH {VECTORS_SQL}, {_sql_em(2)}",
    "svm": f"WITH {VECTORS_SQL}, {_sql_descent(STEPS)}, mean AS (SELECT i, avg(w) AS w FROM ({' UNION ALL '.join(f'SELECT * FROM w{t}' for t in range(STEPS // 2 + 1, STEPS + 1))}) GROUP BY 1) SELECT id, min(y)::INT AS y, round(sum(x * w), 6) AS score FROM f JOIN mean USING (i) GROUP BY 1",
    "svm_trace": f"""WITH {VECTORS_SQL}, {_sql_descent(STEPS)}, last AS (SELECT id, min(y) AS y, sum(x * w) AS z FROM f JOIN w{STEPS} USING (i) GROUP BY 1), l AS (SELECT avg(greatest(0, 1 - y * z)) AS l FROM last)
        SELECT 1 AS step, 1.0::DOUBLE AS loss, 1.0::DOUBLE AS objective UNION ALL SELECT {STEPS + 1}, round(l, 6), round(l + {LAMBDA}::DOUBLE / 2 * (SELECT sum(w * w) FROM w{STEPS}), 6) FROM l""",
    "fisher_whole": f"""
        WITH {VECTORS_SQL}, m(k, mu, s2, pr) AS (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE), (1, 0.05, 1.1, 0.5)),
        l AS (SELECT id, v, k, mu, s2, pr, ln(pr) - 0.5 * {DIMS} * ln(2 * pi() * s2) - 0.5 * list_sum(list_transform(v, lambda x: (x - mu) * (x - mu) / s2)) AS l FROM e, m),
        q AS (SELECT *, exp(l - max(l) OVER (PARTITION BY id)) AS w FROM l), z AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS q FROM q),
        d AS (SELECT k, mu, s2, pr, q, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM z),
        s AS (SELECT k, dim, mu, s2, pr, (SELECT count(*) FROM e) AS n, sum(q) q0, sum(q * x) q1, sum(q * x * x) q2 FROM d GROUP BY ALL)
        SELECT k, 1 AS moment, dim::INT AS dim, round((q1 - q0 * mu) / sqrt(s2) / (n * sqrt(pr)), 6) AS val FROM s
        UNION ALL SELECT k, 2, dim::INT, round(((q2 - 2 * mu * q1 + q0 * mu * mu) / s2 - q0) / (n * sqrt(2 * pr)), 6) FROM s""",
    "kernel_map_whole": f"""
        WITH {VECTORS_SQL}, p AS (SELECT id, (generate_subscripts(v, 1) - 1)::INT AS dim, unnest(v) AS x, 2 * pi() / (5.86::DOUBLE + 3.65::DOUBLE) AS s FROM e), k AS (SELECT *, 2 / (exp(pi() * s) + exp(-pi() * s)) AS q FROM p)
        SELECT id, dim, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * sqrt(s * abs(x)) END, 6) AS m0, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * sqrt(2 * s * q * abs(x)) * cos(s * ln(abs(x))) END, 6) AS m1,
               round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * sqrt(2 * s * q * abs(x)) * sin(s * ln(abs(x))) END, 6) AS m2 FROM k""",
    "hog": _sql_hog("uoctti"), "hog_dalal_triggs": _sql_hog("dalaltriggs"), "dense_descriptors": _DENSE,
}
ORACLE_SQL["pegasos_scores"] = ORACLE_SQL["svm"]
ORACLE_SQL["gmm_posteriors"] = f"""
    WITH {VECTORS_SQL}, m(k, mu, s2, pr) AS (VALUES (0, 0.1::DOUBLE, 0.9::DOUBLE, 0.25::DOUBLE), (1, -0.1, 1.2, 0.75)),
    l AS (SELECT id, k, ln(pr) - 0.5 * {DIMS} * ln(2 * pi() * s2) - 0.5 * list_sum(list_transform(v, lambda x: (x - mu) * (x - mu) / s2)) AS l FROM e, m),
    q AS (SELECT id, max(l) FILTER (k = 0) AS a, max(l) FILTER (k = 1) AS b FROM l GROUP BY 1)
    SELECT id, round(1 / (1 + exp(b - a)), 6) AS q0, round(1 / (1 + exp(a - b)), 6) AS q1 FROM q"""
# the names that had the first components only
ORACLE_SQL |= {"fisher": ORACLE_SQL["fisher_whole"], "kernel_map": ORACLE_SQL["kernel_map_whole"]}
