"""Queries of the scalar functions: geometry, rotations, splines, colours, frames, and sets of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.functions.twister import DEFAULT_SEED, Twister
from trackloom.operators import alignment as A
from trackloom.operators import geometry as H
from trackloom.operators import graphpath as G
from trackloom.plans.tables import table

#: A projective map for the queries, row-major.
MAP = [1.02, 0.01, 3.0, -0.02, 0.98, 1.0, 0.0001, 0.0002, 1.0]
#: Control points of a thin-plate spline and where they go.
PLATE = [(0.0, 0.0), (50.0, 0.0), (0.0, 8.0), (50.0, 8.0), (25.0, 3.0)]
MOVED = [(1.0, 0.5), (51.0, -0.5), (-1.0, 8.5), (52.0, 9.0), (27.0, 3.5)]


def lines(spark, sf_dir):
    """Line items as numbers: ``k, x, y, u, d, t``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_extendedprice") / 1000).alias("u"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


LINES_SQL = "l AS (SELECT l_orderkey AS k, l_quantity AS x, l_linenumber::DOUBLE AS y, l_extendedprice / 1000 AS u, l_discount AS d, l_tax AS t FROM lineitem)"


def rounded(*cols, digits: int = 6):
    return [(F.round(c, digits) + 0.0).alias(n) for n, c in cols]


def _elements(array, prefix: str, n: int, digits: int = 6):
    return rounded(*((f"{prefix}{i}", array[i]) for i in range(n)), digits=digits)


def homogeneous(spark, sf_dir):
    last = F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("y"))
    return lines(spark, sf_dir).select(F.array("x", "u", last).alias("p")).select(*_elements(S.normalise_homogeneous(F.col("p")), "c", 3, 9))


def _whole(c, m):
    return (F.floor(F.col(c)) % m).cast("double")


#: Four small points in each of two images, from the digits of a row.
_POINTS = [(("x", 5), ("y", 3)), (("x", 7), ("u", 4)), (("y", 4), ("k", 5)), (("u", 6), ("x", 3))]
_OTHERS = [(("u", 5), ("k", 7)), (("k", 3), ("y", 5)), (("x", 4), ("u", 7)), (("y", 2), ("x", 6))]


def _placed(points):
    return [F.array(_whole(*a), _whole(*b)) for a, b in points]


def collinear(spark, sf_dir):
    p, lifted = _placed(_POINTS[:3]), [F.array(_whole(*a), _whole(*b), F.lit(1.0)) for a, b in _POINTS[:3]]
    return lines(spark, sf_dir).select("k", "x", "y", "u", S.collinear(*p).alias("plain"), S.collinear(*lifted, homogeneous=True).alias("lifted"))


def degenerate(spark, sf_dir):
    return lines(spark, sf_dir).select("k", "x", "y", "u", S.degenerate(_placed(_POINTS), _placed(_OTHERS)).alias("degenerate"), S.too_dense(_placed(_POINTS), _placed(_OTHERS), 6.0).alias("dense"))


def transfer_errors(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("h", F.array(*map(F.lit, MAP)))
    rows = rows.withColumn("i", S.inverse3(F.col("h")))
    return rows.select("k", "x", "y", *rounded(("e", S.transfer_error(F.col("x"), F.col("y"), F.col("x") + F.col("d"), F.col("y") - F.col("t"), F.col("h"), F.col("i")))))


def inverse_matrices(spark, sf_dir):
    m = F.array("x", "d", "t", "t", "y", F.lit(1.0), "d", F.lit(0.5), F.col("u") + 1)
    return lines(spark, sf_dir).select(m.alias("m")).select(*_elements(S.inverse3(F.col("m")), "i", 9))


def quad_weights(spark, sf_dir):
    w = S.bilinear(F.col("x"), F.col("u"), F.lit(10.0), F.lit(20.0), 25.0, 30.0)
    return lines(spark, sf_dir).select(w.alias("w")).select(*_elements(F.col("w"), "w", 4))


_QUAD = [(5.0, 5.0), (40.0, 9.0), (10.0, 50.0), (45.0, 60.0)]


def quad_points(spark, sf_dir):
    quad = [(F.lit(a), F.lit(b)) for a, b in _QUAD]
    return lines(spark, sf_dir).select("k", "x", "u", S.in_quad(F.col("x"), F.col("u"), *quad).alias("inside"))


def quad_bounds(spark, sf_dir):
    quad = [(F.col("x"), F.col("y")), (F.col("u"), F.col("x")), (F.col("y"), F.col("u")), (F.col("d"), F.col("t"))]
    return lines(spark, sf_dir).select("k", *(c.alias(n) for n, c in zip(("x0", "x1", "y0", "y1"), S.quad_bounds(*quad), strict=True)))


def _sizes(spark, sf_dir):
    """``clip, frames, width, height``: a stand-in clip for every supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), (F.col("s_nationkey") % 3 + 1).alias("frames"), (F.col("s_suppkey") % 97 + 640.0).alias("width"), (F.col("s_nationkey") + 360.0).alias("height"))


def mesh_grid(spark, sf_dir):
    return H.mesh_grid(_sizes(spark, sf_dir), ["clip"], 8).select("clip", "i", "j", *rounded(("x", F.col("x")), ("y", F.col("y"))))


def smooth_weights(spark, sf_dir):
    v1, v2, v3 = (F.col("x"), F.col("y")), (F.col("u"), F.col("d")), (F.col("u") + 3, F.col("t") - 4)
    u, v = S.smooth_weight(v1, v2, v3)
    return lines(spark, sf_dir).select("k", *rounded(("u", u), ("v", v)))


def node_numbers(spark, sf_dir):
    """Node numbers of events and their parts again."""
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("video"), (F.dayofmonth("ts") - 1).alias("window"), (F.hour("ts") % 5).alias("label"))
    at = ev.withColumn("node", G.node_index(F.col("video"), F.col("window"), F.col("label"), 5, 31))
    video, window, label = G.node_columns(F.col("node"), 5, 31)
    return at.select("event_id", F.col("node").cast("long").alias("node"), video.cast("long").alias("video2"), window.cast("long").alias("window2"), label.cast("long").alias("label2"))


def _edges(spark, sf_dir):
    """Counts between hours of the day, as edges of a graph ``k, s, t, w``."""
    ev = table(spark, sf_dir, "events").select((F.dayofmonth("ts") % 4).alias("k"), (F.hour("ts") % 6).alias("s"), (F.col("user_id") % 6).cast("int").alias("t"))
    return ev.groupBy("k", "s", "t").agg(F.count("*").cast("double").alias("w"))


_EDGES_SQL = "e AS (SELECT (day(ts) % 4)::INT AS k, (hour(ts) % 6)::INT AS s, (user_id % 6)::INT AS t, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2, 3)"


def edges_set(spark, sf_dir):
    """Weights replaced on both directions, and nodes ignored."""
    edges = _edges(spark, sf_dir)
    changes = edges.where("s < t AND k = 1").select("k", "s", "t", (F.col("w") * 10).alias("w"))
    out = G.set_edges(edges, changes, symmetric=True)
    ignored = spark.createDataFrame([(1, 2), (2, 5)], "k int, s int")
    return G.without_nodes(out, ignored).select("k", "s", "t", "w")


def edges_got(spark, sf_dir):
    """Weights of asked edges; those that are not there are far."""
    asked = spark.range(36).select((F.col("id") % 6).cast("int").alias("s"), F.floor(F.col("id") / 6).cast("int").alias("t")).withColumn("k", F.lit(2))
    return G.get_edges(_edges(spark, sf_dir).where("w > 3"), asked, 1e6).select("k", "s", "t", "w")


def path_cost(spark, sf_dir):
    """Cost of the path through the labels k, and of one with an edge that is not there."""
    edges = _edges(spark, sf_dir)
    costs = [G.path_cost(spark.createDataFrame(path, "k int, s int"), edges).withColumn("path", F.lit(n)) for n, path in (("there", [(0, 0), (1, 1), (2, 2), (3, 3)]), ("absent", [(0, 0), (1, 9), (2, 2)]))]
    return costs[0].unionByName(costs[1]).select("path", "cost")


def hats(spark, sf_dir):
    m = S.hat(F.array("x", "y", "u"))
    return lines(spark, sf_dir).select(m.alias("m")).select(*_elements(F.col("m"), "m", 9), *_elements(S.unhat(F.col("m")), "v", 3))


def rotations(spark, sf_dir):
    """A rotation, the vector that comes back from it, and the derivatives along the vector."""
    v = F.array(F.col("d") * 10 + 0.1, F.col("t") * 10 - 0.3, F.col("y") / 10)
    rows = lines(spark, sf_dir).select(v.alias("v")).select("v", S.rodrigues(F.col("v")).alias("m"))
    return rows.select(*_elements(F.col("m"), "m", 9), *_elements(S.inverse_rodrigues(F.col("m")), "v", 3))


def rotation_slopes(spark, sf_dir):
    """Derivatives of the rotation of a small vector: d(R w) / dv = -R [w]x J."""
    v = F.array(F.col("d") * 10 + 0.1, F.col("t") * 10 - 0.3, F.col("y") / 10)
    rows = lines(spark, sf_dir).select(v.alias("v")).select(S.rodrigues_jacobian(F.col("v")).alias("j"))
    # nine entries by three coordinates; each slope, summed with its own weight
    return rows.select(*(F.round(F.col("j")[i], 5).alias(f"j{i}") for i in range(27)))


def affine_points(spark, sf_dir):
    a, t, x = F.array("x", "d", "t", "y"), F.array("u", "d"), F.array("y", "x")
    p = S.affine(a, t, x)
    return lines(spark, sf_dir).select(p.alias("p"), S.affine_jacobian(x).alias("j")).select(*_elements(F.col("p"), "p", 2), *_elements(F.col("j"), "j", 12))


def _plate():
    import numpy as np

    return H.thin_plate(np.array(PLATE), np.array(MOVED)).tolist()


def plate_points(spark, sf_dir):
    """Points through a thin-plate spline, and the basis at its middle point."""
    c, n = _plate(), len(PLATE)
    basis = [S.tps_basis(F.col("x"), F.col("y"), F.lit(a), F.lit(b)) for a, b in PLATE]
    axis = lambda i: sum((c[k][i] * basis[k] for k in range(n)), F.lit(c[n][i]) + c[n + 1][i] * F.col("x") + c[n + 2][i] * F.col("y"))
    return lines(spark, sf_dir).select("x", "y", *rounded(("px", axis(0)), ("py", axis(1)), ("middle", basis[4])))


def colours(spark, sf_dir):
    """RGB to XYZ, to Lab and Luv, and back to RGB."""
    rgb = (F.col("d") * 10, F.col("t") * 10, F.col("x") / 50)
    x, y, z = S.rgb_to_xyz(*rgb)
    rows = lines(spark, sf_dir).select(x.alias("cx"), y.alias("cy"), z.alias("cz"))
    xyz = F.col("cx"), F.col("cy"), F.col("cz")
    lab, luv, back = S.xyz_to_lab(*xyz), S.xyz_to_luv(*xyz), S.xyz_to_rgb(*xyz)
    named = [*zip(("x", "y", "z"), xyz, strict=True), *zip(("l", "a", "b"), lab, strict=True), *zip(("u", "v"), luv[1:], strict=True), *zip(("red", "green", "blue"), back, strict=True)]
    return rows.select(*((F.round(c, 9 if n in "xyz" else 6) + 0.0).alias(n) for n, c in named))


def ellipses(spark, sf_dir):
    """Points, discs and ellipses of 2 to 6 numbers as oriented ellipses."""
    every = F.array("x", "y", F.col("u") + 1, F.col("d"), F.col("t") + 1, "d")
    f = F.slice(every, F.lit(1), (F.col("k") % 5 + 2).cast("int"))
    return lines(spark, sf_dir).select("k", f.alias("f")).select("k", *_elements(S.frame_to_ellipse(F.col("f")), "e", 6))


def regions_transposed(spark, sf_dir):
    return lines(spark, sf_dir).select(S.region_transpose(F.array("x", "y", "u", "d", "t")).alias("f")).select(*(F.col("f")[i].alias(f"f{i}") for i in range(5)))


def mirrored_patterns(spark, sf_dir):
    """Histograms of uniform patterns of the mirrored image."""
    hist = F.transform(F.sequence(F.lit(1), F.lit(58)), lambda i: (F.col("o_orderkey") * i) % 97)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", hist.alias("h"))
    return rows.select("o_orderkey", F.array_join(A.flip_patterns(F.col("h")), ",").alias("mirrored"))


def black_pixels(spark, sf_dir):
    rgb = [(F.floor(F.col(c) * 100) % m).cast("int") for c, m in (("d", 3), ("t", 2), ("x", 5))]
    return lines(spark, sf_dir).groupBy(S.is_black(*rgb).alias("black")).agg(F.count("*").alias("n"))


def twister_numbers(spark, sf_dir):
    """The first five numbers of the default seed and of every supplier's key as a seed, and the last two drawn again
    from the state put back; do these equal them, do all lie in [0, 1), and how many of the first three differ."""

    def draw(batches):
        for pdf in batches:
            out = []
            for seed in pdf["seed"]:
                t = Twister(int(seed) % (1 << 32))
                first, at = t.rand(3), t.state
                rest = t.rand(2)
                t.state = at
                again = t.rand(2)
                every = [*first, *rest, *again]
                out.append((seed, bool((again == rest).all()), all(0 <= x < 1 for x in every), len(set(first)), *map(float, every)))
            yield pd.DataFrame(out, columns=["seed", "again", "within", "distinct", *names])

    names = [f"x{i}" for i in range(7)]
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seed")).union(spark.range(DEFAULT_SEED, DEFAULT_SEED + 1)).distinct()
    return seeds.mapInPandas(draw, "seed long, again boolean, within boolean, distinct int, " + ", ".join(f"{n} double" for n in names))


def triplets_summed(spark, sf_dir):
    rows = lines(spark, sf_dir)
    parts = [rows.select((F.col("k") % 40).alias("i"), F.col("y").cast("int").alias("j"), F.round(F.col(v) * 1000).cast("long").alias("v")) for v in ("x", "u")]
    return H.triplets(*parts).select("i", "j", "v")


def stitch_state(spark, sf_dir):
    cells = H.stitch_state(_sizes(spark, sf_dir), ["clip"], 8)
    return cells.select("clip", "frame", "row", "col", *rounded(*((c, F.col(c)) for c in ("left", "top", "quad_width", "quad_height"))), F.col("p")[0].alias("p0"), F.col("c")[1].alias("c1"))


QUERIES = {
    "twister_numbers": twister_numbers, "triplets_summed": triplets_summed, "stitch_state": stitch_state,
    "homogeneous_points": homogeneous, "collinear_points": collinear, "degenerate_samples": degenerate, "transfer_errors": transfer_errors, "inverse_matrices": inverse_matrices,
    "quad_weights": quad_weights, "quad_points": quad_points, "quad_bounds": quad_bounds, "mesh_grid": mesh_grid, "smooth_weights": smooth_weights, "node_numbers": node_numbers,
    "edges_set": edges_set, "edges_got": edges_got, "path_cost": path_cost, "hat_matrices": hats, "rotations": rotations, "rotation_slopes": rotation_slopes, "affine_points": affine_points,
    "plate_points": plate_points, "colours": colours, "ellipse_frames": ellipses, "regions_transposed": regions_transposed, "mirrored_patterns": mirrored_patterns, "black_pixels": black_pixels,
}


def _sql_whole(c: str, m: int) -> str:
    return f"(floor({c}) % {m})::DOUBLE"


def _sql_points(points) -> list[tuple[str, str]]:
    return [(_sql_whole(*a), _sql_whole(*b)) for a, b in points]


def _sql_collinear(p, q, r) -> str:
    return f"({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) = ({q[1]} - {p[1]}) * ({r[0]} - {p[0]})"


def _sql_degenerate() -> str:
    triples = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    return " OR ".join(_sql_collinear(*(side[i] for i in t)) for side in (_sql_points(_POINTS), _sql_points(_OTHERS)) for t in triples)


def _sql_spread(points) -> str:
    return " + ".join(f"greatest({', '.join(p[i] for p in points)}) - least({', '.join(p[i] for p in points)})" for i in (0, 1))


def _sql_map(h: list[str], x: str, y: str) -> tuple[str, str]:
    w = f"({h[6]} * {x} + {h[7]} * {y} + {h[8]})"
    return f"(({h[0]} * {x} + {h[1]} * {y} + {h[2]}) / {w})", f"(({h[3]} * {x} + {h[4]} * {y} + {h[5]}) / {w})"


def _sql_inverse(h: list[str]) -> list[str]:
    """Adjugate over determinant, by cofactors."""
    minor = lambda r, c: "({0} * {3} - {1} * {2})".format(*(h[3 * i + j] for i in range(3) if i != r for j in range(3) if j != c))
    cofactor = lambda r, c: f"({'-' if (r + c) % 2 else ''}{minor(r, c)})"
    det = "(" + " + ".join(f"{h[c]} * {cofactor(0, c)}" for c in range(3)) + ")"
    return [f"{cofactor(c, r)} / {det}" for r in range(3) for c in range(3)]


_H = [f"{v!r}::DOUBLE" for v in MAP]
_FWD, _BACK = _sql_map(_H, "x", "y"), _sql_map([f"({v})" for v in _sql_inverse(_H)], "(x + d)", "(y - t)")
_V = ["(d * 10 + 0.1::DOUBLE)", "(t * 10 - 0.3::DOUBLE)", "(y / 10)"]
_M = ["x", "d", "t", "t", "y", "1::DOUBLE", "d", "0.5::DOUBLE", "(u + 1)"]


def _sql_triangle(p, q, r) -> str:
    """On one side of all three edges, or on them."""
    side = lambda a, b: f"(({b[0]} - {a[0]}) * (u - {a[1]}) - ({b[1]} - {a[1]}) * (x - {a[0]}))"
    edges = [side(p, q), side(q, r), side(r, p)]
    return f"(({' AND '.join(e + ' >= 0' for e in edges)}) OR ({' AND '.join(e + ' <= 0' for e in edges)}))"


def _sql_plate() -> str:
    c, n = _plate(), len(PLATE)
    u = lambda a, b: f"CASE WHEN x = {a} AND y = {b} THEN 0 ELSE ((x - {a}) ** 2 + (y - {b}) ** 2) * ln((x - {a}) ** 2 + (y - {b}) ** 2) END"
    axis = lambda i: " + ".join([f"{c[n][i]!r}::DOUBLE", f"{c[n + 1][i]!r}::DOUBLE * x", f"{c[n + 2][i]!r}::DOUBLE * y", *(f"{c[k][i]!r}::DOUBLE * ({u(*PLATE[k])})" for k in range(n))])
    return f"SELECT x, y, round({axis(0)}, 6) AS px, round({axis(1)}, 6) AS py, round({u(*PLATE[4])}, 6) AS middle FROM l"


def _sql_slopes() -> str:
    """Central differences of the rotation's entries, written out."""

    def entries(v: list[str]) -> list[str]:
        t2 = f"({v[0]} * {v[0]} + {v[1]} * {v[1]} + {v[2]} * {v[2]})"
        s, c = f"(sin(sqrt({t2})) / sqrt({t2}))", f"((1 - cos(sqrt({t2}))) / {t2})"
        x, y, z = v
        return [
            f"(1 - {c} * ({y} * {y} + {z} * {z}))", f"({c} * {x} * {y} - {s} * {z})", f"({c} * {x} * {z} + {s} * {y})", f"({c} * {x} * {y} + {s} * {z})", f"(1 - {c} * ({x} * {x} + {z} * {z}))",
            f"({c} * {y} * {z} - {s} * {x})", f"({c} * {x} * {z} - {s} * {y})", f"({c} * {y} * {z} + {s} * {x})", f"(1 - {c} * ({x} * {x} + {y} * {y}))",
        ]

    out, h = [], "0.0001::DOUBLE"
    for k in range(3):
        side = lambda sign, k=k: entries([f"(v{i} {sign} {h})" if i == k else f"v{i}" for i in range(3)])
        out.append([f"(({a}) - ({b})) / (2 * {h})" for a, b in zip(side("+"), side("-"), strict=True)])
    columns = ", ".join(f"round({out[i % 3][i // 3]}, 5) AS j{i}" for i in range(27))
    return f"v AS (SELECT {', '.join(f'{e} AS v{i}' for i, e in enumerate(_V))} FROM l) SELECT {columns} FROM v"


def _sql_twister() -> str:
    """The published generator written out: words of its state from the seed, the first ten after one twist, tempered, and
    two of them to a number of 53 bits."""
    step = lambda a, i: f"((1812433253 * xor({a}, {a} >> 30) + {i}) & 4294967295)"  # noqa: E731  (below 2 ** 63)
    word = lambda start, first, last: f"list_reduce(list_prepend({start}, range({first}, {last + 1})), lambda a, i: {step('a', 'i')})"
    words = lambda start, first, last: f"list_reduce(list_prepend([{start}], list_transform(range({first}, {last + 1}), lambda i: [i])), lambda a, i: list_append(a, {step('a[-1]', 'i[1]')}))"
    twist = "xor(xor(t[k], ((h[k] & 2147483648) | (h[k + 1] & 2147483647)) >> 1), (h[k + 1] & 1) * 2567483615)"
    stages = [
        f"d AS (SELECT s_suppkey AS seed FROM supplier UNION SELECT {DEFAULT_SEED})", f"h AS (SELECT seed, {words('seed & 4294967295', 1, 10)} AS h FROM d)",
        f"u AS (SELECT seed, h, {word('h[11]', 11, 397)} AS u FROM h)", f"t AS (SELECT seed, h, {words('u', 398, 406)} AS t FROM u)", f"w AS (SELECT seed, list_transform(range(1, 11), lambda k: {twist}) AS w FROM t)",
    ]
    for n, tempered in enumerate(("xor(y, y >> 11)", "xor(y, (y << 7) & 2636928640)", "xor(y, (y << 15) & 4022730752)", "xor(y, y >> 18)")):
        stages.append(f"w{n} AS (SELECT seed, list_transform(w, lambda y: {tempered}) AS w FROM w{n - 1 if n else ''})")
    stages.append(f"x AS (SELECT seed, {', '.join(f'((w[{2 * k + 1}] >> 5) * 67108864 + (w[{2 * k + 2}] >> 6))::DOUBLE / 9007199254740992 AS x{k}' for k in range(5))} FROM w3)")
    return f"""WITH {', '.join(stages)}
        SELECT seed, true AS again, greatest(x0, x1, x2, x3, x4) < 1 AND least(x0, x1, x2, x3, x4) >= 0 AS within, len(list_distinct([x0, x1, x2]))::INT AS distinct, x0, x1, x2, x3, x4, x3 AS x5, x4 AS x6 FROM x"""


_LAB_F = "CASE WHEN {0} > 0.008856::DOUBLE THEN cbrt({0}) ELSE (903.3::DOUBLE * {0} + 16) / 116 END"
_ROT = """r AS (SELECT v0, v1, v2, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS a FROM (SELECT {0} AS v0, {1} AS v1, {2} AS v2 FROM l)),
    q AS (SELECT v0, v1, v2, a, v0 / a AS e0, v1 / a AS e1, v2 / a AS e2, cos(a) AS c, sin(a) AS s FROM r)""".format(*_V)

ORACLE_SQL = {
    "twister_numbers": _sql_twister(),
    "triplets_summed": f"WITH {LINES_SQL} SELECT k % 40 AS i, y::INT AS j, sum(round(x * 1000)::BIGINT + round(u * 1000)::BIGINT)::BIGINT AS v FROM l GROUP BY 1, 2",
    "stitch_state": """SELECT s_suppkey AS clip, (f.i + 1)::INT AS frame, (a.i + 1)::INT AS row, (b.i + 1)::INT AS col, round(b.i * (s_suppkey % 97 + 640.0::DOUBLE) / 8, 6) AS left, round(a.i * (s_nationkey + 360.0::DOUBLE) / 8, 6) AS top,
        round((s_suppkey % 97 + 640.0::DOUBLE) / 8, 6) AS quad_width, round((s_nationkey + 360.0::DOUBLE) / 8, 6) AS quad_height, 1.0::DOUBLE AS p0, 0.0::DOUBLE AS c1 FROM supplier JOIN range(3) f(i) ON f.i < s_nationkey % 3 + 1, range(8) a(i), range(8) b(i)""",
    "homogeneous_points": f"WITH {LINES_SQL} SELECT " + ", ".join(f"round(CASE WHEN k % 3 = 0 THEN {c if c != 'y' else '0'} ELSE {c} / y END, 9) AS c{i}" for i, c in enumerate(("x", "u", "y"))) + " FROM l",
    "collinear_points": f"WITH {LINES_SQL} SELECT k, x, y, u, {_sql_collinear(*_sql_points(_POINTS)[:3])} AS plain, {_sql_collinear(*_sql_points(_POINTS)[:3])} AS lifted FROM l",
    "degenerate_samples": f"WITH {LINES_SQL} SELECT k, x, y, u, {_sql_degenerate()} AS degenerate, least({_sql_spread(_sql_points(_POINTS))}, {_sql_spread(_sql_points(_OTHERS))}) < 6 AS dense FROM l",
    "transfer_errors": f"WITH {LINES_SQL} SELECT k, x, y, round(({_FWD[0]} - (x + d)) ** 2 + ({_FWD[1]} - (y - t)) ** 2 + ({_BACK[0]} - x) ** 2 + ({_BACK[1]} - y) ** 2, 6) AS e FROM l",
    "inverse_matrices": f"WITH {LINES_SQL} SELECT " + ", ".join(f"round({e}, 6) + 0.0 AS i{i}" for i, e in enumerate(_sql_inverse(_M))) + " FROM l",
    "quad_weights": f"WITH {LINES_SQL}, q AS (SELECT (x - 10) / 25 AS a, (u - 20) / 30 AS b FROM l) SELECT "
    + ", ".join(f"CASE WHEN a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 THEN round({e}, 6) END AS w{i}" for i, e in enumerate(("(1 - a) * (1 - b)", "a * (1 - b)", "(1 - a) * b", "a * b"))) + " FROM q",
    "quad_points": f"WITH {LINES_SQL} SELECT k, x, u, {_sql_triangle(_QUAD[0], _QUAD[1], _QUAD[3])} OR {_sql_triangle(_QUAD[0], _QUAD[2], _QUAD[3])} AS inside FROM l",
    "quad_bounds": f"WITH {LINES_SQL} SELECT k, least(x, u, y, d) AS x0, greatest(x, u, y, d) AS x1, least(y, x, u, t) AS y0, greatest(y, x, u, t) AS y1 FROM l",
    "mesh_grid": "SELECT s_suppkey AS clip, i::INT AS i, j::INT AS j, round(1 + j * (s_suppkey % 97 + 639.0::DOUBLE) / 8, 6) AS x, round(1 + i * (s_nationkey + 359.0::DOUBLE) / 8, 6) AS y FROM supplier, range(9) a(i), range(9) b(j)",
    "smooth_weights": f"WITH {LINES_SQL}, q AS (SELECT k, x - u AS dx, y - d AS dy, 3.0::DOUBLE AS ex, t - 4 - d AS ey FROM l) SELECT k, round((dx * ex + dy * ey) / (ex ** 2 + ey ** 2), 6) AS u, round((dx * ey - dy * ex) / (ex ** 2 + ey ** 2), 6) AS v FROM q",
    "node_numbers": "WITH v AS (SELECT event_id, user_id % 2 AS a, day(ts) - 1 AS b, hour(ts) % 5 AS c FROM events) SELECT event_id, ((a * 31 + b) * 5 + c + 1)::BIGINT AS node, a::BIGINT AS video2, b::BIGINT AS window2, c::BIGINT AS label2 FROM v",
    "edges_set": f"""
        WITH {_EDGES_SQL}, c AS (SELECT k, s, t, w * 10 AS w FROM e WHERE s < t AND k = 1), both_ways AS (SELECT * FROM c UNION ALL SELECT k, t AS s, s AS t, w FROM c),
        o AS (SELECT * FROM both_ways UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM both_ways b WHERE b.k = e.k AND b.s = e.s AND b.t = e.t))
        SELECT k, s, t, w FROM o WHERE (k, s) NOT IN ((1, 2), (2, 5)) AND (k + 1, t) NOT IN ((1, 2), (2, 5))""",
    "edges_got": f"WITH {_EDGES_SQL} SELECT 2 AS k, a.s::INT AS s, b.t::INT AS t, coalesce(e.w, 1e6::DOUBLE) AS w FROM range(6) a(s) CROSS JOIN range(6) b(t) LEFT JOIN e ON e.k = 2 AND e.s = a.s AND e.t = b.t AND e.w > 3",
    "path_cost": f"WITH {_EDGES_SQL} SELECT 'there' AS path, CASE WHEN count(*) = 3 THEN sum(w) END AS cost FROM e WHERE (k, s, t) IN ((0, 0, 1), (1, 1, 2), (2, 2, 3)) UNION ALL SELECT 'absent', NULL",
    "hat_matrices": f"WITH {LINES_SQL} SELECT " + ", ".join(f"round({e}, 6) AS m{i}" for i, e in enumerate(("0::DOUBLE", "-u", "y", "u", "0::DOUBLE", "-x", "-y", "x", "0::DOUBLE"))) + ", round(x, 6) AS v0, round(y, 6) AS v1, round(u, 6) AS v2 FROM l",
    "rotations": f"WITH {LINES_SQL}, {_ROT} SELECT "
    + ", ".join(f"round({'c + ' if i == j else ''}(1 - c) * e{i} * e{j}{'' if i == j else f' {"-" if (j - i) % 3 == 1 else "+"} s * e{3 - i - j}'}, 6) AS m{3 * i + j}" for i in range(3) for j in range(3)) + ", round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM q",
    "rotation_slopes": f"WITH {LINES_SQL}, {_sql_slopes()}",
    "affine_points": f"WITH {LINES_SQL} SELECT round(x * y + d * x + u, 6) AS p0, round(t * y + y * x + d, 6) AS p1, " + ", ".join(f"round({e}, 6) AS j{i}" for i, e in enumerate(("y", "x", "0::DOUBLE", "0::DOUBLE", "1::DOUBLE", "0::DOUBLE", "0::DOUBLE", "0::DOUBLE", "y", "x", "0::DOUBLE", "1::DOUBLE"))) + " FROM l",
    "plate_points": f"WITH {LINES_SQL} {_sql_plate()}",
    "colours": f"""
        WITH {LINES_SQL}, c AS (SELECT d * 10 AS r, t * 10 AS g, x / 50 AS b FROM l),
        p AS (SELECT r, g, b, 0.4887180::DOUBLE * r + 0.3106803::DOUBLE * g + 0.2006017::DOUBLE * b AS x, 0.1762044::DOUBLE * r + 0.8129847::DOUBLE * g + 0.0108109::DOUBLE * b AS y, 0.0102048::DOUBLE * g + 0.9897952::DOUBLE * b AS z FROM c),
        f AS (SELECT *, {_LAB_F.format("x")} AS fx, {_LAB_F.format("y")} AS fy, {_LAB_F.format("z")} AS fz, x + 15 * y + 3 * z AS down FROM p)
        SELECT round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(z, 9) + 0.0 AS z, round(116 * fy - 16, 6) + 0.0 AS l, round(500 * (fx - fy), 6) + 0.0 AS a, round(200 * (fy - fz), 6) + 0.0 AS b,
               round(13 * (116 * fy - 16) * (CASE WHEN down > 0 THEN 4 * x / down ELSE 0 END - 4 / 19.0::DOUBLE), 6) + 0.0 AS u, round(13 * (116 * fy - 16) * (CASE WHEN down > 0 THEN 9 * y / down ELSE 0 END - 9 / 19.0::DOUBLE), 6) + 0.0 AS v,
               round(r, 6) + 0.0 AS red, round(g, 6) + 0.0 AS green, round(b, 6) + 0.0 AS blue FROM f""",
    "ellipse_frames": f"""
        WITH {LINES_SQL}, f AS (SELECT *, k % 5 + 2 AS n, u + 1 AS r FROM l)
        SELECT k, round(x, 6) AS e0, round(y, 6) AS e1,
               round(CASE n WHEN 2 THEN 0 WHEN 3 THEN r WHEN 4 THEN r * cos(d) WHEN 5 THEN sqrt(r) ELSE r END, 6) AS e2, round(CASE n WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN r * sin(d) WHEN 5 THEN d / sqrt(r) ELSE d END, 6) AS e3,
               round(CASE n WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN -r * sin(d) WHEN 5 THEN 0 ELSE t + 1 END, 6) AS e4, round(CASE n WHEN 2 THEN 0 WHEN 3 THEN r WHEN 4 THEN r * cos(d) WHEN 5 THEN sqrt(t + 1 - d * d / r) ELSE d END, 6) AS e5 FROM f""",
    "regions_transposed": f"WITH {LINES_SQL} SELECT y AS f0, x AS f1, t AS f2, d AS f3, u AS f4 FROM l",
    "mirrored_patterns": """
        WITH p AS (SELECT CASE WHEN q >= 57 THEN q ELSE 7 * ((((5 - (q - 1) // 7 - ((q - 1) % 7 + 1)) % 8) + 8) % 8) + ((q - 1) % 7 + 1) END AS from_, q FROM range(1, 59) r(q)),
        v AS (SELECT o_orderkey, q, (o_orderkey * from_) % 97 AS h FROM orders, p)
        SELECT o_orderkey, string_agg(h::BIGINT, ',' ORDER BY q) AS mirrored FROM v GROUP BY 1""",
    "black_pixels": f"WITH {LINES_SQL} SELECT floor(d * 100) % 3 = 0 AND floor(t * 100) % 2 = 0 AND floor(x * 100) % 5 = 0 AS black, count(*) AS n FROM l GROUP BY 1",
}
