"""Moved meshes rendered by tiles, against a loop over quads."""

from __future__ import annotations

import math

import numpy as np
import pytest

from trackloom.operators import render as N


def keys_cubic(d):
    d = abs(d)
    return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0


def solve(src, dst):
    """The 3 x 3 map of four points, by linear equations."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)


def looped(image, mesh, ch, cw, gap):
    h, w = image.shape
    out = {}
    rows, cols = mesh.shape[0] - 1, mesh.shape[1] - 1
    for r in range(rows):
        for c in range(cols):
            to = [mesh[r + a, c + b] for a, b in N.CORNERS]
            back = solve(to, [((c + b) * cw, (r + a) * ch) for a, b in N.CORNERS])
            xs, ys = [p[0] for p in to], [p[1] for p in to]
            for y in range(max(math.floor(min(ys)), -gap), min(math.ceil(max(ys)) - 1, h + gap - 1) + 1):
                for x in range(max(math.floor(min(xs)), -gap), min(math.ceil(max(xs)) - 1, w + gap - 1) + 1):
                    u, v, t = back @ (x, y, 1)
                    sx, sy = round(u / t, 9), round(v / t, 9)
                    taps = [(math.floor(sy) + i, math.floor(sx) + j, keys_cubic(sy - math.floor(sy) - i) * keys_cubic(sx - math.floor(sx) - j)) for i in (-1, 0, 1, 2) for j in (-1, 0, 1, 2)]
                    taps = [t for t in taps if t[2] != 0]
                    out[y, x] = sum(k * image[a, b] for a, b, k in taps) if all(0 <= a < h and 0 <= b < w for a, b, _ in taps) else None
    return out


def rows_of(spark, images, meshes):
    pixels = spark.createDataFrame([(n, y, x, float(v)) for n, im in enumerate(images) for (y, x), v in np.ndenumerate(im)], "frame int, y int, x int, v double")
    vertices = spark.createDataFrame([(n, i, j, float(m[i, j][0]), float(m[i, j][1])) for n, m in enumerate(meshes) for i in range(m.shape[0]) for j in range(m.shape[1])], "frame int, i int, j int, x double, y double")
    return pixels, vertices


@pytest.mark.parametrize("tile", [256, 5])
def test_folded_meshes(spark, tile):
    rnd = np.random.RandomState(1)
    images, meshes = [rnd.rand(18, 22) * 100 for _ in range(3)], []
    for n in range(3):
        grid = np.array([[(j * 7.3, i * 6.1) for j in range(4)] for i in range(4)])
        meshes.append(grid + rnd.uniform(-2.5, 2.5, grid.shape) * (n > 0))
    meshes[2][1, 1], meshes[2][1, 2] = (16.2, 5.7), (8.9, 6.4)  # two vertices change places: quads fold over each other
    pixels, vertices = rows_of(spark, images, meshes)
    got = {(r["frame"], r["y"], r["x"]): r["v"] for r in N.render(pixels, vertices, ["frame"], 18, 22, 6.1, 7.3, gap=3, tile=tile).collect()}
    want = {(n, y, x): v for n in range(3) for (y, x), v in looped(images[n], meshes[n], 6.1, 7.3, 3).items()}
    assert got.keys() == want.keys() and any(y < 0 for _, y, _ in got) and any(x >= 22 for _, _, x in got)
    off = [k for k in want if (got[k] is None) != (want[k] is None)]
    assert len(off) <= 2  # a sample on the border itself may fall to either side
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want if k not in off and want[k] is not None)


def test_the_last_quad_wins_and_holes_stay(spark):
    image = np.arange(64.0).reshape(8, 8)
    pixels, vertices = rows_of(spark, [image], [np.array([[(j * 4, i * 4) for j in range(3)] for i in range(3)], float)])
    shown = N.owners(N.with_maps(N.quads(vertices, ["frame"])), ["frame"], 8, 8).collect()
    assert {(r["y"], r["x"]): (r["row"], r["col"]) for r in shown} == {(y, x): (y // 4, x // 4) for y in range(8) for x in range(8)}
    # without a corner a cell is none; one that is moved over another is in front of it
    fewer = vertices.where("NOT (i = 2 AND j = 2)")
    assert len(N.quads(fewer, ["frame"]).collect()) == 3
    flat = vertices.selectExpr("frame", "i", "j", "x", "IF(i = 1, 0, y) AS y")  # the first row of cells has no area
    got = {(r["y"], r["x"]): r["v"] for r in N.render(pixels, flat, ["frame"], 8, 8, 4.0, 4.0, kernel="linear").collect()}
    assert len(got) == 64 and got[4, 3] == 6 * 8 + 3 and got[0, 0] == 4 * 8
    assert N.render(pixels, vertices.limit(0), ["frame"], 8, 8, 4.0, 4.0).collect() == []
    assert all(r["v"] is None for r in N.render(pixels.limit(0), vertices, ["frame"], 8, 8, 4.0, 4.0).collect())
