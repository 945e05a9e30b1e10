"""Scale-space features of image-keyed pixel tables: oriented and affine-adapted keypoints with descriptors.

An octave is a pixel table of its own, half the size of the one before.  Its
pixels go to tiles, keyed by image and place, with a margin as wide as the
widest blur and descriptor of an octave reach, so the margin is the same in every octave and a
tile, never an image, is what a task holds.  A tile answers for the
extrema in its core and for its core's part of the next octave; the results are the
same for any size of tiles, bit for bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.images import up
from trackloom.plans.stages import durable

#: Detectors: what is extremal in space and scale, or in space alone at each scale; and whether the Laplacian chooses the scale.
METHODS = {"dog": ("dog", True, False), "hessian": ("hessian", True, False), "hessian_laplace": ("hessian", False, True), "harris_laplace": ("harris", False, True), "multiscale_hessian": ("hessian", False, False), "multiscale_harris": ("harris", False, False)}
TURN = 2 * math.pi
BINS, CELLS, DIRECTIONS, CLIP = 36, 4, 8, 0.2
#: Rounds of moving to a better place, of adapting a shape, and how far off round a shape may end.
MOVES, SHAPES, ROUND = 5, 15, 1.05
#: Parts of a pixel that places are rounded to.
GRAIN = float(1 << 30)


@dataclass(frozen=True)
class Options:
    """``method`` is one of :data:`METHODS`; ``levels`` layers an octave from ``sigma`` on; pixels come with a blur of ``blur``.  ``peak`` is the least
    response, ``edge`` the most ratio of the principal curvatures, ``magnify`` the width of a descriptor's cell in sigmas,
    ``window`` its weight's deviation in cells."""

    method: str = "dog"
    levels: int = 3
    sigma: float = 1.6
    blur: float = 0.5
    peak: float = 0.0
    edge: float = 10.0
    magnify: float = 3.0
    window: float = 2.0
    oriented: bool = True
    affine: bool = False
    described: bool = True
    tile: int = 192
    first: int = field(default=0)

    def scale(self, level: float) -> float:
        return self.sigma * 2 ** (level / self.levels)

    @property
    def margin(self) -> int:
        """Blur, moves, and the descriptor at the largest scale that a fit may give."""
        largest = self.scale(self.levels + 0.5)
        reach = max(math.sqrt(2) * self.magnify * largest * (CELLS + 1) / 2, 3 * 6 * largest if self.affine else 0)
        return math.ceil(4 * self.scale(self.levels + 1)) + MOVES + math.ceil(reach) + 3


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, the border's pixels repeated; terms are added in one order wherever the pixel lies."""
    if sigma <= 0:
        return image
    half = max(1, math.ceil(4 * sigma))
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (1, 0):
        n = image.shape[axis]
        padded = np.pad(image, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = sum(wk * padded.take(range(k, k + n), axis) for k, wk in enumerate(w))
    return image


def gaussian_layers(image: np.ndarray, o: Options, octave: int) -> np.ndarray:
    """Layers -1 to ``levels`` + 1.  Later octaves begin at layer -1."""
    had = o.blur * 2.0**-o.first if octave == o.first else o.scale(-1)
    return np.stack([blurred(image, math.sqrt(max(o.scale(s) ** 2 - had**2, 0)) if octave == o.first or s > -1 else 0) for s in range(-1, o.levels + 2)])


def _second(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.pad(g, [(0, 0)] * (g.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    c = p[..., 1:-1, 1:-1]
    xx, yy = p[..., 1:-1, 2:] + p[..., 1:-1, :-2] - 2 * c, p[..., 2:, 1:-1] + p[..., :-2, 1:-1] - 2 * c
    return xx, yy, (p[..., 2:, 2:] + p[..., :-2, :-2] - p[..., 2:, :-2] - p[..., :-2, 2:]) / 4


def _gradient(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences; the border has none."""
    gx, gy = np.zeros_like(g), np.zeros_like(g)
    gx[1:-1, 1:-1], gy[1:-1, 1:-1] = (g[1:-1, 2:] - g[1:-1, :-2]) / 2, (g[2:, 1:-1] - g[:-2, 1:-1]) / 2
    return gx, gy


def responses(layers: np.ndarray, o: Options) -> np.ndarray:
    """One for each layer from -1 on: differences of layers, determinants of second differences, or corner measures."""
    kind, scales = METHODS[o.method][0], [o.scale(s) for s in range(-1, o.levels + 2)]
    if kind == "dog":
        return layers[1:] - layers[:-1]
    if kind == "hessian":
        xx, yy, xy = _second(layers)
        return (xx * yy - xy * xy) * (np.array(scales) ** 4)[:, None, None]
    out = []
    for g, s in zip(layers, scales, strict=True):
        gx, gy = _gradient(g)
        xx, yy, xy = (blurred(m, s) for m in (gx * gx, gy * gy, gx * gy))
        out.append((xx * yy - xy * xy - 0.06 * (xx + yy) ** 2) * s**4)
    return np.stack(out)


def extrema(r: np.ndarray, both: bool, through: bool, least: float) -> np.ndarray:
    """``(n, 3)`` layer, y, x strictly above (or below, with ``both``) all neighbours, in the layer or ``through`` layers too."""
    steps = [(s, y, x) for s in ((-1, 0, 1) if through else (0,)) for y in (-1, 0, 1) for x in (-1, 0, 1) if (s, y, x) != (0, 0, 0)]
    r = np.round(r, 9)  # ties of sums that differ in their last bits
    inner = r[1:-1, 1:-1, 1:-1]
    around = lambda s, y, x: r[1 + s : r.shape[0] - 1 + s, 1 + y : r.shape[1] - 1 + y, 1 + x : r.shape[2] - 1 + x]
    top, bottom = inner >= least, (-inner >= least) if both else np.zeros(inner.shape, bool)
    for step in steps:
        top &= inner > around(*step)
        bottom &= inner < around(*step)
    return np.argwhere(top | bottom) + 1


def refined(r: np.ndarray, at: np.ndarray, o: Options, space: bool) -> np.ndarray:
    """``(k, 5)``: the number of the extremum, and its layer, y, x and response by a quadratic fit, moved
    to a neighbouring pixel up to five times; flat, elongated and stray ones go.  With ``space`` the layer stays."""
    at, offsets, shape = at.copy(), np.zeros((len(at), 3)), r.shape
    if not len(at):
        return np.zeros((0, 5))
    for round_ in range(MOVES):
        s, y, x = at.T
        v = lambda a, b, c: r[s + a, y + b, x + c]  # noqa: E731, B023
        c = v(0, 0, 0)
        gx, gy, gs = (v(0, 0, 1) - v(0, 0, -1)) / 2, (v(0, 1, 0) - v(0, -1, 0)) / 2, (v(1, 0, 0) - v(-1, 0, 0)) / 2
        xx, yy, ss = v(0, 0, 1) + v(0, 0, -1) - 2 * c, v(0, 1, 0) + v(0, -1, 0) - 2 * c, v(1, 0, 0) + v(-1, 0, 0) - 2 * c
        xy = (v(0, 1, 1) + v(0, -1, -1) - v(0, -1, 1) - v(0, 1, -1)) / 4
        xs = (v(1, 0, 1) + v(-1, 0, -1) - v(-1, 0, 1) - v(1, 0, -1)) / 4
        ys = (v(1, 1, 0) + v(-1, -1, 0) - v(-1, 1, 0) - v(1, -1, 0)) / 4
        if space:
            gs, ss, xs, ys = np.zeros_like(gs), np.ones_like(ss), np.zeros_like(xs), np.zeros_like(ys)
        det = xx * (yy * ss - ys * ys) - xy * (xy * ss - ys * xs) + xs * (xy * ys - yy * xs)
        with np.errstate(invalid="ignore"):
            det = np.where(det == 0, np.nan, det)
            dx = -(gx * (yy * ss - ys * ys) - xy * (gy * ss - ys * gs) + xs * (gy * ys - yy * gs)) / det
            dy = -(xx * (gy * ss - gs * ys) - gx * (xy * ss - ys * xs) + xs * (xy * gs - gy * xs)) / det
            ds = -(xx * (yy * gs - ys * gy) - xy * (xy * gs - gy * xs) + gx * (xy * ys - yy * xs)) / det
            # of so many bits that places may be moved by whole pixels without a change
            offsets = np.round(np.stack([ds, dy, dx], 1) * GRAIN) / GRAIN
            move = np.stack([np.zeros(len(at), int), *((np.nan_to_num(d) > 0.6).astype(int) * (p < n - 2) - (np.nan_to_num(d) < -0.6).astype(int) * (p > 1) for d, p, n in ((dy, y, shape[1]), (dx, x, shape[2])))], 1)
        if round_ == MOVES - 1 or not move.any():
            break
        at = at + move
    with np.errstate(invalid="ignore"):
        value = c + (gx * dx + gy * dy + gs * ds) / 2
        flat = xx * yy - xy * xy
        good = (np.abs(offsets) < 1.5).all(1) & (np.abs(value) >= max(o.peak, 1e-12)) & (flat > 0) & ((xx + yy) ** 2 * o.edge < (o.edge + 1) ** 2 * flat)
        places = at + offsets
        good &= (places[:, 1] >= 0) & (places[:, 1] <= shape[1] - 1) & (places[:, 2] >= 0) & (places[:, 2] <= shape[2] - 1)
    keep = np.nonzero(good)[0]
    return np.column_stack([keep, places[keep], value[keep]])


def laplacian_scales(layers: np.ndarray, place: np.ndarray, o: Options) -> bool:
    """Is the scale-normalised Laplacian at a place larger in size at its layer than at those next to it?"""
    s, y, x = (int(v) for v in place)
    size = []
    for k in (s - 1, s, s + 1):
        g = layers[k]
        size.append(abs(g[y, x + 1] + g[y, x - 1] + g[y + 1, x] + g[y - 1, x] - 4 * g[y, x]) * o.scale(k - 1) ** 2)
    return size[1] > size[0] and size[1] > size[2]


def _around(g: np.ndarray, y: float, x: float, reach: int, grads) -> tuple[np.ndarray, ...]:
    """Offsets, magnitude and angle of the gradients within ``reach`` pixels of a place, borders excepted."""
    h, w = g.shape
    yi, xi = math.floor(y + 0.5), math.floor(x + 0.5)
    ys, xs = np.arange(max(yi - reach, 1), min(yi + reach, h - 2) + 1), np.arange(max(xi - reach, 1), min(xi + reach, w - 2) + 1)
    gx, gy = (m[np.ix_(ys, xs)] for m in grads)
    dy, dx = np.broadcast_arrays((ys - y)[:, None], (xs - x)[None, :])
    return dy, dx, np.sqrt(gx * gx + gy * gy), np.arctan2(gy, gx)


def orientations(g: np.ndarray, y: float, x: float, sigma: float, grads) -> list[float]:
    """Angles of the peaks, at least 0.8 of the highest, of the smoothed histogram of gradient directions."""
    spread = 1.5 * sigma
    reach = max(math.floor(3 * spread), 1)
    dy, dx, size, angle = _around(g, y, x, reach, grads)
    far = dy * dy + dx * dx
    near = far < reach * reach + 0.6
    weight, at = (np.exp(-far / (2 * spread * spread)) * size)[near], np.mod(angle[near] / TURN * BINS, BINS)
    low = np.floor(at - 0.5)
    part = at - low - 0.5
    h = np.bincount(low.astype(int) % BINS, weight * (1 - part), BINS) + np.bincount((low.astype(int) + 1) % BINS, weight * part, BINS)
    for _ in range(6):
        h = (np.roll(h, 1) + h + np.roll(h, -1)) / 3
    before, after = np.roll(h, 1), np.roll(h, -1)
    peaks = np.nonzero((h > 0.8 * h.max()) & (h > before) & (h > after))[0]
    return [float(TURN * (i - 0.5 * (after[i] - before[i]) / (after[i] + before[i] - 2 * h[i]) + 0.5) / BINS) for i in peaks]


def _finished(h: np.ndarray) -> list[int]:
    """Unit length, clipped at 0.2, unit length again, as whole numbers of at most 255."""
    for most in (CLIP, 1.0):
        n = math.sqrt(float(h @ h))
        h = np.minimum(h / n, most) if n > 0 else h
    return np.minimum(np.floor(512 * h), 255).astype(int).tolist()


def _votes(ny: np.ndarray, nx: np.ndarray, nt: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Trilinear votes into 4 x 4 cells of 8 directions; ``ny`` and ``nx`` are cells from the middle."""
    out = np.zeros(CELLS * CELLS * DIRECTIONS)
    by, bx, bt = np.floor(ny - 0.5), np.floor(nx - 0.5), np.floor(nt)
    ry, rx, rt = ny - by - 0.5, nx - bx - 0.5, nt - bt
    for a in (0, 1):
        for b in (0, 1):
            cy, cx = by + a + CELLS // 2, bx + b + CELLS // 2
            inside = (cy >= 0) & (cy < CELLS) & (cx >= 0) & (cx < CELLS)
            for c in (0, 1):
                cell = (cy * CELLS + cx) * DIRECTIONS + np.mod(bt + c, DIRECTIONS)
                w = weight * np.abs(1 - a - ry) * np.abs(1 - b - rx) * np.abs(1 - c - rt)
                out += np.bincount(cell[inside].astype(int), w[inside], len(out))
    return out


def descriptor(g: np.ndarray, y: float, x: float, sigma: float, angle: float, o: Options, grads) -> list[int]:
    """128 whole numbers: directions by cells of a window turned by ``angle``."""
    cell = o.magnify * sigma
    dy, dx, size, turn = _around(g, y, x, math.floor(math.sqrt(2) * cell * (CELLS + 1) / 2 + 0.5), grads)
    c, s = math.cos(angle), math.sin(angle)
    nx, ny = (c * dx + s * dy) / cell, (c * dy - s * dx) / cell
    weight = np.exp(-(nx * nx + ny * ny) / (2 * o.window * o.window)) * size
    return _finished(_votes(ny.ravel(), nx.ravel(), np.mod((turn - angle) / TURN * DIRECTIONS, DIRECTIONS).ravel(), weight.ravel()))


def sampled(image: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Bilinear values; places outside take the border's."""
    h, w = image.shape
    ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.minimum(ys.astype(int), max(h - 2, 0)), np.minimum(xs.astype(int), max(w - 2, 0))
    fy, fx, y1, x1 = ys - y0, xs - x0, np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def _patch(image: np.ndarray, y: float, x: float, frame: np.ndarray, extent: float, resolution: int) -> np.ndarray:
    """The image under ``frame`` (x, y to x, y) over a square of ``extent`` to each side."""
    line = np.linspace(-extent, extent, 2 * resolution + 1)
    px, py = np.meshgrid(line, line)
    return sampled(image, y + frame[1, 0] * px + frame[1, 1] * py, x + frame[0, 0] * px + frame[0, 1] * py)


def adapted(image: np.ndarray, y: float, x: float, sigma: float, extent: float = 3.0, resolution: int = 20) -> np.ndarray | None:
    """The 2 x 2 frame under which the second moments of the gradients around a place are round, as a
    fixed point; its determinant is sigma squared.  None if it goes beyond 6 to 1 or the moments vanish."""
    frame = np.eye(2)
    line = np.linspace(-extent, extent, 2 * resolution + 1)
    weight = np.exp(-(line[:, None] ** 2 + line[None, :] ** 2) / 2)
    for _ in range(SHAPES):
        gy, gx = np.gradient(_patch(image, y, x, frame * sigma, extent, resolution))
        xx, xy, yy = ((weight * m).sum() for m in (gx * gx, gx * gy, gy * gy))
        moments = np.array([[xx, xy], [xy, yy]])
        values, vectors = np.linalg.eigh(moments)
        if not values[0] > 1e-12 * max(values[1], 1e-12):
            return None
        if math.sqrt(values[1] / values[0]) < ROUND:
            break
        frame = frame @ (vectors @ np.diag((values / math.sqrt(values[0] * values[1])) ** -0.5) @ vectors.T)
        stretch = np.linalg.svd(frame, compute_uv=False)
        if stretch[0] > 6 * stretch[1]:
            return None
    # the positive factor of the frame: a turn of the patch is left to the orientation
    u, d, _ = np.linalg.svd(frame)
    return sigma * (u @ np.diag(d) @ u.T)


def _adapted_features(image: np.ndarray, y: float, x: float, shape: np.ndarray, o: Options) -> Iterator[tuple[float, list[int]]]:
    """Angles and descriptors in the patch that makes the shape round."""
    resolution, extent = 20, o.magnify * (CELLS + 1) / 2
    patch = blurred(_patch(image, y, x, shape, extent, resolution), resolution / extent)
    sigma, middle, grads = resolution / extent, float(resolution), _gradient(patch)
    for angle in orientations(patch, middle, middle, sigma, grads) if o.oriented else [0.0]:
        yield angle, descriptor(patch, middle, middle, sigma, angle, o, grads) if o.described else None


def tile_features(image: np.ndarray, octave: int, o: Options, wanted) -> tuple[np.ndarray, list[tuple]]:
    """The layer that the next octave begins with, and ``(y, x, sigma, angle, response, shape, descriptor)``, in
    pixels of the octave, of the extrema for whose place (y, x) ``wanted`` holds."""
    _, through, laplace = METHODS[o.method]
    layers = gaussian_layers(image, o, octave)
    r, out = responses(layers, o), []
    at = extrema(r[: o.levels + 2], o.method == "dog", through, 0.8 * o.peak)
    at = at[[wanted(y, x) for _, y, x in at]] if len(at) else at
    held: dict[int, tuple] = {}
    for number, s, y, x, value in refined(r, at, o, not through):
        if laplace and not laplacian_scales(layers, at[int(number)], o):
            continue
        level = float(s) - 1  # the first layer is -1
        sigma = o.scale(level)
        near = min(max(math.floor(level + 0.5), -1), o.levels + 1) + 1
        g = layers[near]
        grads = held.setdefault(near, _gradient(g))
        if o.affine:
            shape = adapted(image, y, x, sigma)
            if shape is not None:
                out += [(y, x, sigma, angle, value, shape.ravel().tolist(), d) for angle, d in _adapted_features(image, y, x, shape, o)]
            continue
        for angle in orientations(g, y, x, sigma, grads) if o.oriented else [0.0]:
            out.append((y, x, sigma, angle, value, [sigma, 0.0, 0.0, sigma], descriptor(g, y, x, sigma, angle, o, grads) if o.described else None))
    return layers[o.levels], out


_TILE = "y double, x double, v double, sigma double, angle double, response double, shape array<double>, d array<int>"


def _of_tile(key: str, octave: int, o: Options):
    def run(rows: pa.Table) -> pa.Table:
        y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", "v"))
        ty, tx, lo_y, hi_y, lo_x, hi_x = (rows.column(c)[0].as_py() for c in ("ty", "tx", "lo_y", "hi_y", "lo_x", "hi_x"))
        y0, x0 = max(ty * o.tile - o.margin, lo_y), max(tx * o.tile - o.margin, lo_x)
        y1, x1 = min((ty + 1) * o.tile + o.margin, hi_y + 1), min((tx + 1) * o.tile + o.margin, hi_x + 1)
        image = np.zeros((y1 - y0, x1 - x0))
        image[y - y0, x - x0] = v
        mine = lambda a, b: ty * o.tile <= a + y0 < (ty + 1) * o.tile and tx * o.tile <= b + x0 < (tx + 1) * o.tile
        onward, found = tile_features(image, octave, o, mine) if min(image.shape) >= 3 else (image, [])
        ys, xs = (np.arange(max(t * o.tile, lo), min((t + 1) * o.tile, hi + 1)) for t, lo, hi in ((ty, lo_y, hi_y), (tx, lo_x, hi_x)))
        ys, xs = ys[ys % 2 == 0], xs[xs % 2 == 0]
        py, px = (m.ravel() for m in np.meshgrid(ys, xs, indexing="ij"))
        n, k = len(py), len(found)
        columns = list(zip(*found, strict=True)) or [()] * 7
        lead = pa.nulls(n, pa.float64())
        scale = 2.0**octave
        return pa.table({
            key: pa.array([rows.column(key)[0].as_py()] * (n + k), rows.schema.field(key).type),
            "y": pa.concat_arrays([pa.array(py / 2), pa.array([(a + y0) * scale for a in columns[0]], pa.float64())]), "x": pa.concat_arrays([pa.array(px / 2), pa.array([(a + x0) * scale for a in columns[1]], pa.float64())]),
            "v": pa.concat_arrays([pa.array(onward[py - y0, px - x0]), pa.nulls(k, pa.float64())]),
            "sigma": pa.concat_arrays([lead, pa.array([a * scale for a in columns[2]], pa.float64())]), "angle": pa.concat_arrays([lead, pa.array(columns[3], pa.float64())]), "response": pa.concat_arrays([lead, pa.array(columns[4], pa.float64())]),
            "shape": pa.concat_arrays([pa.nulls(n, pa.list_(pa.float64())), pa.array([[c * scale for c in a] for a in columns[5]], pa.list_(pa.float64()))]),
            "d": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), pa.array(columns[6], pa.list_(pa.int32()))]),
        })

    return run


def tiled(pixels: DataFrame, image: str, tile: int, margin: int) -> DataFrame:
    """``pixels`` with the extents of their image, once for each tile ``ty, tx`` in whose margin they lie."""
    extents = pixels.groupBy(image).agg(*(f(c).cast("int").alias(f"{n}_{c}") for c in "yx" for n, f in (("lo", F.min), ("hi", F.max))))
    cut = lambda at, c: F.greatest(F.least(F.floor(at / tile), F.floor(F.col(f"hi_{c}") / tile)), F.floor(F.col(f"lo_{c}") / tile)).cast("int")
    tiles = lambda c: F.explode(F.sequence(cut(F.col(c) - margin, c), cut(F.col(c) + margin, c)))
    return pixels.join(extents, image).select("*", tiles("y").alias("ty")).select("*", tiles("x").alias("tx"))


def features(pixels: DataFrame, options: Options | None = None, octaves: int | None = None, image: str = "image", doubled: bool = False) -> DataFrame:
    """``image, octave, y, x, sigma, angle, response, shape, d``: the features of every image of ``image, y, x, v``.

    ``angle`` is from the x axis towards y; a place with several dominant directions has a row for each.
    ``shape`` (xx, xy, yx, yy) maps the unit circle to the feature's ellipse; ``d`` is the descriptor of 128
    whole numbers.  ``doubled`` begins at twice the size.  By default octaves go on until the smaller side of the largest
    image is below 8 pixels.  Pixels that a table does not have count as 0; images without any have no features.
    """
    o = options or Options()
    if o.method not in METHODS:
        raise ValueError(f"method: {o.method}")
    o = Options(**{**o.__dict__, "first": -1 if doubled else 0})
    at = pixels.where("v IS NOT NULL").select(image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    if doubled:
        at = durable(up(at, [image]).select(image, "y", "x", "v"))
    if octaves is None:
        sides = at.groupBy(image).agg(F.least(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("side")).agg(F.max("side")).first()[0]
        octaves = max(1, math.floor(math.log2((sides or 0) + 1)) - 2)
    kind, parts = pixels.schema[image].dataType.simpleString(), []
    for octave in range(o.first, o.first + octaves):
        made = durable(tiled(at, image, o.tile, o.margin).groupBy(image, "ty", "tx").applyInArrow(_of_tile(image, octave, o), f"{image} {kind}, {_TILE}"))
        parts.append(made.where("sigma IS NOT NULL").select(image, F.lit(octave).alias("octave"), "y", "x", "sigma", "angle", "response", "shape", "d"))
        at = made.where("sigma IS NULL").select(image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
