"""Point tracking between two gray images: corners by cell, and pyramidal registration of windows there and back."""

from __future__ import annotations

import numpy as np

from trackloom.operators.features import blurred, sampled

#: Half the side of a window, levels of the pyramid, rounds at a level, and the step that ends them.
HALF, LEVELS, ROUNDS, STEP = 7, 3, 20, 0.01


def pyramid(image: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """The image and its halves, while the smaller side has room for two windows."""
    out = [image.astype(float)]
    while len(out) < levels and min(out[-1].shape) >= 4 * HALF:
        out.append(blurred(out[-1], 1.0)[::2, ::2])
    return out


def _gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gy, gx = np.gradient(image) if min(image.shape) > 1 else (np.zeros_like(image), np.zeros_like(image))
    return gx, gy


def smallest_values(image: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """The smaller eigenvalue of the smoothed structure tensor at every pixel."""
    gx, gy = _gradients(image.astype(float))
    xx, xy, yy = (blurred(m, sigma) for m in (gx * gx, gx * gy, gy * gy))
    return (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)


def new_points(image: np.ndarray, held: np.ndarray, mesh: int, demand: float, short: float = 0.7, quality: float = 0.1) -> np.ndarray:
    """``(n, 2)`` x, y: corners for the cells of a ``mesh`` x ``mesh`` grid that hold less than ``short`` of their
    share of ``demand`` points.

    A cell takes what it lacks from its local maxima, the best first (ties by
    place), down to ``quality`` of its best; those next to a held point are none.
    """
    h, w = image.shape
    value, share = smallest_values(image), demand / (mesh * mesh)
    padded = np.pad(value, 1, constant_values=-np.inf)
    around = np.max([padded[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)], axis=0)
    peak = (value > around) & (value > 1e-9)
    for x, y in held:
        peak[max(0, round(y) - 2) : round(y) + 3, max(0, round(x) - 2) : round(x) + 3] = False
    ys, xs = np.nonzero(peak)
    cells = (ys * mesh // h) * mesh + xs * mesh // w
    votes = np.bincount((np.clip(held[:, 1] * mesh // h, 0, mesh - 1) * mesh + np.clip(held[:, 0] * mesh // w, 0, mesh - 1)).astype(int), minlength=mesh * mesh) if len(held) else np.zeros(mesh * mesh, int)
    out = []
    for cell in range(mesh * mesh):
        if votes[cell] < short * share:
            own = np.nonzero(cells == cell)[0]
            own = own[np.lexsort((xs[own], ys[own], -value[ys[own], xs[own]]))]
            own = own[value[ys[own], xs[own]] >= quality * value[ys[own[0]], xs[own[0]]]] if len(own) else own
            out.append(np.column_stack([xs[own], ys[own]])[: int(np.ceil(share - votes[cell]))])
    return np.concatenate([np.zeros((0, 2)), *out]).astype(float)


def registered(a: list[np.ndarray], b: list[np.ndarray], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows around ``points`` (x, y) of one pyramid are in the other, and whether they have been found:
    least squares of the difference by repeated steps, coarse to fine."""
    line = np.arange(-HALF, HALF + 1)
    wx, wy = (m.ravel() for m in np.meshgrid(line, line))
    moved, good = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(a) - 1, -1, -1):
        at, moved = points / 2**level, moved * 2 if level < len(a) - 1 else moved
        gx, gy = _gradients(a[level])
        py, px = at[:, 1, None] + wy, at[:, 0, None] + wx
        here, ix, iy = (sampled(m, py, px) for m in (a[level], gx, gy))
        xx, xy, yy = (ix * ix).sum(1), (ix * iy).sum(1), (iy * iy).sum(1)
        det = xx * yy - xy * xy
        fit = det > 1e-9 * np.maximum(xx + yy, 1e-12) ** 2
        good &= fit | (level > 0)
        going = fit.copy()
        for _ in range(ROUNDS):
            k = np.nonzero(going)[0]
            if not len(k):
                break
            gap = here[k] - sampled(b[level], py[k] + moved[k, 1, None], px[k] + moved[k, 0, None])
            ex, ey = (gap * ix[k]).sum(1), (gap * iy[k]).sum(1)
            step = np.column_stack([(yy[k] * ex - xy[k] * ey) / det[k], (xx[k] * ey - xy[k] * ex) / det[k]])
            step = np.clip(step, -HALF, HALF)
            moved[k] += step
            going[k] = np.abs(step).max(1) > STEP
    found = points + moved
    h, w = b[0].shape
    return found, good & (found >= 0).all(1) & (found[:, 0] <= w - 1) & (found[:, 1] <= h - 1)


def tracked(before: np.ndarray, now: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points' places in ``now``, and how far from where they began the way back ends (infinite if lost)."""
    if not len(points):
        return points, np.zeros(0)
    a, b = pyramid(before), pyramid(now)
    ahead, good = registered(a, b, points)
    back, also = registered(b, a, np.where(good[:, None], ahead, points))
    return ahead, np.where(good & also, np.sqrt(((back - points) ** 2).sum(1)), np.inf)
