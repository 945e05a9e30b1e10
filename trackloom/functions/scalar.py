"""Scalar functions: special functions, projective geometry, rotations, colour."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def d_gaussian(x: Column) -> Column:
    return -x * gaussian(x)


def dd_gaussian(x: Column) -> Column:
    return (x * x - 1) * gaussian(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def d_sigmoid(x: Column) -> Column:
    return sigmoid(x) * (1 - sigmoid(x))


def raised_cosine(r: float, x: Column) -> Column:
    """1 below 1 - r, half a cosine down to 0 at 1; a box for r <= 0."""
    a = F.abs(x)
    if r <= 0:
        return F.when(a <= 1, 1.0).otherwise(0.0)
    return F.when(a < 1 - r, 1.0).when(a <= 1, 0.5 * (1 + F.cos(math.pi * (1 - r - a) / r))).otherwise(0.0)


def homography_point(x: Column, y: Column, h: Column) -> tuple[Column, Column]:
    """A point mapped by a 3 x 3 matrix (array of 9, row-major) and divided by its last coordinate."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def normalise_homogeneous(coords: Column) -> Column:
    """An array divided by its last element, unless that is nearly zero."""
    last = F.element_at(coords, -1)
    return F.when(F.abs(last) > 2.220446049250313e-16, F.transform(coords, lambda c: c / last)).otherwise(coords)


def collinear(p1: Column, p2: Column, p3: Column, homogeneous: bool = False, eps: float = 2.220446049250313e-16) -> Column:
    """Are three points (arrays of 2, or of 3 if homogeneous) on a line?"""
    if homogeneous:
        cross = [p1[1] * p2[2] - p1[2] * p2[1], p1[2] * p2[0] - p1[0] * p2[2], p1[0] * p2[1] - p1[1] * p2[0]]
        return F.abs(cross[0] * p3[0] + cross[1] * p3[1] + cross[2] * p3[2]) < eps
    return F.abs((p2[0] - p1[0]) * (p3[1] - p1[1]) - (p2[1] - p1[1]) * (p3[0] - p1[0])) < eps


def degenerate(points: list[Column], others: list[Column]) -> Column:
    """Any three of four points on a line, in either image."""
    triples = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    tests = [collinear(*(side[i] for i in t)) for side in (points, others) for t in triples]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def spread(points: list[Column]) -> Column:
    """Width plus height of the bounding box of a few points."""
    return sum((F.greatest(*(p[i] for p in points)) - F.least(*(p[i] for p in points)) for i in (0, 1)), F.lit(0.0))


def too_dense(points: list[Column], others: list[Column], threshold: float) -> Column:
    """Are the samples closer together than ``threshold`` in either image?"""
    return F.least(spread(points), spread(others)) < threshold


def transfer_error(x1: Column, y1: Column, x2: Column, y2: Column, h: Column, h_inv: Column) -> Column:
    """Symmetric squared transfer error of a correspondence."""
    ax, ay = homography_point(x1, y1, h)
    bx, by = homography_point(x2, y2, h_inv)
    return (ax - x2) ** 2 + (ay - y2) ** 2 + (bx - x1) ** 2 + (by - y1) ** 2


def inverse3(h: Column) -> Column:
    """Inverse of a 3 x 3 matrix in closed form; null if it is singular."""
    c = [
        h[4] * h[8] - h[5] * h[7], h[2] * h[7] - h[1] * h[8], h[1] * h[5] - h[2] * h[4],
        h[5] * h[6] - h[3] * h[8], h[0] * h[8] - h[2] * h[6], h[2] * h[3] - h[0] * h[5],
        h[3] * h[7] - h[4] * h[6], h[1] * h[6] - h[0] * h[7], h[0] * h[4] - h[1] * h[3],
    ]
    det = h[0] * c[0] + h[1] * c[3] + h[2] * c[6]
    return F.when(det != 0, F.transform(F.array(*c), lambda x: x / det))


def bilinear(x: Column, y: Column, x0: Column, y0: Column, width: float, height: float) -> Column:
    """Weights of a cell's corners (00, 01, 10, 11) for a point in an axis-aligned cell; null outside."""
    u, v = (x - x0) / width, (y - y0) / height
    inside = u.between(0, 1) & v.between(0, 1)
    return F.when(inside, F.array((1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v))


def in_triangle(px: Column, py: Column, a: tuple, b: tuple, c: tuple) -> Column:
    """Barycentric test, edges included."""
    d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    s = ((b[1] - c[1]) * (px - c[0]) + (c[0] - b[0]) * (py - c[1])) / d
    t = ((c[1] - a[1]) * (px - c[0]) + (a[0] - c[0]) * (py - c[1])) / d
    return (s >= 0) & (t >= 0) & (s + t <= 1)


def in_quad(px: Column, py: Column, v00: tuple, v01: tuple, v10: tuple, v11: tuple) -> Column:
    return in_triangle(px, py, v00, v01, v11) | in_triangle(px, py, v00, v10, v11)


def quad_bounds(v00: tuple, v01: tuple, v10: tuple, v11: tuple) -> tuple[Column, Column, Column, Column]:
    """Least and greatest x, least and greatest y of a quad's corners."""
    xs, ys = zip(v00, v01, v10, v11, strict=True)
    return F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)


#: The four conventions in use at cell edges: what is taken off first, and whether a cell ends at its upper edge.
CELL_CONVENTIONS = [(0.0, False), (0.001, False), (0.0, True), (0.0001, False)]


def cell_of(x: Column, y: Column, cell_width: float, cell_height: float, cells: int, eps: float = 0.0, upper: bool = False) -> tuple[Column, Column]:
    """1-based (row, col) of the mesh cell of a point, clamped to the mesh.  A point on an edge
    belongs to the next cell, or with ``upper`` to the one that ends there; ``eps`` is taken off before."""
    near = (lambda v, size: F.ceil((v - eps) / size)) if upper else (lambda v, size: F.floor((v - eps) / size) + 1)
    at = lambda v, size: F.least(F.greatest(near(v, size), F.lit(1)), F.lit(cells)).cast("int")
    return at(y, cell_height), at(x, cell_width)


def smooth_weight(v1: tuple, v2: tuple, v3: tuple) -> tuple[Column, Column]:
    """Coordinates (u, v) of v1 in the frame of the edge v2 -> v3 and its normal."""
    ex, ey = v3[0] - v2[0], v3[1] - v2[1]
    dx, dy = v1[0] - v2[0], v1[1] - v2[1]
    n = ex * ex + ey * ey
    return (dx * ex + dy * ey) / n, (dx * ey - dy * ex) / n


def hat(v: Column) -> Column:
    """The skew matrix (row-major) of a 3-vector."""
    zero = F.lit(0.0)
    return F.array(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


def unhat(m: Column) -> Column:
    return F.array((m[7] - m[5]) / 2, (m[2] - m[6]) / 2, (m[3] - m[1]) / 2)


def rodrigues(v: Column) -> Column:
    """Rotation matrix (row-major) of an axis-angle vector."""
    t = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    s = F.when(t > 0, F.sin(t) / t).otherwise(1.0)
    c = F.when(t > 0, (1 - F.cos(t)) / (t * t)).otherwise(0.5)
    x, y, z = v[0], v[1], v[2]
    return F.array(
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    )


def inverse_rodrigues(m: Column) -> Column:
    """Axis-angle vector of a rotation matrix, for angles below pi."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2))
    t = F.acos(cos)
    f = F.when(t < 1e-12, 0.5).otherwise(t / (2 * F.sin(t)))
    return F.array(f * (m[7] - m[5]), f * (m[2] - m[6]), f * (m[3] - m[1]))


def rodrigues_jacobian(v: Column) -> Column:
    """Derivatives of :func:`rodrigues`: entry 3 i + k is that of matrix entry i along coordinate k."""
    t2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    t = F.sqrt(t2)
    s = F.when(t > 0, F.sin(t) / t).otherwise(1.0)
    c = F.when(t > 0, (1 - F.cos(t)) / t2).otherwise(0.5)
    # slopes of s and c along a coordinate, over that coordinate
    ds = F.when(t > 0, (F.cos(t) - s) / t2).otherwise(-1 / 3)
    dc = F.when(t > 0, (s - 2 * c) / t2).otherwise(-1 / 12)
    out = []
    for i in range(3):
        for j in range(3):
            axis = 3 - i - j
            sign = 0 if i == j else (-1 if (j - i) % 3 == 1 else 1)
            for k in range(3):
                # the symmetric part c (v v' - t^2 I), then the skew part s [v]x
                product = (v[j] if k == i else F.lit(0.0)) + (v[i] if k == j else F.lit(0.0))
                term = dc * v[k] * v[i] * v[j] + c * product
                if i == j:
                    term = term - dc * v[k] * t2 - 2 * c * v[k]
                else:
                    term = term + sign * (ds * v[k] * v[axis] + (s if k == axis else F.lit(0.0)))
                out.append(term)
    return F.array(*out)


def affine_jacobian(x: Column) -> Column:
    """Derivatives (2 rows of 6, row-major) of :func:`affine` by the matrix's entries and the translation's."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(x[0], x[1], zero, zero, one, zero, zero, zero, x[0], x[1], zero, one)


def affine(a: Column, t: Column, x: Column) -> Column:
    """A 2 x 2 matrix (row-major) and a translation applied to a point."""
    return F.array(a[0] * x[0] + a[1] * x[1] + t[0], a[2] * x[0] + a[3] * x[1] + t[1])


def tps_basis(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Thin-plate basis U = r^2 log r^2, 0 at r = 0."""
    r2 = (x - cx) ** 2 + (y - cy) ** 2
    return F.when(r2 > 0, r2 * F.log(r2)).otherwise(0.0)


def frame_to_ellipse(f: Column) -> Column:
    """A point (2), disc (3), oriented disc (4), ellipse (5) or oriented ellipse (6) as the latter."""
    zero = F.lit(0.0)
    s11, s12, s22 = f[2], f[3], f[4]
    a = F.sqrt(s11)
    return (
        F.when(F.size(f) == 2, F.array(f[0], f[1], zero, zero, zero, zero))
        .when(F.size(f) == 3, F.array(f[0], f[1], f[2], zero, zero, f[2]))
        .when(F.size(f) == 4, F.array(f[0], f[1], f[2] * F.cos(f[3]), f[2] * F.sin(f[3]), -f[2] * F.sin(f[3]), f[2] * F.cos(f[3])))
        .when(F.size(f) == 5, F.array(f[0], f[1], a, s12 / a, zero, F.sqrt(F.greatest(s22 - s12 * s12 / s11, zero))))
        .otherwise(f)
    )


def region_transpose(f: Column) -> Column:
    """Swap x and y of an extremal region's ellipse."""
    return F.array(f[1], f[0], f[4], f[3], f[2])


#: The CIE RGB to XYZ matrix (row-major) and the E white point.
RGB_TO_XYZ = [0.4887180, 0.3106803, 0.2006017, 0.1762044, 0.8129847, 0.0108109, 0.0, 0.0102048, 0.9897952]
WHITE = [1.0, 1.0, 1.0]


def rgb_to_xyz(r: Column, g: Column, b: Column, matrix: list[float] = RGB_TO_XYZ) -> tuple[Column, Column, Column]:
    rows = [matrix[3 * i : 3 * i + 3] for i in range(3)]
    return tuple(m[0] * r + m[1] * g + m[2] * b for m in rows)


def xyz_to_rgb(x: Column, y: Column, z: Column, matrix: list[float] = RGB_TO_XYZ) -> tuple[Column, Column, Column]:
    import numpy as np

    return rgb_to_xyz(x, y, z, np.linalg.inv(np.array(matrix).reshape(3, 3)).ravel().tolist())


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise((903.3 * t + 16) / 116)


def xyz_to_lab(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    fx, fy, fz = (_lab_f(v / w) for v, w in zip((x, y, z), WHITE, strict=True))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def xyz_to_luv(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    down = x + 15 * y + 3 * z
    u, v = F.when(down > 0, 4 * x / down).otherwise(0.0), F.when(down > 0, 9 * y / down).otherwise(0.0)
    whole = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    light = 116 * _lab_f(y / WHITE[1]) - 16
    return light, 13 * light * (u - 4 * WHITE[0] / whole), 13 * light * (v - 9 * WHITE[1] / whole)


def is_black(r: Column, g: Column, b: Column) -> Column:
    return (r == 0) & (g == 0) & (b == 0)
