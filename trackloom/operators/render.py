"""Rendering of a moved mesh: the image under each quad's projective map, on a canvas wider than the image.

Quads go to the tiles of the canvas that their boxes touch, and a tile decides for each of its pixels
which quad it shows, so no image and no large quad is in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.images import backward_warp

#: Corners of a quad, around it: row, column.
CORNERS = [(0, 0), (0, 1), (1, 1), (1, 0)]


def quads(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, col, x0, y0 .. x3, y3``: the corners of every cell of ``keys, i, j, x, y``, in order around it;
    cells with a missing corner are none."""
    sent = vertices.select(*keys, "i", "j", "x", "y", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(CORNERS)))).alias("c"))
    sent = sent.select(*keys, (F.col("i") - F.col("c.a")).cast("int").alias("row"), (F.col("j") - F.col("c.b")).cast("int").alias("col"), F.col("c.n").alias("n"), "x", "y")
    corners = [F.max(F.when(F.col("n") == n, F.col(c).cast("double"))).alias(f"{c}{n}") for n in range(4) for c in "xy"]
    return sent.groupBy(*keys, "row", "col").agg(F.count("x").alias("__n"), *corners).where("__n = 4").drop("__n")


def with_maps(cells: DataFrame) -> DataFrame:
    """``cells`` with ``m0 .. m8``, row by row: a matrix from points of a quad to its unit square (0 to 1 along the
    first edge, 0 to 1 along the last), by the closed form of the square's projective map and its adjugate.
    Quads without an area have none."""
    steps = [
        {"__ax": "x1 - x2", "__ay": "y1 - y2", "__bx": "x3 - x2", "__by": "y3 - y2", "__sx": "x0 - x1 + x2 - x3", "__sy": "y0 - y1 + y2 - y3"},
        {"__area": "nullif(__ax * __by - __bx * __ay, 0)"},
        {"__g": "(__sx * __by - __bx * __sy) / __area", "__h": "(__ax * __sy - __sx * __ay) / __area"},
        {"__a": "x1 - x0 + __g * x1", "__b": "x3 - x0 + __h * x3", "__d": "y1 - y0 + __g * y1", "__e": "y3 - y0 + __h * y3"},
        {"m0": "__e - y0 * __h", "m1": "x0 * __h - __b", "m2": "__b * y0 - x0 * __e", "m3": "y0 * __g - __d", "m4": "__a - x0 * __g", "m5": "x0 * __d - __a * y0", "m6": "__d * __h - __e * __g", "m7": "__b * __g - __a * __h", "m8": "__a * __e - __b * __d"},
    ]
    out = cells
    for step in steps:
        out = out.withColumns({name: F.expr(e) for name, e in step.items()})
    return out.drop(*(name for step in steps[:-1] for name in step))


def owners(cells: DataFrame, keys: list[str], height: int, width: int, gap: int = 0, tile: int = 256) -> DataFrame:
    """``keys, y, x, row, col, m0 .. m8``: the cell that each pixel of the canvas shows, from -``gap`` to the side + ``gap``.

    A cell covers its box, from the floor of its least to below the ceiling of its largest
    coordinate; of several the last in order of rows and columns is shown.
    """
    least = lambda c: F.least(*(F.col(f"{c}{n}") for n in range(4)))
    most = lambda c: F.greatest(*(F.col(f"{c}{n}") for n in range(4)))
    box = cells.select("*", *(
        e.cast("int").alias(f"__{n}{c}") for c, side in (("y", height), ("x", width))
        for n, e in (("lo", F.greatest(F.floor(least(c)), F.lit(-gap))), ("hi", F.least(F.ceil(most(c)) - 1, F.lit(side + gap - 1))))
    )).where("__loy <= __hiy AND __lox <= __hix")
    tiles = lambda c: F.explode(F.sequence(F.floor(F.col(f"__lo{c}") / tile).cast("int"), F.floor(F.col(f"__hi{c}") / tile).cast("int")))
    dealt = box.select("*", tiles("y").alias("__ty")).select("*", tiles("x").alias("__tx")).repartition(*keys, "__ty", "__tx")
    inside = lambda c: F.explode(F.sequence(F.greatest(F.col(f"__lo{c}"), F.col(f"__t{c}") * tile), F.least(F.col(f"__hi{c}"), F.col(f"__t{c}") * tile + tile - 1)))
    pixels = dealt.select("*", inside("y").alias("y")).select("*", inside("x").alias("x"))
    shown = pixels.groupBy(*keys, "__ty", "__tx", "y", "x").agg(F.max(F.struct("row", "col", *(f"m{k}" for k in range(9)))).alias("q"))
    return shown.select(*keys, "y", "x", "q.*")


def render(pixels: DataFrame, vertices: DataFrame, keys: list[str], height: int, width: int, cell_height: float, cell_width: float, gap: int = 0, kernel: str = "cubic", tile: int = 256) -> DataFrame:
    """``keys, y, x, v``: images ``keys, y, x, v`` under their moved meshes ``keys, i, j, x, y`` (vertex ``i, j`` was at
    ``j * cell_width, i * cell_height``), by cubic or linear samples; pixels whose sample leaves the image are null."""
    shown = owners(with_maps(quads(vertices, keys)), keys, height, width, gap, tile)
    u, v, w = (F.col(f"m{k}") * F.col("x") + F.col(f"m{k + 1}") * F.col("y") + F.col(f"m{k + 2}") for k in (0, 3, 6))
    # a place that is a pixel but for its last bits is that pixel, also at the image's border
    asked = shown.select(*keys, "y", "x", F.round((F.col("row") + v / w) * cell_height, 9).alias("wy"), F.round((F.col("col") + u / w) * cell_width, 9).alias("wx"))
    near = asked.where(F.col("wy").between(-1, height) & F.col("wx").between(-1, width))
    found = backward_warp(pixels, near, kernel, image=keys).select(*keys, "y", "x", F.nanvl("v", F.lit(None).cast("double")).alias("v"))
    return asked.select(*keys, "y", "x").join(found, [*keys, "y", "x"], "left")
