"""Frames, images and caches: sources and sinks of the pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frames(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """``frame_idx, path, length, content`` of a folder of numbered images.

    The index is read from the file's name, never from the order of a listing.
    Files without a number have a null index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[.][^./]*$', 1) AS int)")
    return files.select(number.alias("frame_idx"), "path", "length", "content")


def zip_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of two clips with the same index, side by side."""
    return a.select("frame_idx", F.col("content").alias("content_a")).join(b.select("frame_idx", F.col("content").alias("content_b")), "frame_idx")


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """``path, y, x, v``: images as gray pixels in [0, 1] (luminance of the first three channels)."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for origin, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(float) / 255
                gray = px[..., 0] if n == 1 else 0.114 * px[..., 0] + 0.587 * px[..., 1] + 0.299 * px[..., 2]
                yy, xx = np.mgrid[:h, :w].astype(np.int32)
                yield pa.record_batch({"path": pa.array([origin] * (h * w)), "y": pa.array(yy.ravel()), "x": pa.array(xx.ravel()), "v": pa.array(gray.ravel())})

    return img.select("origin", "height", "width", "nChannels", "data").mapInArrow(unpack, "path string, y int, x int, v double")


def bitmap(rows: list[list[tuple[int, int, int]]]) -> bytes:
    """A 24-bit bitmap file of rows of (red, green, blue)."""
    import struct

    height, width = len(rows), len(rows[0])
    pad = b"\0" * (-3 * width % 4)
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + pad for row in reversed(rows))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_frames(frames: DataFrame, path: str, name: str = "%d.jpg", index: str = "frame_idx", content: str = "content") -> DataFrame:
    """Write each row's bytes to a file named by its index, and list what was written.

    Files are replaced whole, so a task that runs again changes nothing.  The
    write happens when the result is used.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            made = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or raw is None:
                    continue
                with fs.open_output_stream(f"{root}/{name % i}", compression=None) as out:
                    out.write(raw)
                made.append((i, f"{root}/{name % i}", len(raw)))
            yield pa.record_batch({"frame_idx": pa.array([m[0] for m in made], pa.int64()), "path": pa.array([m[1] for m in made], pa.string()), "length": pa.array([m[2] for m in made], pa.int64())})

    return frames.select(F.col(index).cast("long"), F.col(content).cast("binary")).mapInArrow(put, "frame_idx long, path string, length long")


def read_keypoints(spark: SparkSession, path: str, form: str = "ubc") -> DataFrame:
    """``path, k, frame, descriptor`` from keypoint text files.

    ``ubc``: after the number of points and the descriptor's length, a point
    has row, column, scale and angle; it becomes x, y (from 1), scale and the
    negated angle, and the bins of each of the 16 histograms run the other way
    round.  ``oxford``: the length comes first; a point has x, y and the three
    entries of a symmetric matrix, which is inverted.
    """
    n_frame = {"ubc": 4, "oxford": 5}[form]
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("t"))
    first, second = F.element_at("t", 1).cast("double").cast("int"), F.element_at("t", 2).cast("double").cast("int")
    n, length = (first, second) if form == "ubc" else (second, first)
    size = F.col("length") + n_frame
    points = text.select("path", "t", n.alias("n"), length.alias("length")).where("n > 0").select("path", "t", "length", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    cut = points.select("path", "k", F.transform(F.slice("t", 3 + F.col("k") * size, size), lambda x: x.cast("double")).alias("r"), "length")
    raw = F.transform(F.slice("r", n_frame + 1, F.col("length")), lambda x: x.cast("int"))
    r = F.col("r")
    if form == "oxford":
        det = r[2] * r[4] - r[3] * r[3]
        return cut.select("path", "k", F.array(r[0] + 1, r[1] + 1, r[4] / det, -r[3] / det, r[2] / det).alias("frame"), raw.alias("descriptor"))
    turned = F.transform(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.element_at("d", (i - i % 8 + (8 - i % 8) % 8 + 1).cast("int")))
    return cut.select("path", "k", F.array(r[1] + 1, r[0] + 1, r[2], -r[3]).alias("frame"), raw.alias("d")).select("path", "k", "frame", turned.alias("descriptor"))


def read_sequence(spark: SparkSession, path: str, normalise: bool = False, masked: bool = False) -> DataFrame:
    """``track_id, frame, x, y, label`` of a labelled motion sequence kept as Parquet, with ``seen`` if ``masked``.

    ``normalise`` brings coordinates between -1 and 1 by the sequence's own extent.
    Asking for the mask of a sequence without a column ``seen`` raises.
    """
    rows = spark.read.parquet(path)
    if masked and "seen" not in rows.columns:
        raise ValueError(f"no mask for {path}")
    out = rows.select("track_id", "frame", "x", "y", "label", *(["seen"] if masked else []))
    if not normalise:
        return out
    ends = out.agg(*(f(c).alias(f"__{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    both = out.crossJoin(F.broadcast(ends))
    at = lambda c: F.when(F.col(f"__hi{c}") > F.col(f"__lo{c}"), 2 * (F.col(c) - F.col(f"__lo{c}")) / (F.col(f"__hi{c}") - F.col(f"__lo{c}")) - 1).otherwise(0.0)
    return both.withColumns({"x": at("x"), "y": at("y")}).select(*out.columns)


def patterns(sizes: DataFrame, keys: list[str], kinds: list[str], height: str = "height", width: str = "width") -> DataFrame:
    """``keys, kind, y, x, v``: synthetic images of every size: step, ramp, checker, disc or stripes."""
    below = lambda c: F.explode(F.filter(F.sequence(F.lit(0), F.col(c).cast("int")), lambda i: i < F.col(c)))
    grid = sizes.select(*keys, height, width, below(height).alias("y")).select("*", below(width).alias("x")).select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    y, x, h, w = F.col("y"), F.col("x"), F.col(height), F.col(width)
    value: dict[str, Column] = {
        "step": (x >= F.floor(w / 2)).cast("double"), "ramp": x / F.greatest(F.lit(1), w - 1), "checker": ((F.floor(y / 8) + F.floor(x / 8)) % 2).cast("double"),
        "disc": ((y - h / 2) * (y - h / 2) + (x - w / 2) * (x - w / 2) <= F.least(h, w) / 4 * (F.least(h, w) / 4)).cast("double"), "stripes": 0.5 + 0.5 * F.sin(x * 0.5),
    }
    return grid.select(*keys, "kind", "y", "x", F.coalesce(*(F.when(F.col("kind") == k, value[k]) for k in kinds)).alias("v"))


def pattern(spark: SparkSession, kind: str, height: int, width: int) -> DataFrame:
    """``y, x, v``: one synthetic image (:func:`patterns`)."""
    return patterns(spark.createDataFrame([(height, width)], "height int, width int"), [], [kind]).select("y", "x", "v")
