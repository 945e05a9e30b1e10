"""Frames of video files, without a codec: the sample tables of MP4 containers as a Spark data source, and a writer.

A motion-JPEG track's samples are whole images, so a frame is a range of bytes that the
container's tables give.  Files are planned by size: small ones share a partition, a large one is
cut into ranges of frames, and no byte outside the wanted frames is read.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackloom.plans.stages import forget_at_exit

SCHEMA = "path string, frame_idx int, pts double, length long, content binary"
_ARROW = pa.schema([("path", pa.string()), ("frame_idx", pa.int32()), ("pts", pa.float64()), ("length", pa.int64()), ("content", pa.binary())])
#: Boxes that hold boxes, on the way to a track's tables.
_HOLD = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


# --- container -------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def container(samples: list[bytes], width: int = 0, height: int = 0, rate: int = 25, chunk: int = 16) -> bytes:
    """An MP4 file with one video track of the samples, ``chunk`` of them in a chunk."""
    start = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    data = b"".join(samples)
    head = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + len(data))
    at, offsets = len(start) + len(head), []
    for k in range(0, len(samples), chunk):
        offsets.append(at)
        at += sum(map(len, samples[k : k + chunk]))
    whole, rest = divmod(len(samples), chunk)
    runs = ([(1, chunk)] if whole else []) + ([(whole + 1, rest)] if rest else [])
    entry = struct.pack(">I", 86) + b"jpeg" + b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 16 + struct.pack(">HHII", width, height, 72 << 16, 72 << 16) + b"\0" * 4 + struct.pack(">H", 1) + b"\0" * 32 + struct.pack(">Hh", 24, -1)
    tables = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, len(samples), 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
        _full(b"stsz", struct.pack(">II", 0, len(samples)), *(struct.pack(">I", len(s)) for s in samples)), _full(b"co64", struct.pack(">I", len(offsets)), *(struct.pack(">Q", o) for o in offsets)),
    )
    unit = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    header = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, len(samples), 0x55C4, 0))
    handler = _full(b"hdlr", struct.pack(">I", 0), b"vide", b"\0" * 12, b"video\0")
    track = _box(b"trak", _box(b"tkhd", b"\0\0\0\3", struct.pack(">IIIII", 0, 0, 1, 0, len(samples)), b"\0" * 16, unit, struct.pack(">II", width << 16, height << 16)), _box(b"mdia", header, handler, _box(b"minf", _full(b"vmhd", b"\0" * 8), tables)))
    movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, len(samples), 1 << 16, 1 << 8), b"\0" * 10, unit, b"\0" * 24, struct.pack(">I", 2))
    return start + head + data + _box(b"moov", movie, track)


def _boxes(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", raw[at + 8 : at + 16])[0], 16
        size = size or len(raw) - at
        if size < head or at + size > len(raw):
            raise ValueError(f"box {kind!r} of {size} bytes does not fit")
        yield kind, raw[at + head : at + size]
        at += size


def movie_box(file: pa.NativeFile, size: int) -> bytes:
    """The ``moov`` box's content, found by the sizes of the boxes before it; media data are passed over."""
    at = 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(16)
        n, kind, skip = struct.unpack(">I", head[:4])[0], head[4:8], 8
        if n == 1:
            n, skip = struct.unpack(">Q", head[8:16])[0], 16
        n = n or size - at
        if n < skip or at + n > size:
            break
        if kind == b"moov":
            file.seek(at + skip)
            return file.read(n - skip)
        at += n
    raise ValueError("no movie box")


def sample_table(movie: bytes) -> list[tuple[int, int, float]]:
    """``(offset, length, seconds)`` of every sample of the first video track."""

    def tracks(raw: bytes) -> Iterator[dict[bytes, bytes]]:
        for kind, body in _boxes(raw):
            if kind == b"trak":
                found: dict[bytes, bytes] = {}
                todo = [body]
                while todo:
                    for k, b in _boxes(todo.pop()):
                        if k in _HOLD:
                            todo.append(b)
                        else:
                            found[k] = b
                yield found

    track = next((t for t in tracks(movie) if t.get(b"hdlr", b"")[8:12] == b"vide"), None)
    if track is None:
        return []
    numbers = lambda kind, form, skip: list(struct.iter_unpack(form, track[kind][skip : skip + struct.unpack(">I", track[kind][skip - 4 : skip])[0] * struct.calcsize(form)]))
    fixed, n = struct.unpack(">II", track[b"stsz"][4:12])
    sizes = [fixed] * n if fixed else [s for (s,) in numbers(b"stsz", ">I", 12)]
    offsets = [o for (o,) in (numbers(b"co64", ">Q", 8) if b"co64" in track else numbers(b"stco", ">I", 8))]
    runs = numbers(b"stsc", ">III", 8)
    clock = track[b"mdhd"]
    scale = struct.unpack(">I", clock[20:24] if clock[0] else clock[12:16])[0] or 1
    steps = itertools.chain.from_iterable(itertools.repeat(step, count) for count, step in numbers(b"stts", ">II", 8))
    out, time, number = [], 0, 0
    for r, (first, per, _) in enumerate(runs):
        last = runs[r + 1][0] - 1 if r + 1 < len(runs) else len(offsets)
        for at in offsets[first - 1 : last]:
            for size in sizes[number : number + per]:
                out.append((at, size, time / scale))
                at, time = at + size, time + next(steps, 0)
                number += 1
    return out


# --- source ----------------------------------------------------------------


@dataclass
class FrameRange(InputPartition):
    """Files ``(path, size, first, last)``: frames from first to last, or all (last -1)."""

    files: tuple[tuple[str, int, int, int], ...]


class VideoReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.low, self.high = options["path"], int(options.get("first", 1)), int(options.get("last", (1 << 31) - 1))
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))

    def partitions(self) -> list[FrameRange]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        every = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        low, high = max(self.low, 1), self.high
        out, group, held = [], [], 0
        for path, size in sorted((i.path, i.size) for i in every if i.type == pafs.FileType.File and i.path.lower().endswith((".mp4", ".mov", ".m4v"))):
            if size > self.partition_bytes:  # ranges of frames that share no byte
                with fs.open_input_file(path) as file:
                    samples = sample_table(movie_box(file, size))
                first, bytes_ = low, 0
                for number in range(low, min(high, len(samples)) + 1):
                    bytes_ += samples[number - 1][1]
                    if bytes_ >= self.partition_bytes or number == min(high, len(samples)):
                        out.append(FrameRange(((path, size, first, number),)))
                        first, bytes_ = number + 1, 0
                continue
            if group and held + size > self.partition_bytes:
                out.append(FrameRange(tuple(group)))
                group, held = [], 0
            group.append((path, size, 1, -1))
            held += size
        if group:
            out.append(FrameRange(tuple(group)))
        return out or [FrameRange(())]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        low, high = max(self.low, 1), self.high
        for path, size, first, last in partition.files:
            with fs.open_input_file(path) as file:
                samples = sample_table(movie_box(file, size))
                rows, held = [], 0
                for number in range(max(first, low), min(last if last >= 0 else len(samples), high, len(samples)) + 1):
                    at, length, seconds = samples[number - 1]
                    file.seek(at)
                    rows.append({"path": path, "frame_idx": number, "pts": seconds, "length": length, "content": file.read(length)})
                    held += length
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)


class VideoDataSource(DataSource):
    """``spark.read.format("mp4frames").load(uri)``: a row for each frame of an MP4 file, or of those below a folder."""

    @classmethod
    def name(cls) -> str:
        return "mp4frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoReader:  # noqa: ARG002
        return VideoReader(self.options)


def read_video(spark: SparkSession, path: str, first: int = 1, last: int | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """``path, frame_idx, pts, length, content``: the frames, numbered from 1, of the MP4 files at a URI.

    ``first`` and ``last`` reach the planning: other frames' bytes are not read.  They are options and no
    pushed filters, as Spark keeps what a Python source was once pushed for all later uses of the same
    DataFrame.  Files without a video track have no frames; a file that is no container raises.
    """
    spark.dataSource.register(VideoDataSource)
    reader = spark.read.format("mp4frames").option("partitionBytes", partition_bytes).option("first", first)
    return (reader if last is None else reader.option("last", last)).load(path)


def write_videos(frames: DataFrame, path: str, clip: str = "clip", index: str = "frame_idx", content: str = "content", rate: int = 25) -> DataFrame:
    """``clip, frames, path``: a motion-JPEG file ``<clip>.mp4`` for the frames of each clip, in order; null contents are empty.

    A clip is written by one task, whole, so a task that runs again changes nothing; the
    files are written here, once.
    """

    def put(rows: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        rows, name = rows.sort_by("i"), rows.column("clip")[0].as_py()
        with fs.open_output_stream(f"{root}/{name}.mp4", compression=None) as out:
            out.write(container([c or b"" for c in rows.column("raw").to_pylist()], rate=rate))
        return pa.table({"clip": pa.array([name], pa.int64()), "frames": pa.array([rows.num_rows], pa.int64()), "path": pa.array([f"{root}/{name}.mp4"])})

    kept = frames.select(F.col(clip).cast("long").alias("clip"), F.col(index).cast("long").alias("i"), F.col(content).cast("binary").alias("raw")).where("clip IS NOT NULL AND i IS NOT NULL")
    made = kept.groupBy("clip").applyInArrow(put, "clip long, frames long, path string")
    listed = f"{path}-list"
    made.write.mode("overwrite").parquet(listed)
    forget_at_exit(frames.sparkSession, listed)
    return frames.sparkSession.read.parquet(listed)
