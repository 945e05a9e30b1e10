"""Frames of video files by their sample tables."""

from __future__ import annotations

import io
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.sources import video as V


def samples(n, seed=0, size=900):
    rnd = random.Random(seed)
    return [b"\xff\xd8" + rnd.randbytes(rnd.randrange(size)) + b"\xff\xd9" for _ in range(n)]


def write(folder, **clips):
    for name, raw in clips.items():
        (folder / f"{name}.mp4").write_bytes(raw)
    return f"file://{folder}"


@pytest.mark.parametrize("n,chunk", [(1, 16), (16, 16), (33, 16), (50, 1), (7, 100)])
def test_tables_of_a_container(n, chunk):
    frames = samples(n)
    raw = V.container(frames, 64, 48, rate=10, chunk=chunk)
    file = pa.PythonFile(io.BytesIO(raw), mode="r")
    table = V.sample_table(V.movie_box(file, len(raw)))
    assert [raw[at : at + length] for at, length, _ in table] == frames
    assert [t for *_, t in table] == [i / 10 for i in range(n)]


def test_other_forms_of_tables():
    """32-bit offsets, sizes all alike, uneven steps, a sound track before the video, the movie in front."""
    full, box = V._full, V._box
    frames = [bytes([65 + i]) * 5 for i in range(6)]

    def movie(at):
        tables = box(b"stbl", full(b"stts", struct.pack(">IIIII", 2, 2, 3, 4, 1)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 3, 1, 1)), full(b"stsz", struct.pack(">II", 5, 6)), full(b"stco", struct.pack(">IIIII", 4, at, at + 10, at + 20, at + 25)))
        track = lambda kind, tables: box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 2, 10)), full(b"hdlr", b"\0\0\0\0", kind), box(b"minf", tables)))
        return box(b"moov", track(b"soun", box(b"stbl")), track(b"vide", tables))

    raw = movie(len(movie(0)) + 8) + box(b"mdat", *frames)
    table = V.sample_table(V.movie_box(pa.PythonFile(io.BytesIO(raw), mode="r"), len(raw)))
    assert [raw[a : a + n] for a, n, _ in table] == frames and [t for *_, t in table] == [0, 1.5, 3, 3.5, 4, 4.5]
    silent = box(b"moov", box(b"trak", box(b"mdia", full(b"hdlr", b"\0\0\0\0", b"soun"))))
    assert V.sample_table(silent[8:]) == []
    for broken in (b"", b"no container at all, just text", struct.pack(">I", 4000) + b"moov"):
        with pytest.raises(ValueError):
            V.movie_box(pa.PythonFile(io.BytesIO(broken), mode="r"), len(broken))


def test_frames_come_back_by_ranges(spark, tmp_path):
    a, b = samples(200, 1), samples(3, 2)
    path = write(tmp_path, a=V.container(a), b=V.container(b), none=V.container([]))
    for size in (64 << 20, 20_000):
        df = V.read_video(spark, path, partition_bytes=size)
        got = {(r["path"].rsplit("/", 1)[1], r["frame_idx"]): r["content"] for r in df.collect()}
        assert got == {("a.mp4", i + 1): bytearray(x) for i, x in enumerate(a)} | {("b.mp4", i + 1): bytearray(x) for i, x in enumerate(b)}
    assert V.read_video(spark, path, partition_bytes=20_000).rdd.getNumPartitions() >= 5
    assert V.read_video(spark, f"{path}/b.mp4").count() == 3


def test_only_the_wanted_frames_are_planned(spark, tmp_path):
    a = samples(100, 3)
    path = write(tmp_path, a=V.container(a), b=V.container(a[:20]))
    for first, last, size in ((90, None, 5000), (10, 12, 5000), (1, 1, 64 << 20), (50, 400, 64 << 20), (101, None, 5000), (3, 2, 5000)):
        got = sorted((r["path"][-5], r["frame_idx"]) for r in V.read_video(spark, path, first, last, size).collect())
        assert got == [(n, i) for n, most in (("a", 100), ("b", 20)) for i in range(first, min(last or most, most) + 1)]
    df = V.read_video(spark, path, partition_bytes=5000)
    assert V.read_video(spark, path, 96, partition_bytes=5000).rdd.getNumPartitions() < df.rdd.getNumPartitions()
    # a DataFrame may be used again after a condition
    assert df.where("frame_idx = 7").count() == 2 and df.count() == 120


def test_videos_are_written_by_clip(spark, tmp_path):
    frames = spark.createDataFrame([(c, i, f"{c}-{i}".encode() * (i % 5)) for c in (1, 2) for i in range(40)] + [(None, 1, b"x"), (3, 9, None)], "clip long, frame_idx long, content binary").repartition(4)
    listed = V.write_videos(frames, f"file://{tmp_path}/out")
    assert {(r["clip"], r["frames"]) for r in listed.collect()} == {(1, 40), (2, 40), (3, 1)}
    got = V.read_video(spark, f"file://{tmp_path}/out").select(F.regexp_extract("path", r"(\d+)\.mp4", 1).cast("int").alias("c"), "frame_idx", "content").collect()
    assert {(r["c"], r["frame_idx"]): bytes(r["content"]) for r in got} == {(c, i + 1): f"{c}-{i}".encode() * (i % 5) for c in (1, 2) for i in range(40)} | {(3, 1): b""}
