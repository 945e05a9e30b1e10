"""Points followed over streams of images."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_more import collected, stream_of

from trackloom.operators import klt
from trackloom.operators.features import blurred, sampled
from trackloom.streaming import tracks as R

KINDS = "batch int, clip long, frame long, height int, width int, pixels binary"


def scene(seed=0, side=220):
    big = blurred(np.random.RandomState(seed).rand(side, side), 2.0)
    return (big - big.min()) / (big.max() - big.min()) * 255


def view(big, dx, dy, h=90, w=110):
    yy, xx = np.mgrid[:h, :w].astype(float)
    return np.round(sampled(big, 30 + dy + yy, 40 + dx + xx)).astype(np.uint8)


def clip(big, n, step, number=1, batch=lambda f: f):
    return [(batch(f), number, f, 90, 110, bytearray(view(big, f * step[0], f * step[1]).tobytes())) for f in range(n)]


def test_registration_finds_what_an_exhaustive_search_finds():
    big = scene(3)
    a, b = view(big, 0, 0), view(big, 4, -6)
    points = klt.new_points(a, np.zeros((0, 2)), 4, 48)
    points = points[(points >= 20).all(1) & (points[:, 0] < 90) & (points[:, 1] < 70)]
    found, error = klt.tracked(a, b, points)
    h = klt.HALF
    assert len(points) > 15 and (error <= 1).mean() > 0.85
    for p, q in zip(points[error <= 1].astype(int), found[error <= 1], strict=True):
        window = a[p[1] - h : p[1] + h + 1, p[0] - h : p[0] + h + 1].astype(float)
        gaps = {(dx, dy): np.abs(b[p[1] + dy - h : p[1] + dy + h + 1, p[0] + dx - h : p[0] + dx + h + 1] - window).sum() for dx in range(-9, 10) for dy in range(-9, 10)}
        best = min(gaps, key=gaps.get)
        assert np.abs(q - p - best).max() < 0.1
    _, lost = klt.tracked(a, np.zeros_like(a), points)
    assert (lost > 1).all()


def test_refilled_cells():
    image = view(scene(1), 0, 0)
    first = klt.new_points(image, np.zeros((0, 2)), 4, 64)
    per = collections.Counter((int(y * 4 // 90), int(x * 4 // 110)) for x, y in first)
    assert len(per) == 16 and max(per.values()) == 4
    assert len(klt.new_points(image, first, 4, 64)) == 0
    kept = np.array([p for p in first if p[0] >= 55])
    again = klt.new_points(image, kept, 4, 64)
    assert len(again) and (again[:, 0] < 55 + 110 / 4).all()
    assert len(klt.new_points(np.full((40, 40), 7, np.uint8), np.zeros((0, 2)), 4, 64)) == 0


@pytest.mark.parametrize("restart", [False, True])
def test_a_moving_image_is_followed(spark, tmp_path, restart):
    rows = clip(scene(0), 7, (2.5, -1.25)) + clip(scene(5), 7, (-1.0, 2.0), number=2)
    df = spark.createDataFrame(rows, KINDS)
    if restart:  # the second run goes on from the checkpoint of the first
        for i in range(4):
            df.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "clips"))
        stream = lambda: R.track_points(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "clips")), 4, 64)
        collected(spark, tmp_path, stream(), "points")
        for i in range(4, 7):
            df.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "clips"))
        got = collected(spark, tmp_path, stream(), "points").collect()
    else:
        got = collected(spark, tmp_path, R.track_points(stream_of(spark, tmp_path, df, "clips", 7), 4, 64), "points").collect()
    assert {(r["clip"], r["frame"]) for r in got} == {(c, f) for c in (1, 2) for f in range(7)}
    for number, step in ((1, (2.5, -1.25)), (2, (-1.0, 2.0))):
        moved = np.array([(r["x"] - r["px"] + step[0], r["y"] - r["py"] + step[1]) for r in got if r["clip"] == number and r["px"] is not None])
        assert len(moved) > 200 and np.percentile(np.abs(moved), 90) < 0.1
        at = {(r["track_id"], r["frame"]): r for r in got if r["clip"] == number}
        assert len(at) == sum(r["clip"] == number for r in got)
        for (track, frame), r in at.items():
            if r["px"] is None:
                assert r["age"] == 1 and (track, frame - 1) not in at
            else:
                before = at[track, frame - 1]
                assert (before["x"], before["y"], before["age"]) == (r["px"], r["py"], r["age"] - 1) and r["error"] <= 1
        assert max(r["age"] for r in at.values()) == 7


def test_old_late_and_other_frames(spark, tmp_path):
    big = scene(2)
    rows = [(0, *r[1:]) for r in reversed(clip(big, 4, (1.0, 0.0)))]  # one batch, any order
    rows += [(1, 1, 2, 90, 110, rows[0][5]), (1, 1, 4, 60, 50, bytearray(view(big, 0, 0, 60, 50).tobytes()))]
    got = collected(spark, tmp_path, R.track_points(stream_of(spark, tmp_path, spark.createDataFrame(rows, KINDS), "clips", 2), 4, 32, max_age=3), "points").collect()
    frames = collections.Counter(r["frame"] for r in got)
    assert set(frames) == set(range(5)) and max(r["age"] for r in got) == 3
    assert all(r["age"] == 1 for r in got if r["frame"] == 4)


def test_an_idle_clip_begins_anew(spark, tmp_path):
    """Its state goes with the watermark."""
    big = scene(4)
    own, other = clip(big, 3, (1.0, 0.0)), clip(big, 4, (0.0, 0.0), number=2)
    at = lambda row, batch, minute: (batch, *row[1:], f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00")
    rows = [at(own[0], 0, 0), at(own[1], 1, 1), at(other[0], 2, 300), at(other[1], 3, 301), at(own[2], 4, 302)]
    df = spark.createDataFrame(rows, f"{KINDS}, at string").withColumn("at", F.to_timestamp("at"))
    got = collected(spark, tmp_path, R.track_points(stream_of(spark, tmp_path, df, "clips", 5), 4, 32, ts="at", idle_ms=600_000), "points").where("clip = 1")
    ages = {r["frame"]: r["age"] for r in got.groupBy("frame").agg(F.max("age").alias("age")).collect()}
    assert ages == {0: 1, 1: 2, 2: 1}


def test_tracked_points_carry_matches(spark, tmp_path):
    """Two views of a scene; matches begin at the first frame's points and are carried to the last."""
    big, n = scene(8), 5
    sides = []
    for name, off in (("left", 0), ("right", 12)):
        rows = [(f, 1, f, 90, 110, bytearray(view(big, off + 1.5 * f, f).tobytes())) for f in range(n)]
        stream = stream_of(spark, tmp_path, spark.createDataFrame(rows, KINDS), name, n)
        sides.append(collected(spark, tmp_path, R.track_points(stream, 4, 64), name))
    first = [[(r["x"], r["y"]) for r in s.where("frame = 0").collect()] for s in sides]
    fresh = [(xa, ya, xb, yb) for xa, ya in first[0] for xb, yb in first[1] if abs(xa - 12 - xb) < 0.5 and abs(ya - yb) < 0.5]
    assert len(fresh) > 10
    match = "array<struct<xa: double, ya: double, xb: double, yb: double>>"
    begun = spark.createDataFrame([(1, 0, fresh)], f"clip long, frame long, fresh {match}")
    moves = R.moves_of(*sides).join(begun, ["clip", "frame"], "full").withColumn("batch", F.col("frame").cast("int"))
    out = collected(spark, tmp_path, R.propagate_matches(stream_of(spark, tmp_path, moves, "moves", n)), "matches").collect()
    last = [r for r in out if r["frame"] == n - 1]
    assert len(last) > 0.4 * len(fresh) and all(abs(r["xa"] - 12 - r["xb"]) < 0.7 and abs(r["ya"] - r["yb"]) < 0.7 for r in last)
