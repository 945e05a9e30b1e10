"""Stateful operators on streams of points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def track_lifecycle(points: DataFrame, max_age: int = 100, gap: int = 1, ts: str | None = None, late: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """``track_id, head, tail, len`` of every track that ends, for a stream ``track_id, frame``.

    A track is begun by its first point, goes on while frames follow within
    ``gap``, and retires at ``max_age`` frames or when its next point comes later
    than that.  With an event time ``ts`` (rows later than ``late`` are dropped) it
    also ends once the watermark is ``idle_ms`` past its last point, and its
    state goes; without one a track that just stops stays open.  Its state is
    three integers, however long it lives.  Points of one micro-batch may come
    in any order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, tail, last = state.get if state.exists else (None, None, 0)
        ended = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], head, tail, tail - head + 1)], columns=["track_id", "head", "tail", "len"])
            return
        rows = sorted((int(f), int(m)) for pdf in batches for f, m in zip(pdf["frame"], pdf["ms"], strict=True) if pd.notna(f))
        for f, ms in rows:
            last = max(last or 0, ms)
            if head is None:
                head = tail = f
            elif f <= tail:
                continue
            elif f - tail > gap:
                ended.append((head, tail))
                head = tail = f
            else:
                tail = f
            if tail - head + 1 >= max_age:
                ended.append((head, tail))
                head = tail = None
        if head is None:
            if state.exists:
                state.remove()
        else:
            state.update((head, tail, last))
            if ts:
                state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        if ended:
            yield pd.DataFrame([(key[0], a, b, b - a + 1) for a, b in ended], columns=["track_id", "head", "tail", "len"])

    if ts:
        timed = points.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
        rows, timeout = timed.select("track_id", "frame", F.unix_millis("__ts").alias("ms"), "__ts"), GroupStateTimeout.EventTimeTimeout
    else:
        rows, timeout = points.select("track_id", "frame", F.lit(0).cast("long").alias("ms")), GroupStateTimeout.NoTimeout
    return rows.groupBy("track_id").applyInPandasWithState(step, "track_id long, head long, tail long, len long", "head long, tail long, last long", "append", timeout)


def sliding_counts(events: DataFrame, size: str = "40 seconds", hop: str = "20 seconds", late: str = "1 minute", key: str = "event_type") -> DataFrame:
    """Counts and sums in half-overlapping event-time windows; rows later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, hop), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", key, "n", "value")


def _timed(frames: DataFrame, columns: list[str], ts: str | None, late: str) -> tuple[DataFrame, str]:
    """``columns`` and ``ms`` (0 without an event time), and the kind of timeout that goes with them."""
    if not ts:
        return frames.select(*columns, F.lit(0).cast("long").alias("ms")), GroupStateTimeout.NoTimeout
    timed = frames.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.select(*columns, F.unix_millis("__ts").alias("ms"), "__ts"), GroupStateTimeout.EventTimeTimeout


def carry_seams(frames: DataFrame, stable: float = 5.0, ts: str | None = None, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """``clip, frame, mask``: the seam cut of a stream of overlapping frame pairs; 1 where the pixel comes from ``b``.

    ``frames`` are ``clip, frame, height, width, a, b, cover_a, cover_b`` (binary: three
    bytes a pixel, and one).  Frames of a clip come in order.  Each step cuts two
    frames, the first bound to the mask that the step before left it, so a clip
    is one key whose state is one frame and its mask.  The first frame is
    answered with the second.  With an event time ``ts`` (rows later than ``late`` are dropped) the state goes once
    the watermark is ``idle_ms`` past the clip's last frame; without one it stays.
    """
    import numpy as np

    from trackloom.operators.flow import seam

    def unpack(h: int, w: int, raw: tuple) -> list:
        a, b = (np.frombuffer(x, np.uint8).reshape(h, w, 3) for x in raw[:2])
        return [a, b, np.zeros((h, w)), np.zeros((h, w)), *(np.frombuffer(x, np.uint8).reshape(h, w).astype(bool) for x in raw[2:])]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, h, w, *held = state.get if state.exists else (None,) * 9
        seen, mask = (held.pop(), held.pop()) if state.exists else (0, None)
        out = []
        for r in sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r.frame):
            seen = max(seen, int(r.ms))
            now = (bytes(r.a), bytes(r.b), bytes(r.cover_a), bytes(r.cover_b))
            if at is not None:
                pair = [np.stack(x) for x in zip(unpack(h, w, held), unpack(h, w, now), strict=True)]
                before = np.frombuffer(mask, np.uint8).reshape(h, w).astype(bool) if mask else None
                masks, _ = seam(*pair, before=before, stable=stable)
                if not mask:
                    out.append((key[0], at, masks[0].astype(np.uint8).tobytes()))
                mask = masks[1].astype(np.uint8).tobytes()
                out.append((key[0], int(r.frame), mask))
            at, h, w, held = int(r.frame), int(r.height), int(r.width), now
        if at is not None:
            state.update((at, h, w, *held, mask or b"", seen))
            if ts:
                state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["clip", "frame", "mask"])

    kinds = "frame long, height int, width int, a binary, b binary, cover_a binary, cover_b binary, mask binary, seen long"
    rows, timeout = _timed(frames, ["clip", "frame", "height", "width", "a", "b", "cover_a", "cover_b"], ts, late)
    return rows.groupBy("clip").applyInPandasWithState(step, "clip long, frame long, mask binary", kinds, "append", timeout)


def propagate_matches(frames: DataFrame, most: int = 1000, near: float = 1.0, ts: str | None = None, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """``clip, frame, k, xa, ya, xb, yb``: correspondences carried from frame to frame.

    ``frames`` are ``clip, frame, fresh, moved``: the matches found in a frame (array of
    ``xa, ya, xb, yb``), and where the frame's tracker takes points of the frame
    before (array of ``xa, ya, ua, va, xb, yb, ub, vb, error``).  A carried match
    follows the tracker if its error is at most ``near`` and goes otherwise;
    fresh matches join it, those at a place already held do not, and a frame
    holds at most ``most``, carried ones first.  State: one frame's matches; with an event time ``ts`` it goes
    as that of :func:`carry_seams` does.

    In place of ``moved`` there may be the moves of each view by itself, ``la`` and ``lb`` (:func:`moves_of`):
    a match then follows the points of both views that it joins, with the larger of their errors.
    """
    alone = "moved" not in frames.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *sides, seen = state.get if state.exists else ([], [], [], [], 0)
        held = [tuple(m) for m in zip(*sides, strict=True)]
        out = []
        for r in sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r.frame):
            seen = max(seen, int(r.ms))
            if alone:
                la, lb = ({(m["x"], m["y"]): (m["u"], m["v"]) for m in (side if side is not None else ()) if m["error"] <= near} for side in (r.la, r.lb))
                to = {m: la[m[:2]] + lb[m[2:]] for m in held if m[:2] in la and m[2:] in lb}
            else:
                to = {(m["xa"], m["ya"], m["xb"], m["yb"]): (m["ua"], m["va"], m["ub"], m["vb"]) for m in r.moved if m["error"] <= near}
            now = [to[m] for m in held if m in to]
            taken = {(round(m[0]), round(m[1])) for m in now}
            for m in r.fresh if r.fresh is not None else ():
                m = (m["xa"], m["ya"], m["xb"], m["yb"])
                if (round(m[0]), round(m[1])) not in taken:
                    taken.add((round(m[0]), round(m[1])))
                    now.append(m)
            held = now[:most]
            out += [(key[0], int(r.frame), k, *m) for k, m in enumerate(held)]
        state.update((*([m[i] for m in held] for i in range(4)), seen))
        if ts:
            state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["clip", "frame", "k", "xa", "ya", "xb", "yb"])

    kinds = ", ".join(f"{c} array<double>" for c in ("xa", "ya", "xb", "yb")) + ", seen long"
    rows, timeout = _timed(frames, ["clip", "frame", "fresh", *(["la", "lb"] if alone else ["moved"])], ts, late)
    return rows.groupBy("clip").applyInPandasWithState(step, "clip long, frame long, k int, xa double, ya double, xb double, yb double", kinds, "append", timeout)


def track_points(frames: DataFrame, mesh: int = 8, demand: float = 256, most_error: float = 1.0, max_age: int = 100, ts: str | None = None, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """``clip, frame, track_id, age, x, y, px, py, error``: the live points of every frame of a stream of images.

    ``frames`` are ``clip, frame, height, width, pixels`` (binary, a byte a pixel).  Points are followed by
    pyramidal registration; a point lives on if its way there and back ends within ``most_error``
    pixels of its beginning, and retires at ``max_age`` frames.  Cells of a ``mesh`` x ``mesh`` grid that hold under
    0.7 of their share of ``demand`` are refilled with corners.  ``px, py`` is a point's place in the
    frame before (null for a new one), so a frame's rows are the moves that :func:`propagate_matches` asks for.

    A clip is one key; its state is one frame and its live points.  With an event time ``ts`` (rows later than
    ``late`` are dropped) the state goes once the watermark is ``idle_ms`` past the clip's last frame; without one it stays.  Frames of a micro-batch may come in any order; one that is not after the last is
    dropped, and one of another size begins anew.
    """
    import numpy as np

    from trackloom.operators.klt import new_points, tracked

    names = ["clip", "frame", "track_id", "age", "x", "y", "px", "py", "error"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, height, width, raw, ids, ages, xs, ys, following, seen = state.get if state.exists else (None, 0, 0, b"", [], [], [], [], 0, 0)
        ids, ages, at = np.array(ids, np.int64), np.array(ages, np.int64), np.column_stack([xs, ys]).astype(float).reshape(-1, 2)
        out = []
        for r in sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r.frame):
            seen = max(seen, int(r.ms))
            if last is not None and r.frame <= last:
                continue
            now = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width))
            if last is None or now.shape != (height, width):
                ids, ages, at, was, error = ids[:0], ages[:0], at[:0], at[:0], np.zeros(0)
            else:
                found, error = tracked(np.frombuffer(raw, np.uint8).reshape(height, width), now, at)
                lives = (error <= most_error) & (ages < max_age)
                was, at, ids, ages, error = at[lives], found[lives], ids[lives], ages[lives] + 1, error[lives]
            more = new_points(now, at, mesh, demand)
            none = np.full(len(more), np.nan)
            ids, ages = np.concatenate([ids, following + np.arange(len(more))]), np.concatenate([ages, np.ones(len(more), np.int64)])
            at, was, error = np.concatenate([at, more]), np.concatenate([was, np.column_stack([none, none])]), np.concatenate([error, none])
            following, last, raw, (height, width) = following + len(more), int(r.frame), bytes(r.pixels), now.shape
            out.append(pd.DataFrame({"clip": key[0], "frame": last, "track_id": ids, "age": ages, "x": at[:, 0], "y": at[:, 1], "px": was[:, 0], "py": was[:, 1], "error": error})[names])
        if last is not None:
            state.update((last, height, width, raw, ids.tolist(), ages.tolist(), at[:, 0].tolist(), at[:, 1].tolist(), int(following), seen))
            if ts:
                state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        for pdf in out:
            yield pdf.astype({"px": object, "py": object, "error": object}).where(pdf.notna(), None)

    held = "frame long, height int, width int, pixels binary, ids array<long>, ages array<long>, xs array<double>, ys array<double>, following long, seen long"
    made = "clip long, frame long, track_id long, age long, x double, y double, px double, py double, error double"
    rows, timeout = _timed(frames, ["clip", "frame", "height", "width", "pixels"], ts, late)
    return rows.groupBy("clip").applyInPandasWithState(step, made, held, "append", timeout)


def moves_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """``clip, frame, la, lb``: the moves of two views' tracked points (as :func:`track_points` gives them, read back as
    tables), each an array of ``x, y, u, v, error`` from the frame before to this one."""
    def side(df: DataFrame, name: str) -> DataFrame:
        move = F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.col("x").alias("u"), F.col("y").alias("v"), "error")
        return df.where("px IS NOT NULL").groupBy("clip", "frame").agg(F.array_sort(F.collect_list(move)).alias(name))

    return side(left, "la").join(side(right, "lb"), ["clip", "frame"], "full")
