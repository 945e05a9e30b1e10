"""Segmentation by lossy coding length, and grouped trajectory matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coding_length(w: np.ndarray, eps2: float, total: int, affine: bool = False) -> float:
    """Bits to code the columns of ``w`` up to squared distortion ``eps2``, as one of the
    groups of ``total`` samples."""
    n, m = w.shape
    if not m:
        return 0.0
    extra = 0.0
    if affine:
        mean = w.mean(1, keepdims=True)
        w = w - mean
        extra = n / 2 * math.log2(1 + float((mean**2).sum()) / eps2)
    gram = w @ w.T if n <= m else w.T @ w
    s2 = np.clip(np.linalg.eigvalsh(gram), 0, None)
    return extra + (m + n) / 2 * float(np.log2(1 + n / (eps2 * m) * s2).sum()) - m * math.log2(m / total)


def total_coding_length(w: np.ndarray, labels: np.ndarray, eps: float, affine: bool = False) -> float:
    return sum(coding_length(w[:, labels == k], eps * eps, w.shape[1], affine) for k in np.unique(labels))


def segment(w: np.ndarray, eps: float, affine: bool = False) -> np.ndarray:
    """Labels (from 1) of the columns: groups merge greedily, always the pair whose union saves
    most, until no merge shortens the code."""
    n, m = w.shape
    eps2 = eps * eps
    groups = [[i] for i in range(m)]
    cost = lambda g: coding_length(w[:, g], eps2, m, affine)
    lengths = [cost(g) for g in groups]
    gain = np.full((m, m), np.inf)
    for i in range(m):
        for j in range(i + 1, m):
            gain[i, j] = cost(groups[i] + groups[j]) - lengths[i] - lengths[j]
    alive = list(range(m))
    while len(alive) > 1:
        i, j = np.unravel_index(gain.argmin(), gain.shape)
        if not gain[i, j] <= 0:
            break
        groups[i] += groups[j]
        lengths[i] = cost(groups[i])
        alive.remove(j)
        gain[j, :] = gain[:, j] = np.inf
        for k in alive:
            if k != i:
                a, b = min(i, k), max(i, k)
                gain[a, b] = cost(groups[a] + groups[b]) - lengths[a] - lengths[b]
    labels = np.zeros(m, int)
    for k, i in enumerate(alive, 1):
        labels[groups[i]] = k
    return labels


def try_sequence(w: np.ndarray, epsilons: list[float], affine: bool = False) -> list[tuple[float, np.ndarray, float, float]]:
    """``(eps, labels, length, penalised length)`` for each distortion; a segmentation that
    codes worse than one group collapses to one."""
    n, m = w.shape
    out = []
    for eps in epsilons:
        labels = segment(w, eps, affine)
        length, whole = total_coding_length(w, labels, eps, affine), coding_length(w, eps * eps, m, affine)
        if whole < length:
            labels, length = np.ones(m, int), whole
        out.append((eps, labels, length, length + n * m * math.log2(eps)))
    return out


def best_segmentation(w: np.ndarray, trials: list[tuple], groups: int | None = None, affine: bool = False) -> np.ndarray:
    """Of the trials with the wanted number of groups, that which most distortions code
    shortest (ties to the first); without one, that of least penalised length."""
    found = [t for t in trials if groups is not None and len(np.unique(t[1])) == groups]
    if not found:
        return min(trials, key=lambda t: t[3])[1]
    votes = [int(np.argmin([total_coding_length(w, t[1], eps, affine) for t in found])) for eps, *_ in trials]
    return found[int(np.bincount(votes, minlength=len(found)).argmax())][1]


def best_agreement(table: np.ndarray) -> float:
    """The most that one-to-one renaming makes agree in a confusion table (exhaustive up to six
    groups, greedy beyond)."""
    from itertools import permutations

    k = max(table.shape)
    square = np.zeros((k, k))
    square[: table.shape[0], : table.shape[1]] = table
    if k <= 6:
        return max(square[range(k), list(p)].sum() for p in permutations(range(k)))
    best = 0.0
    for _ in range(k):
        i, j = np.unravel_index(square.argmax(), square.shape)
        best += max(square[i, j], 0)
        square[i, :] = square[:, j] = -1
    return best


def misclassified(a: np.ndarray, b: np.ndarray) -> float:
    """Share of samples that differ under the best renaming of labels (:func:`best_agreement`)."""
    ka, kb = np.unique(a), np.unique(b)
    return float(1 - best_agreement(np.array([[np.sum((a == i) & (b == j)) for j in kb] for i in ka])) / len(a))


def compare_labels(df: DataFrame, a: str, b: str, most: int = 1000) -> DataFrame:
    """``n, error`` in one row: :func:`misclassified` of two label columns.  Only the confusion table is
    collected; more than ``most`` labels on a side are refused."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows = pairs.limit(most * most + 1).collect()
    ka, kb = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    if max(len(ka), len(kb)) > most:
        raise ValueError(f"more than {most} labels")
    table = np.zeros((len(ka), len(kb)))
    for r in rows:
        table[ka.index(r["a"]), kb.index(r["b"])] = r["n"]
    n = int(table.sum())
    return df.sparkSession.createDataFrame([(n, float(1 - best_agreement(table) / n) if n else 0.0)], "n long, error double")


def project(w: np.ndarray, dims: int | None = None) -> np.ndarray:
    """Columns in the basis of the leading left singular vectors.  By default the smallest
    dimension d with d >= 8 log2(2 n / d)."""
    n = w.shape[0]
    if dims is None:
        dims = next((d for d in range(1, n + 1) if d >= 8 * math.log2(2 * n / d)), n)
    return np.linalg.svd(w, full_matrices=False)[0][:, : min(dims, n)].T @ w


def basis_pursuit(a: np.ndarray, y: np.ndarray, gap: float = 1e-7, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The columns of least L1 norm with ``a @ c = y``, and the duality gap of each relative to its norm.
    Columns that no combination gives have their least-squares combination and an infinite gap."""
    places, coefficients, gaps = least_vertices(a, y, gap, rounds)
    best = np.zeros((a.shape[1], y.shape[1]))
    best[places.T, np.arange(y.shape[1])] += coefficients.T
    lost = np.isinf(gaps)
    if lost.any():
        best[:, lost] = np.linalg.pinv(a) @ y[:, lost]
    return best, gaps


def least_vertices(a: np.ndarray, y: np.ndarray, gap: float = 1e-7, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column of ``y`` the columns of ``a`` that :func:`basis_pursuit` combines, their coefficients, and the gap.

    Simplex steps from vertex to vertex for all columns of ``y`` together.  A vertex is as many columns of ``a`` as it has
    independent rows, each with a sign; columns of ``y`` at one vertex share its dual, so ``a`` is priced once for each vertex and not for each
    column.  A dual point made feasible bounds how far a column is from the least norm, and a column whose gap is closed takes no
    further part.  Columns that no combination gives have coefficients of 0 and an infinite gap.
    """
    n, k = a.shape[1], y.shape[1]
    u, sizes, v = np.linalg.svd(a, full_matrices=False)
    rank = int((sizes > max(a.shape) * np.finfo(float).eps * sizes.max(initial=0)).sum())
    u, v = u[:, :rank], v[:rank]
    left = u.T @ y
    hopeless = np.abs(u @ left - y).max(0, initial=0) > 1e-8 * np.maximum(np.abs(y).max(0, initial=0), 1e-300)
    places, coefficients, gaps = np.zeros((k, rank), int), np.zeros((k, rank)), np.where(hopeless, np.inf, 0.0)
    open_ = np.flatnonzero(~hopeless & (np.abs(y).max(0, initial=0) > 0))
    if not len(open_):
        return places, coefficients, gaps
    # rows of unit scale, and columns as rows; the norm keeps the scale of the columns
    rows, right = v.T, (left[:, open_] / sizes[:rank, None]).T
    vertices = np.tile(_independent(rows), (len(open_), 1))
    signs = np.sign(np.linalg.solve(rows[vertices[0]].T, right.T).T)
    signs[signs == 0] = 1
    for step in range(rounds):
        # the vertices in use, each once, whatever the order of its columns
        order = np.argsort(vertices, 1)
        vertices, signs = np.take_along_axis(vertices, order, 1), np.take_along_axis(signs, order, 1)
        used, which = np.unique(np.hstack([vertices, signs.astype(int)]), axis=0, return_inverse=True)
        which = which.ravel()
        base = rows[used[:, :rank]]  # a vertex's columns of a, as rows
        dual = np.linalg.solve(base, used[:, rank:, None].astype(float))[..., 0]
        entering, value = np.empty(len(used), int), np.empty(len(used))
        for i in range(0, len(used), most := max(1, (1 << 22) // n)):
            price = rows @ dual[i : i + most].T
            price[used[i : i + most, :rank].T, np.arange(price.shape[1])] = 0
            beyond = np.abs(price)
            # against cycles, late steps take the first column that may enter
            entering[i : i + most] = beyond.argmax(0) if step % 200 < 150 else (beyond > 1 + gap).argmax(0)
            value[i : i + most] = beyond.max(0, initial=0)
            signed = np.sign(price[entering[i : i + most], np.arange(price.shape[1])])
            dual[i : i + most] /= np.maximum(value[i : i + most], 1)[:, None]
            entering[i : i + most] = np.where(signed < 0, ~entering[i : i + most], entering[i : i + most])
        c = np.linalg.solve(np.swapaxes(base, 1, 2)[which], right[..., None])[..., 0]
        norm = np.abs(c).sum(1)
        bound = (right * dual[which]).sum(1)
        gaps[open_] = (norm - bound) / np.maximum(norm, 1e-300)
        done = (gaps[open_] <= gap) | (step == rounds - 1)
        if done.any():
            places[open_[done]], coefficients[open_[done]] = vertices[done], c[done]
            open_, right, vertices, signs, which, c = (x[~done] for x in (open_, right, vertices, signs, which, c))
        if not len(open_):
            break
        # the column that enters, against its sign, and the first that it drives to nothing
        enters = entering[which]
        way = np.where(enters < 0, -1.0, 1.0)
        enters = np.where(enters < 0, ~enters, enters)
        change = signs * np.linalg.solve(np.swapaxes(base, 1, 2)[which], (way[:, None] * rows[enters])[..., None])[..., 0]
        room = np.maximum(signs * c, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-11, room / change, np.inf)
        least = ratio.min(1, keepdims=True)
        # of equal ones that of the largest change
        leaves = np.where(ratio <= least * (1 + 1e-12), change, -np.inf).argmax(1)
        at = np.arange(len(open_))
        vertices[at, leaves], signs[at, leaves] = enters, way
    return places, coefficients, gaps


def _independent(rows: np.ndarray) -> np.ndarray:
    """As many rows as the matrix has columns, by elimination with the largest pivot."""
    left, taken = rows.copy(), []
    for _ in range(rows.shape[1]):
        lengths = (left * left).sum(1)
        lengths[taken] = -1
        taken.append(int(lengths.argmax()))
        q = left[taken[-1]] / math.sqrt(lengths[taken[-1]])
        left -= np.outer(left @ q, q)
    return np.array(taken)


def repair(w: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Fill unknown entries (``known`` false) of each column by the combination of complete
    columns of least L1 norm that matches its known entries (:func:`basis_pursuit`, columns of the same
    entries together).  Without complete columns nothing changes."""
    whole = known.all(0)
    base, out = w[:, whole], w.copy()
    patterns: dict[bytes, list[int]] = {}
    for j in np.flatnonzero(~whole):
        patterns.setdefault(known[:, j].tobytes(), []).append(j)
    for columns in patterns.values():
        k = known[:, columns[0]]
        if base.size and k.any():
            y, columns = w[np.ix_(k, columns)], np.array(columns)
            places, coefficients, gaps = least_vertices(base[k], y)
            out[np.ix_(~k, columns)] = (base[~k][:, places] * coefficients).sum(-1)
            lost = np.isinf(gaps)
            if lost.any():
                out[np.ix_(~k, columns[lost])] = base[~k] @ np.linalg.pinv(base[k]) @ y[:, lost]
    return out


def repair_corrupted(w: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Every column replaced by the combination of the other columns that leaves the least L1 norm of
    coefficients plus ``weight`` times that of what it does not explain, so gross errors in a few
    entries go (:func:`basis_pursuit`)."""
    n, m = w.shape
    out = w.copy()
    for j in range(m):
        base = np.delete(w, j, 1)
        if base.size:
            # coefficients and errors together: y = base c + e / weight
            z, _ = basis_pursuit(np.hstack([base, np.eye(n) / weight]), w[:, j : j + 1])
            out[:, j] = base @ z[: m - 1, 0]
    return out


def repaired_tracks(points: DataFrame, keys: list[str], column: str = "track_id", row: str = "frame", value: str = "v") -> DataFrame:
    """``keys, column, row, value, filled``: the gaps (null or absent) of every window's columns filled from its complete ones.

    ``points`` are the entries of one matrix for each combination of ``keys`` (a clip and a window: its
    length bounds the rows, what is alive in it the columns), which is one group.  Windows without a complete
    column, and columns without any entry, keep their gaps as nulls.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[column, row]).drop_duplicates([column, row])
        grid = pdf.pivot(index=row, columns=column, values=value).astype(float)
        w, known = grid.to_numpy(), grid.notna().to_numpy()
        possible = known.any(0) & known.all(0).any()
        out = repair(np.where(known, w, 0.0), known) if w.size else w
        out = np.where(known | possible[None, :], out, np.nan)
        made = pd.DataFrame({column: np.repeat(grid.columns.to_numpy(), len(grid)), row: np.tile(grid.index.to_numpy(), grid.shape[1]), value: out.T.ravel(), "filled": (~known & ~np.isnan(out)).T.ravel()})
        made[value] = made[value].astype(object).where(made[value].notna(), None)
        for k, v in reversed(list(zip(keys, key, strict=True))):
            made.insert(0, k, v)
        return made

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{column} {kinds[column]}", f"{row} {kinds[row]}", f"{value} double", "filled boolean"])
    return points.select(*keys, column, row, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(fill, schema)


def process(w: np.ndarray, mode: str = "none", known: np.ndarray | None = None, dims: int | None = None, projected: bool = True) -> np.ndarray:
    """A trajectory matrix made ready for segmentation: repaired as ``mode`` says (``none``, ``incomplete``
    with a mask of ``known`` entries, ``corrupted``), then projected (:func:`project`)."""
    if mode == "incomplete":
        w = repair(w, known)
    elif mode == "corrupted":
        w = repair_corrupted(w)
    elif mode != "none":
        raise ValueError(f"mode: {mode}")
    return project(w, dims) if projected else w


def matrix_rank(w: np.ndarray, share: float = 0.05) -> int:
    """Singular values above ``share`` of the largest."""
    s = np.linalg.svd(w, compute_uv=False)
    return int((s > share * s[0]).sum()) if len(s) and s[0] > 0 else 0


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, list]:
    """Tracks as columns, x and y of each frame interleaved; frames that every track has."""
    x, y = (pdf.pivot_table(index="frame", columns="track_id", values=c).dropna() for c in ("x", "y"))
    out = np.empty((2 * len(x), x.shape[1]))
    out[0::2], out[1::2] = x.to_numpy(), y.to_numpy()
    return out, list(x.columns)


def segment_windows(points: DataFrame, eps: float) -> DataFrame:
    """``window, track_id, label`` for points ``window, track_id, frame, x, y``: each window's
    tracks, projected and segmented.  A window is one group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w, ids = _matrix(pdf)
        labels = segment(project(w) if len(w) else np.ones((1, len(ids))), eps)
        return pd.DataFrame({"window": key[0], "track_id": ids, "label": labels})

    return points.groupBy("window").applyInPandas(run, "window int, track_id long, label int")


def _means(track: np.ndarray, frame: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Of each of ``values`` the means, rows by frame and columns by track, of the frames that every track has."""
    columns, c = np.unique(track, return_inverse=True)
    frames, r = np.unique(frame, return_inverse=True)
    shape = (len(frames), len(columns))
    place = r * shape[1] + c
    counts = np.bincount(place, minlength=shape[0] * shape[1]).reshape(shape)
    whole = counts.all(1)
    return [np.bincount(place, v, shape[0] * shape[1]).reshape(shape)[whole] / counts[whole] for v in values]


def edge_ranks(points: DataFrame, alpha: float) -> DataFrame:
    """``window, u, v, n, w``: exp(-alpha n) * rank / 4 of the trajectory matrix of the tracks with
    label u in a window and v in the next (``window, u, v, track_id, frame, x, y``).  Many groups go through a worker in one batch."""
    number = lambda a: pa.compute.fill_null(a.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            p = batch.column("p")
            ends, flat = p.offsets.to_numpy(), p.values
            track, frame, xs, ys = flat.field("track_id").to_numpy(zero_copy_only=False), flat.field("frame").to_numpy(zero_copy_only=False), number(flat.field("x")), number(flat.field("y"))
            sizes, weights = [], []
            for at, end in zip(ends[:-1], ends[1:], strict=True):
                part = slice(at, end)
                t, f, *both = track[part], frame[part], xs[part], ys[part]
                held = [~np.isnan(v) for v in both]
                x, y = _means(t, f, *both) if all(h.all() for h in held) else (m for v, h in zip(both, held, strict=True) for m in _means(t[h], f[h], v[h]))
                w = np.empty((2 * len(x), x.shape[1]))
                w[0::2], w[1::2] = x, y
                sizes.append(w.shape[1])
                weights.append(math.exp(-alpha * w.shape[1]) * matrix_rank(w) / 4)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("window", "u", "v")] + [pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], names=["window", "u", "v", "n", "w"])

    grouped = points.groupBy(*(F.col(c).cast("int").alias(c) for c in ("window", "u", "v"))).agg(F.collect_list(F.when(F.col("track_id").isNotNull() & F.col("frame").isNotNull(), F.struct("track_id", "frame", "x", "y"))).alias("p"))
    return grouped.mapInArrow(run, "window int, u int, v int, n long, w double")


#: Sums of a group (its count, its vector's and their products') up to which they are columns.
MOST_SUMS = 100


def grouped_lengths(data: DataFrame, label: str, vector: str, eps: float, affine: bool = False) -> DataFrame:
    """``label, m, bits`` for every group of vectors; only Gram sums of each group are formed,
    by aggregation, and each group's are solved beside many others'."""
    dims = len(data.select(vector).first()[0])
    total = data.count()
    kind = data.schema[label].dataType.simpleString()
    given = data.select(F.col(label).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def grams(batches):
        """Of every batch and label: the count, then the sums, then the Gram matrix, as numbered terms."""
        for pdf in batches:
            for key, part in pdf.groupby("k", dropna=False):
                x = np.stack(part["v"].to_numpy()).astype(float)
                terms = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                yield pd.DataFrame({"k": [key] * len(terms), "i": np.arange(len(terms)), "s": terms})

    if 1 + dims + dims * (dims + 1) // 2 <= MOST_SUMS:
        v = [F.col("v")[i] for i in range(dims)]
        products = {(i, j): F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i in range(dims) for j in range(i, dims)}
        sums = given.groupBy("k").agg(F.count("*").cast("double").alias("m"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(v)), *products.values())
        rows = sums.select("k", F.array("m", *(f"s{i}" for i in range(dims)), *(f"p{min(i, j)}_{max(i, j)}" for i in range(dims) for j in range(dims))).alias("t"))
    else:
        parts = given.mapInPandas(grams, f"k {kind}, i int, s double")
        rows = parts.groupBy("k", "i").agg(F.sum("s").alias("s")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("t"))

    def run(batches):
        for batch in batches:
            t = np.array(batch.column("t").to_pylist(), float).reshape(-1, 1 + dims + dims * dims)
            m, g, extra = t[:, 0], t[:, dims + 1 :].reshape(-1, dims, dims), 0.0
            if affine:
                mean = t[:, 1 : dims + 1] / m[:, None]
                g = g - m[:, None, None] * mean[:, :, None] * mean[:, None, :]
                extra = dims / 2 * np.log2(1 + (mean * mean).sum(1) / eps**2)
            s2 = np.clip(np.linalg.eigvalsh(g), 0, None)
            bits = extra + (m + dims) / 2 * np.log2(1 + dims / (eps**2 * m)[:, None] * s2).sum(1) - m * np.log2(m / total)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(m.astype(int), pa.int64()), pa.array(bits)], names=[label, "m", "bits"])

    return rows.mapInArrow(run, f"{label} {kind}, m long, bits double")
