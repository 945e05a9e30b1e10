"""Embedding near-dedup: product quantisation over coarse inverted lists.

Equal vectors are folded first.  A coarse quantiser, fitted on a bounded sample whose near
copies are thinned out, gives every vector a home list, where it lies as the subspace codes
of its residual and the length of what the codes lose.  A vector also visits the lists
whose border with its home is within ``margin``.  Two vectors at distance r that lie in
different cells have the border between them, so one of them is within r / 2 of it: with
that margin no pair can be missed; with the default of 2 r / sqrt(d), a pair is missed
only if its difference, beyond four standard deviations of a random direction, points across
the border.  In a list, distances come from tables of each query's residual to
the codewords; a pair stays if its table distance is at most r plus what the codes lose,
which drops no link, and its cosine is then taken from the vectors in double precision.

Families of near copies may hold a third of all rows.  Where the sample shows one, its
mean becomes a pivot: rows within r / 2 of a pivot are all linked to each other, so they
are counted, chained to one node, and never paired.  Other long lists are dealt over
tasks by pairs of blocks.  Tasks return a count for each vector and a spanning forest of
their links, never the pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trackloom.llm.common import materialize, table
from trackloom.llm.components import component_roots
from trackloom.operators.quantise import codebooks, encoded, lloyd, looked_up, nearest_rows, parts_of

#: Rows of a list for each of its sides in a task; longer lists are dealt out by blocks.
BLOCK = 4096
#: Rows aimed at in a list, the most lists, and the most rows and bytes of the sample that fits them.
LIST_ROWS, MOST_LISTS, MOST_SAMPLE, SAMPLE_BYTES = 512, 16_384, 131_072, 1 << 27
#: Subspaces and codewords of the residuals.
SUBSPACES, CODEWORDS = 16, 64
#: Members in the sample from which on a family gets a pivot.
FAMILY = 16
#: Pairs of a task that are looked at at once.
SLICE = 1 << 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; large and tiny components don't overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Quantiser:
    """Of vectors of one length: list centres, their mutual distances, codebooks of the parts, pivots of families."""

    centres: np.ndarray
    books: list[np.ndarray]
    pivots: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, radius: float) -> Quantiser:
        """From unit rows; rows within twice the radius of one taken already fit nothing but pivots."""
        free, kept, pivots = np.ones(len(x), bool), [], []
        for k in range(0, len(x), 128):
            products = x[k : k + 128] @ x.T
            for i in range(k, min(k + 128, len(x))):
                if free[i]:
                    near = products[i - k]
                    free &= near < 1 - 2 * radius**2
                    kept.append(i)
                    own = near >= 1 - radius**2 / 2
                    if np.count_nonzero(own) >= FAMILY:
                        pivots.append(x[own].mean(0))
        apart = x[kept]
        centres = lloyd(apart, apart[:lists].copy(), 6) if len(apart) else np.zeros((1, x.shape[1]))
        some = apart[: 64 * CODEWORDS]
        books = codebooks(some - centres[nearest_rows(some, centres)], parts_of(x.shape[1], SUBSPACES), CODEWORDS)
        return cls(centres, books, np.array(pivots).reshape(-1, x.shape[1]))

    @classmethod
    def trivial(cls, dims: int) -> Quantiser:
        """One list and one codeword: of a length that the sample has not."""
        return cls.fit(np.zeros((0, dims)), 1, 0.0)

    def lists_of(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The home of each row, and the other lists that it visits."""
        sizes, homes, visits = (self.centres**2).sum(1), [np.zeros(0, int)], []
        step = max(1, (1 << 21) // len(self.centres))
        for k in range(0, len(x), step):
            d = sizes - 2 * x[k : k + step] @ self.centres.T
            home, row = d.argmin(1), np.arange(len(d))
            between = np.sqrt(np.maximum(sizes[home][:, None] + sizes - 2 * self.centres[home] @ self.centres.T, 0))
            near = d - d[row, home][:, None] <= 2 * margin * between + 1e-9
            near[row, home] = False
            homes.append(home)
            visits += [np.nonzero(v)[0].astype(np.int32) for v in near]
        return np.concatenate(homes), visits

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, parts)`` codes of the residuals, and the length of what they lose."""
        return encoded(x - self.centres[home], parts_of(x.shape[1], SUBSPACES), self.books)

    def family(self, x: np.ndarray, radius: float) -> np.ndarray:
        """The pivot within half the radius, or -1."""
        if not len(self.pivots):
            return np.full(len(x), -1)
        at = nearest_rows(x, self.pivots)
        return np.where(np.sqrt(((x - self.pivots[at]) ** 2).sum(1)) <= radius / 2 * (1 - 1e-6), at, -1)

    def table_distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances from the queries to the decoded rows of list ``at``, by table look-up."""
        return np.sqrt(looked_up(q - self.centres[at], codes, parts_of(q.shape[1], SUBSPACES), self.books))


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join two trees of ``root``, which is brought up to date."""
    us, vs = [], []
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return np.concatenate(us or [i[:0]]), np.concatenate(vs or [j[:0]])
        i, j, lo, hi = i[open_], j[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        top, first = np.unique(hi, return_index=True)
        us.append(i[first])
        vs.append(j[first])
        root[top] = lo[first]
        while (root != root[root]).any():
            root[:] = root[root]


def _rows(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, vectors)`` of a batch, by length, at most 1024 at once."""
    lists = batch.column(batch.schema.get_field_index("v"))
    flat, cuts = lists.values.to_numpy(zero_copy_only=False).astype(kind), np.asarray(lists.offsets)
    sizes = np.diff(cuts)
    for dims in np.unique(sizes):
        every = np.nonzero(sizes == dims)[0]
        for k in range(0, len(every), 1024):
            places = every[k : k + 1024]
            yield int(dims), places, flat[cuts[places][:, None] + np.arange(dims)]


def _placed(models, radius: float, margin: float | None, kind: type):
    """``node, n, dims, home, visits, family`` for each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, places, raw in _rows(batch, kind):
                model, x = models.value.get(dims) or Quantiser.trivial(dims), unit(raw)
                home, visits = model.lists_of(x, _margin(margin, radius, dims))
                yield pa.record_batch({
                    "node": batch.column(0).take(pa.array(places)), "n": batch.column(1).take(pa.array(places)), "dims": pa.array(np.full(len(x), dims, np.int32)), "home": pa.array(home.astype(np.int32)),
                    "visits": pa.array(visits, pa.list_(pa.int32())), "family": pa.array(model.family(x, radius).astype(np.int32)),
                })

    return run


def _margin(margin: float | None, radius: float, dims: int) -> float:
    return min(radius / 2, 2 * radius / math.sqrt(dims)) if margin is None else margin


def pieces_of(counts: dict[tuple[int, bool, int], int], block: int) -> dict[tuple[int, bool, int], tuple[int, int]]:
    """``(list, home, family) -> (first piece, pieces)`` within one length, for lists that do not fit a task.

    Families of at least a block have pieces of their own; the others share those of family -1.
    """
    whole: dict[tuple[int, bool], int] = {}
    for (at, home, _), n in counts.items():
        whole[at, home] = whole.get((at, home), 0) + n
    long = {at for (at, _), n in whole.items() if n > block}
    shares: dict[tuple[int, bool, int], int] = {}
    for (at, home, family), n in counts.items():
        if at in long:
            key = (at, home, family if n >= block else -1)
            shares[key] = shares.get(key, 0) + n
    out, first = {}, dict.fromkeys(long, 0)
    for key in sorted(shares, key=lambda k: (k[0], not k[1], k[2])):
        n = -(-shares[key] // block)
        out[key] = (first[key[0]], n)
        first[key[0]] += n
    return out


def _units(pieces: dict[tuple[int, bool, int], tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """``(list, piece) -> [(unit, role)]``; roles: 0 is looked up, 1 asks, 2 both.  A unit of two pieces of one family is left out."""
    at_list: dict[int, list[tuple[int, bool, int]]] = {}
    for (at, home, family), (first, n) in pieces.items():
        at_list.setdefault(at, []).extend((first + k, home, family) for k in range(n))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for at, parts in at_list.items():
        unit_ = 0
        for a, home, family in parts:
            for b, other_home, other in parts if home else ():
                if (other_home and b < a) or family == other >= 0:
                    continue
                out.setdefault((at, a), []).append((unit_, 2 if a == b else 0))
                if a != b:
                    out.setdefault((at, b), []).append((unit_, 1))
                unit_ += 1
    return out


def _routed(models, radius: float, margin: float | None, kind: type, pieces, units):
    """Every vector in its home and where it visits; rows of long lists go to every unit of their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, meets = pieces.value, units.value
        for batch in batches:
            nodes, ns = (batch.column(k).to_numpy() for k in (0, 1))
            for dims, places, raw in _rows(batch, kind):
                model, x = models.value.get(dims) or Quantiser.trivial(dims), unit(raw)
                home, visits = model.lists_of(x, _margin(margin, radius, dims))
                codes, lost = model.codes(x, home)
                family = model.family(x, radius)
                rows: list[tuple[int, int, int, int]] = []
                for i in range(len(x)):
                    for at in (home[i], *visits[i]):
                        own, at = at == home[i], int(at)
                        here = cut.get(dims, {})
                        piece = here.get((at, own, int(family[i]))) or here.get((at, own, -1))
                        if piece is None:
                            rows.append((i, at, 0, 2 if own else 1))
                        else:
                            first, n = piece
                            rows += [(i, at, u, role) for u, role in meets[dims].get((at, first + zlib.crc32(int(nodes[places[i]]).to_bytes(8)) % n), ())]
                i, at, unit_, role = (np.array(c, np.int32) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int32)] * 4
                looked = role != 1
                for k in range(0, len(i), 1 << 14):
                    s = slice(k, k + (1 << 14))
                    yield pa.record_batch({
                        "dims": pa.array(np.full(len(i[s]), dims, np.int32)), "at": pa.array(at[s]), "unit": pa.array(unit_[s]), "role": pa.array(role[s]),
                        "node": pa.array(nodes[places[i[s]]]), "n": pa.array(ns[places[i[s]]]), "home": pa.array(home[i[s]].astype(np.int32)), "family": pa.array(family[i[s]].astype(np.int32)),
                        "v": pa.array([raw[j].tobytes() for j in i[s]], pa.binary()), "codes": pa.array([codes[j].tobytes() if y else None for j, y in zip(i[s], looked[s], strict=True)], pa.binary()),
                        "lost": pa.array(lost[i[s]]), "visits": pa.array([visits[j] if y else None for j, y in zip(i[s], looked[s], strict=True)], pa.list_(pa.int32())),
                    })

    return run


_ROUTED = "dims int, at int, unit int, role int, node long, n long, home int, family int, v binary, codes binary, lost double, visits array<int>"


def _met(models, radius: float, cosine: float, kind: type):
    """A unit's links: ``u, v`` of a spanning forest, and ``u, links`` for each vector with any."""

    def run(rows: pa.Table) -> pa.Table:
        dims, at = rows.column("dims")[0].as_py(), rows.column("at")[0].as_py()
        model = models.value.get(dims) or Quantiser.trivial(dims)
        col = {c: rows.column(c).to_numpy() for c in ("role", "node", "n", "home", "family", "lost")}
        x = unit(np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(-1, dims))
        looked, asking = np.nonzero(col["role"] != 1)[0], np.nonzero(col["role"] != 0)[0]
        out_u, out_v, links = [], [], np.zeros(len(x), np.int64)
        if len(looked):
            codes = np.frombuffer(b"".join(c for c in rows.column("codes").to_pylist() if c is not None), np.uint8).reshape(len(looked), -1)
            seen = [v for v in rows.column("visits").to_pylist() if v is not None]
            visits = np.full((len(looked), max(map(len, seen), default=0) + 1), -1)
            for k, v in enumerate(seen):
                visits[k, : len(v)] = v
            root, step = np.arange(len(x)), max(1, SLICE * 16 // max(len(looked), SUBSPACES * CODEWORDS))
            for k in range(0, len(asking), step):
                q = asking[k : k + step]
                qi, ti = np.nonzero(model.table_distances(x[q], at, codes) <= radius + col["lost"][looked] + 1e-9)
                qi, place = q[qi], ti
                ti = looked[place]
                once = (col["role"][qi] == 1) | (col["role"][ti] == 0) | (qi < ti)  # both in the home list: met from either side
                new = once & ~((col["family"][qi] == col["family"][ti]) & (col["family"][qi] >= 0))
                qi, ti, place = qi[new], ti[new], place[new]
                for s in range(0, len(qi), SLICE):
                    i, j, p = qi[s : s + SLICE], ti[s : s + SLICE], place[s : s + SLICE]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    i, j, p = i[near], j[near], p[near]
                    # met in the other's home as well: counted in the lower of the two lists
                    twice = (col["home"][i] < at) & (visits[p] == col["home"][i][:, None]).any(1)
                    i, j = i[~twice], j[~twice]
                    np.add.at(links, i, col["n"][j])
                    np.add.at(links, j, col["n"][i])
                    a, b = forest(root, i, j)
                    out_u.append(a)
                    out_v.append(b)
        u, v = (np.concatenate(c or [np.zeros(0, int)]).astype(int) for c in (out_u, out_v))
        some = np.nonzero(links)[0]
        return pa.table({
            "u": pa.array(np.concatenate([col["node"][u], col["node"][some]]).astype(np.int64)), "v": pa.concat_arrays([pa.array(col["node"][v].astype(np.int64)), pa.nulls(len(some), pa.int64())]),
            "links": pa.array(np.concatenate([np.zeros(len(u), np.int64), links[some]])),
        })

    return run


def near_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, margin: float | None = None, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: the number of other rows whose cosine with
    it is at least ``cosine`` (above 0.5), the least id reachable over such links, and whether that is its own.

    ``margin`` is how far beyond a border between lists a vector still visits; half the distance
    that ``cosine`` stands for misses nothing.  The quantiser is fitted on at most ``MOST_SAMPLE``
    vectors (131,072, and 128 MB) by hash; every row is indexed.

    Defined cases: vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing (``n_links`` 0, their own id, kept); vectors of different lengths do not
    link; repeated rows and repeated ids are rows of their own, and link; a null id is never the least
    unless all of a component are null; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    if not 0.5 < cosine <= 1:
        raise ValueError(f"cosine: {cosine}")
    spark, radius = rows.sparkSession, math.sqrt(2 - 2 * cosine) + 1e-9
    kind = np.float64 if isinstance(rows.schema[vector_col].dataType.elementType, DoubleType) else np.float32
    given = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>" if kind is np.float64 else "array<float>").alias("v"))
    fit = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    distinct = given.where(fit).groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("node"), "n", "least", "v"), "vectors")
    whole = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not whole["n"]:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    lists = max(1, min(MOST_LISTS, whole["n"] // LIST_ROWS, SAMPLE_BYTES // (64 * whole["d"])))
    most = max(1, min(MOST_SAMPLE, max(4096, 8 * lists), SAMPLE_BYTES // (8 * whole["d"])))
    sample = distinct.where(F.pmod(F.xxhash64("v"), F.lit(whole["n"])) < most).select("v").orderBy(F.xxhash64("v")).toArrow().column("v").to_pylist()
    models = {}
    for dims in {len(v) for v in sample}:
        own = unit(np.array([v for v in sample if len(v) == dims]))
        models[dims] = Quantiser.fit(own, max(1, lists * len(own) // len(sample)), radius)
    models = spark.sparkContext.broadcast(models)

    short = distinct.select("node", "n", "v")
    places = materialize(short.mapInArrow(_placed(models, radius, margin, kind), "node long, n long, dims int, home int, visits array<int>, family int"), "places")
    seen = F.array_append(F.transform("visits", lambda c: F.struct(c.alias("at"), F.lit(False).alias("own"))), F.struct(F.col("home").alias("at"), F.lit(True).alias("own")))
    counts = places.select("dims", "family", F.explode(seen).alias("s")).groupBy("dims", "s.at", "s.own", "family").count()
    # what a list that fits a task holds is not needed
    long = counts.groupBy("dims", "at").agg(F.sum("count").alias("all")).where(F.col("all") > block)
    by_length: dict[int, dict] = {}
    for r in counts.join(F.broadcast(long), ["dims", "at"], "left_semi").collect():
        by_length.setdefault(r["dims"], {})[r["at"], r["own"], r["family"]] = r["count"]
    pieces = {dims: pieces_of(c, block) for dims, c in by_length.items()}
    units = spark.sparkContext.broadcast({dims: _units(p) for dims, p in pieces.items()})
    routed = short.mapInArrow(_routed(models, radius, margin, kind, spark.sparkContext.broadcast(pieces), units), _ROUTED)
    met = materialize(routed.groupBy("dims", "at", "unit").applyInArrow(_met(models, radius, cosine, kind), "u long, v long, links long"), "links")

    families = F.broadcast(places.where("family >= 0").groupBy("dims", "family").agg(F.min("node").alias("head"), F.sum("n").alias("every")))
    members = places.where("family >= 0").join(families, ["dims", "family"])
    counted = met.where("v IS NULL").select(F.col("u").alias("node"), "links").unionAll(members.select("node", (F.col("every") - F.col("n")).alias("links")))
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    roots = component_roots(met.where("v IS NOT NULL").select("u", "v").unionAll(members.select(F.col("head").alias("u"), F.col("node").alias("v"))), "vector_links")
    linked = materialize(distinct.select("node", "least").join(roots, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ends = linked.select("node", "root").join(least, "root").select("node", "component_id")
    told = distinct.join(ends, "node", "left").join(counted, "node", "left")
    told = told.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linking = given.where(fit).join(told, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = given.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linking.unionAll(alone)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(u, w) AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.w, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.w, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.u LEFT JOIN n ON vec_id = n.u
"""
