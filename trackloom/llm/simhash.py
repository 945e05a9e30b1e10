"""SimHash near-dedup: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in r bits share at least 8 - r of their 8
positional bytes; at r = 3 that is 5.  A list of one byte at one position
would hold 1/256 of all fingerprints, so the index's entries are the smallest
sets of positional bytes that the guarantee still covers: with the positions
in two halves of four, five shared bytes put three in one half, so the eight
triples within a half miss no pair.  For the pairs of a posting list the
shared positional bytes are tallied, those below the guaranteed minimum go,
and the rest are verified bit by bit.

Equal fingerprints are folded first and take no part as pairs.  A posting
list emits a spanning forest of its links, never all its pairs, and is cut
finer by further bytes (again with no pair lost) where it is long: within its
task, and over tasks where it is longer still.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import if_small, materialize, table
from trackloom.llm.components import component_roots

SEED = 42
#: Byte positions of the index entries: all triples of either half.
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: Lists up to this length are compared directly, longer ones are cut finer first.
DIRECT = 512
#: Longer lists than this are dealt over tasks by the next bytes.
SPLIT = 1 << 16
#: Of the five bytes that linked pairs share, two lie beyond a triple: all pairs of further positions.
FURTHER = [[pair for pair in combinations([p for p in range(8) if p not in t], 2)] for t in TRIPLES]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text (A-Z lowered), repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n <= size:
        shingles = [b" ".join(words)]
    elif size == 3:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:], strict=False))
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t or b"", size)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array(found.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (signed 64 bits) for every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprints(size), "id long, fp long")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes two arrays of fingerprints share."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then verification."""
    keep = np.flatnonzero(shared_bytes(a, b) >= 8 - distance)
    return keep[np.bitwise_count(a[keep] ^ b[keep]) <= distance]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one list: indices (parent, child).

    Works outward from a seed; every step compares one fingerprint with those
    not reached yet.
    """
    out = []
    left = np.arange(len(fps))
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        i = frontier.pop()
        hit = _linked(fps[left], np.broadcast_to(fps[i], len(left)).copy(), distance)
        if len(hit):
            found = left[hit]
            out.extend((i, int(j)) for j in found)
            frontier.extend(found.tolist())
            left = np.delete(left, hit)
    return out


def list_links(fps: np.ndarray, fixed: tuple[int, ...], distance: int) -> list[tuple[int, int]]:
    """Spanning links of a posting list of distinct fingerprints that share the bytes ``fixed``.

    A long list is cut by every pair of further positions: of the positions
    left, a linked pair shares at least 8 - distance - len(fixed), so some
    pair of them is among the cuts.
    """
    if len(fps) <= DIRECT:
        return _forest(fps, distance)
    rest = [p for p in range(8) if p not in fixed]
    need = 8 - distance - len(fixed)
    if need >= 1:
        out = []
        for more in combinations(rest, min(2, need)):
            key = np.zeros(len(fps), np.int64)
            for p in more:
                key = key << 8 | ((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    out.extend((int(part[i]), int(part[j])) for i, j in list_links(fps[part], (*fixed, *more), distance))
        return out
    return _flips(fps, rest, distance)


def _flips(fps: np.ndarray, rest: list[int], distance: int) -> list[tuple[int, int]]:
    """Links by looking up every change of up to ``distance`` bits in the bytes ``rest``."""
    order = np.argsort(fps)
    ranked = fps[order]
    out = []
    bits = [8 * p + b for p in rest for b in range(8)]
    for k in range(1, distance + 1):
        for change in combinations(bits, k):
            mask = np.uint64(sum(1 << b for b in change))
            other = ranked ^ mask
            up = np.flatnonzero(other > ranked)
            at = np.minimum(np.searchsorted(ranked, other[up]), len(ranked) - 1)
            hit = ranked[at] == other[up]
            out.extend(zip(order[up[hit]].tolist(), order[at[hit]].tolist(), strict=True))
    return _thin(out, len(fps))


def _thin_at(one: list[int], other: list[int], n: int) -> list[int]:
    """Positions of the links of a spanning forest, the earlier ones first."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (i, j) in enumerate(zip(one, other, strict=True)):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append(k)
    return out


def _thin(links: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of ``links``."""
    return [links[k] for k in _thin_at([i for i, _ in links], [j for _, j in links], n)]


def _posting_links(distance: int):
    def links(fps: np.ndarray, t: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        found = list_links(fps, (*TRIPLES[t], *(FURTHER[t][cut] if cut >= 0 else ())), distance)
        found = _thin(found, len(fps)) if len(fps) > DIRECT else found
        ij = np.array(found, np.int64).reshape(-1, 2)
        return fps[ij[:, 0]], fps[ij[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (t, key, cut, more), a list is what shares them; it may run over batches."""
        held: list[np.ndarray] = []  # of the list not known to be over
        held_at: tuple | None = None

        def close() -> list[tuple[np.ndarray, np.ndarray]]:
            fps = np.unique(np.concatenate(held))
            return [links(fps, held_at[0], held_at[2])] if len(fps) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            *at, fp = (batch.column(i).to_numpy() for i in range(5))
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, np.any([np.diff(x) != 0 for x in at], axis=0)])
            ends = np.r_[starts[1:], len(fp)]
            place = lambda i, at=at: tuple(int(x[i]) for x in at)
            out = []
            if held and place(0) == held_at:
                held.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if held:
                    out += close()
                held, held_at = [fp[starts[-1] :]], place(-1)
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            for n in np.unique(sizes[(sizes > 1) & (sizes <= 16)]):  # short lists, all of a length at once
                first = starts[sizes == n]
                for i, j in combinations(range(int(n)), 2):
                    a, b = fp[first + i], fp[first + j]
                    hit = _linked(a, b, distance)
                    out.append((a[hit], b[hit]))
            out += [links(np.unique(fp[a:b]), place(a)[0], place(a)[2]) for a, b in zip(starts[sizes > 16], ends[sizes > 16], strict=True)]
            if out:
                yield _pairs(out)
        if held and (out := close()):
            yield _pairs(out)

    return run


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch({"u": pa.array(np.concatenate([a for a, _ in out]).view(np.int64)), "v": pa.array(np.concatenate([b for _, b in out]).view(np.int64))})


def fingerprint_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``u, v`` whose components are those of all pairs of the distinct
    fingerprints ``fp`` within ``distance`` (at most 3) bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the triples guarantee pairs within 3 bits only")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    entries = F.array(*(F.struct(F.lit(k).alias("t"), (byte(a) * 65536 + byte(b) * 256 + byte(c)).alias("key")) for k, (a, b, c) in enumerate(TRIPLES)))
    postings = distinct.select("fp", F.explode(entries).alias("e")).select(F.col("e.t").alias("t"), F.col("e.key").alias("key"), "fp")
    long = if_small(materialize(postings.groupBy("t", "key").count().where(F.col("count") > SPLIT).select("t", "key", F.lit(True).alias("long")), "simhash-long"))
    cut = lambda k, i, j: F.struct(F.lit(k).alias("cut"), (byte(i) * 256 + byte(j)).cast("int").alias("more"))
    finer = F.coalesce(*(F.when(F.col("t") == t, F.array(*(cut(k, i, j) for k, (i, j) in enumerate(pairs)))) for t, pairs in enumerate(FURTHER)))
    whole = F.array(F.struct(F.lit(-1).alias("cut"), F.lit(0).alias("more")))
    dealt = postings.join(long, ["t", "key"], "left").select("t", "key", F.explode(F.when(F.col("long"), finer).otherwise(whole)).alias("c"), "fp").select("t", "key", "c.cut", "c.more", "fp")
    order = ["t", "key", "cut", "more"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_posting_links(distance), "u long, v long").distinct()


def near_groups(docs: DataFrame, size: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row; a component is a class of
    documents joined by links of at most ``distance`` bits, named by its
    smallest id.

    Defined cases: a null or wordless text has fingerprint 0, which links like
    any other; null ids never name a component that has another id; repeated
    rows are rows of one component; an empty table gives an empty result;
    other columns are ignored.
    """
    prints = materialize(fingerprints(docs, size, id_col, text_col), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = component_roots(fingerprint_links(distinct.select("fp"), distance), "simhash-links")
    joined = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "simhash-roots")
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------------------
# Similarity of 0.8 or more: the same index over wider fingerprints.

BLOCKS = 4  # of 64 bits
BYTES = 8 * BLOCKS
#: Entries of the wide index: pairs of byte positions, 16 side by side and 32 five apart.
PAIRS = [(i, i + 1) for i in range(0, BYTES, 2)] + [(i, (i + 5) % BYTES) for i in range(BYTES)]
#: Lists up to this length are compared many at once.
SHORT = 16
#: Longer lists than this are dealt out by pairs of blocks of about this length.
BLOCK = 8192
#: A block of a long list has about this many shingles at most.
BLOCK_SHINGLES = 2_000_000


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """An independent 64-bit hash of a hash (the finaliser of SplitMix64)."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BLOCKS`` SimHashes of the set of hashes."""
    hashes = np.unique(hashes)
    return np.array([fingerprint(_mix(hashes, b) if b else hashes) for b in range(BLOCKS)], np.uint64)


def _wide(size: int):
    pairs = np.array(PAIRS)
    names = np.arange(len(PAIRS), dtype=np.int32) << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t or b"", size) for t in batch.column(1).to_pylist()]
            fps, sizes = [wide_fingerprint(h) for h in hashes], [len(h) for h in hashes]
            raw = [f.view(np.uint8).astype(np.int32) for f in fps]
            keys = [names | r[pairs[:, 0]] << 8 | r[pairs[:, 1]] for r in raw]
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array([f.tobytes() for f in fps], pa.binary()), "n": pa.array(sizes, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int32()))})

    return run


def _near(fps: np.ndarray, one: np.ndarray, most: int, shared: int) -> np.ndarray:
    """Bits that differ between ``one`` and each of ``fps`` (or row by row); large where the count filter says no."""
    x = fps ^ one
    bits = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    close = np.flatnonzero(bits <= most)
    tally = (x[close].view(np.uint8) == 0).sum(axis=1)
    out = np.full(len(bits), 1 << 20)
    out[close[tally >= shared]] = bits[close[tally >= shared]]
    return out


def first_entry(fps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The first index entry that each pair of rows shares (``len(PAIRS)`` if none): the list that answers for it."""
    same = (fps ^ other).view(np.uint8).reshape(-1, BYTES) == 0
    out = np.full(len(same), len(PAIRS))
    for k in range(len(PAIRS) - 1, -1, -1):
        a, b = PAIRS[k]
        out[same[:, a] & same[:, b]] = k
    return out


def list_pairs(fps: np.ndarray, roots: np.ndarray, meets: np.ndarray, entry: int, most: int, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every candidate pair of a list (rows ``i < j``, and the bits that differ), a few rows at a time.

    A pair is a candidate if it passes the count filter, differs in ``most``
    bits and has different roots.  It is met in the list of the first entry
    that it shares and in no other.  ``meets`` has a row's block, doubled, and
    1 more where pairs within the block are met in this part of a long list.
    """
    n = len(fps)
    rows = max(1, (1 << 19) // max(1, n))
    for at in range(0, n, rows):
        part = fps[at : at + rows]
        bits = sum(np.bitwise_count(part[:, None, w] ^ fps[None, at:, w]).astype(np.int16) for w in range(BLOCKS))
        i, j = np.nonzero((bits <= most) & (roots[at : at + rows, None] != roots[None, at:]))
        i, j = i[i < j] + at, j[i < j] + at
        met = (meets[i] >> 1 != meets[j] >> 1) | (meets[i] & 1 == 1)
        i, j = i[met], j[met]
        d = _near(fps[i], fps[j], most, shared)
        keep = np.flatnonzero(d < 1 << 20)
        keep = keep[first_entry(fps[i[keep]], fps[j[keep]]) == entry]
        yield i[keep], j[keep], d[keep]


def nearest_links(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, bool]:
    """A spanning forest of least bits of the pairs, and whether it leaves any out."""
    kept, met = [np.empty((0, 3), np.int64)], 0
    for i, j, d in pairs:
        met += len(i)
        kept.append(np.column_stack((i, j, d)))
        if sum(map(len, kept)) > 8 * n + (1 << 19):
            kept = [_least_forest(np.concatenate(kept), n)]
    forest = _least_forest(np.concatenate(kept), n)
    return forest[:, :2], met > len(forest)


def _least_forest(links: np.ndarray, n: int) -> np.ndarray:
    """Kruskal over rows (i, j, bits)."""
    links = links[np.lexsort((links[:, 1], links[:, 0], links[:, 2]))]
    return links[_thin_at(links[:, 0].tolist(), links[:, 1].tolist(), n)]


def _by_list(columns: int, each, together=None):
    """Rows come sorted by (key, part), a list is what shares both: ``each(key, rows)`` has what goes
    out for a list of two rows or more, ``together(n, starts, key, rows)`` for all the whole lists of
    the same length ``n`` up to ``SHORT``.  ``rows`` are ids, roots, meets, fingerprints and the
    further columns (as Python lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the list not known to be over
        held_key = None

        def piece(rows: tuple, a: int, b: int) -> tuple:
            return tuple(x[a:b] for x in rows)

        def close() -> list:
            rows = tuple(np.concatenate([h[i] for h in held]) if i < 4 else [x for h in held for x in h[i]] for i in range(columns))
            return [each(held_key, rows)] if len(rows[0]) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, ids, roots, meets = (batch.column(i).to_numpy() for i in range(5))
            key = key.astype(np.int64) << 32 | part
            fps = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BLOCKS)
            rows = (ids, roots, meets, fps, *(batch.column(i + 2).to_pylist() for i in range(4, columns)))
            starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
            ends = np.r_[starts[1:], len(key)]
            out = []
            if held and key[0] == held_key:
                held.append(piece(rows, 0, ends[0]))
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if held:
                    out += close()
                held, held_key = [piece(rows, starts[-1], len(key))], int(key[-1])
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            if together:  # parts of long lists go by themselves, whatever their length
                alone = (sizes <= SHORT) & (part[starts] == 0)
                out += [together(int(n), starts[alone & (sizes == n)], key, rows) for n in np.unique(sizes[alone & (sizes > 1)])]
                starts, ends, sizes = starts[~alone], ends[~alone], sizes[~alone]
            out += [each(int(key[a]), piece(rows, a, b)) for a, b in zip(starts[sizes > 1], ends[sizes > 1], strict=True)]
            if out:
                yield _columns(out)
        if held and (out := close()):
            yield _columns(out)

    return run


def _columns(out: list[dict[str, pa.Array]]) -> pa.RecordBatch:
    return pa.record_batch({name: pa.concat_arrays([x[name] for x in out]) for name in out[0]})


def _forests(most: int, shared: int):
    """``u, v``: a spanning forest of every list's candidates; where that leaves any out, a row has the ``key``."""

    def rows_of(u: np.ndarray, v: np.ndarray, more: np.ndarray) -> dict[str, pa.Array]:
        none, blank = pa.nulls(len(more), pa.int64()), pa.nulls(len(u), pa.int32())
        return {"u": pa.concat_arrays([pa.array(u, pa.int64()), none]), "v": pa.concat_arrays([pa.array(v, pa.int64()), none]), "key": pa.concat_arrays([blank, pa.array((more >> 32).astype(np.int32))])}

    def each(key: int, rows: tuple) -> dict[str, pa.Array]:
        ids, roots, meets, fps = rows
        ij, more = nearest_links(list_pairs(fps, roots, meets, key >> 48, most, shared), len(ids))
        return rows_of(ids[ij[:, 0]], ids[ij[:, 1]], np.array([key] if more else [], np.int64))

    def together(n: int, at: np.ndarray, key: np.ndarray, rows: tuple) -> dict[str, pa.Array]:
        ids, roots, _, fps = rows
        found = []
        for i, j in combinations(range(n), 2):
            d = _near(fps[at + i], fps[at + j], most, shared)
            hit = np.flatnonzero((d < 1 << 20) & (roots[at + i] != roots[at + j]))
            hit = hit[first_entry(fps[at[hit] + i], fps[at[hit] + j]) == key[at[hit]] >> 48]
            found.append(np.column_stack((hit, d[hit], at[hit] + i, at[hit] + j)))
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        kept = found[_thin_at(found[:, 2].tolist(), found[:, 3].tolist(), len(ids))]
        more = np.bincount(found[:, 0], minlength=len(at)) > np.bincount(kept[:, 0], minlength=len(at))
        return rows_of(ids[kept[:, 2]], ids[kept[:, 3]], key[at[more]])

    return _by_list(4, each, together)


def _unresolved(most: int, shared: int):
    """The rows of a list that have a candidate of another root: ``key, part, node, root, meets, fp``."""

    def each(key: int, rows: tuple) -> dict[str, pa.Array]:
        ids, roots, meets, fps = rows
        ends = np.zeros(len(ids), bool)
        for i, j, _ in list_pairs(fps, roots, meets, key >> 48, most, shared):
            ends[i] = ends[j] = True
        at = np.flatnonzero(ends)
        place = lambda x: pa.array(np.full(len(at), x, np.int32))
        return {"key": place(key >> 32), "part": place(key & 0xFFFFFFFF), "node": pa.array(ids[at]), "root": pa.array(roots[at]), "meets": pa.array(meets[at]), "fp": pa.array([fps[i].tobytes() for i in at], pa.binary())}

    return _by_list(4, each)


def similar_pairs(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the pairs of sets (sorted, without repeats) have this Jaccard similarity or more; two empty sets have."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    _, codes = np.unique(flat, return_inverse=True)
    begins = np.r_[0, np.cumsum(sizes)]
    mark, good = np.zeros(int(codes.max(initial=-1)) + 1, bool), np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(i[order])) + 1, len(i)] if len(i) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        pairs = order[a:b]
        one, others = int(i[pairs[0]]), j[pairs]
        own = codes[begins[one] : begins[one + 1]]
        mark[own] = True
        at = 0
        while at < len(others):  # about a million shingles at a time
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[others[at:]]), 1 << 20)))
            some = others[at:end]
            starts = np.r_[0, np.cumsum(sizes[some])]
            within = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes[some]) + np.repeat(begins[some], sizes[some])
            hits = np.r_[0, np.cumsum(mark[codes[within]])]
            both = hits[starts[1:]] - hits[starts[:-1]]
            good[pairs[at:end]] = both >= similarity * (sizes[one] + sizes[some] - both)
            at = end
        mark[own] = False
    return good


def _confirmed(most: int, shared: int, similarity: float):
    """``u, v``: a spanning forest of every list's pairs of other roots that the sets of shingles confirm."""

    def each(key: int, rows: tuple) -> dict[str, pa.Array]:
        ids, roots, meets, fps, raw = rows
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        links = [np.empty((0, 2), np.int64)]
        for i, j, _ in list_pairs(fps, roots, meets, key >> 48, most, shared):
            good = similar_pairs(i, j, sets, similarity)
            links.append(np.column_stack((i[good], j[good])))
        links = np.concatenate(links)
        links = links[_thin_at(links[:, 0].tolist(), links[:, 1].tolist(), len(ids))]
        return {"u": pa.array(ids[links[:, 0]]), "v": pa.array(ids[links[:, 1]])}

    return _by_list(5, each)


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"node": batch.column(0), "set": pa.array([np.unique(shingle_hashes(t or b"", size)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())})

    return run


def _jaccard(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: bytes | None) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 64:
                    del sets[next(iter(sets))]
                sets[node] = np.unique(shingle_hashes(text or b"", size))
            return sets[node]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                one, other = of(u, a), of(v, b)
                both = len(np.intersect1d(one, other, assume_unique=True))
                union = len(one) + len(other) - both
                keep.append(union == 0 or both >= similarity * union)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _dealt(postings: DataFrame, long: DataFrame) -> DataFrame:
    """``key, part, node, root, meets, fp``: a row of a long list goes to every pair of blocks that
    has its own.  Rows of different blocks meet in one part, and so do rows of block b: in that
    which it shares with the block after it."""
    n = F.col("blocks")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    part = lambda b: F.struct((F.least(own, b) * n + F.greatest(own, b) + 1).alias("part"), (own * 2 + (b == (own + 1) % n).cast("int")).alias("meets"))
    parts = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda b: b != own), part)
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(1).alias("meets")))
    return postings.join(long, "key", "left").select("key", F.explode(F.coalesce(parts, whole)).alias("to"), "node", "root", "fp").select("key", "to.part", "node", "root", "to.meets", "fp")


def _verified_roots(distinct: DataFrame, rows: DataFrame, size: int, similarity: float, most: int, shared: int) -> DataFrame:
    """``node, root`` over all candidates of the index that the texts confirm.

    The first round verifies a spanning forest of each list.  A forest of
    candidates need not span what is confirmed, so lists with candidates left
    between components come again, with the shingles of the rows concerned:
    there every such pair is verified where it meets, and only confirmed links
    leave the task.  Every pair of a list is compared, however long the list is.
    """
    long = distinct.select(F.explode("keys").alias("key"), "n").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    long = if_small(materialize(long, "simhash-wide-long"))
    by_list = lambda df, f, kinds: df.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(f, kinds)
    postings = distinct.select(F.explode("keys").alias("key"), "node", F.col("node").alias("root"), "fp")
    found = materialize(by_list(_dealt(postings, long), _forests(most, shared), "u long, v long, key int"), "simhash-wide-found")
    edges = materialize(found.where("u IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "simhash-wide-links")
    ends = materialize(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct(), "simhash-wide-ends")
    texts = materialize(rows.join(if_small(ends), "id", "left_semi").dropDuplicates(["id"]), "simhash-wide-texts")
    paired = edges.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    linked = materialize(paired.select("u", "v", "a", "b").mapInArrow(_jaccard(size, similarity), "u long, v long"), "simhash-wide-linked")
    roots = component_roots(linked, "simhash-wide-components")

    still = materialize(found.where("key IS NOT NULL").select("key").distinct(), "simhash-wide-still")
    if still.isEmpty():
        return roots
    at = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    postings = at.select(F.explode("keys").alias("key"), "node", "root", "fp").join(if_small(still), "key", "left_semi")
    kinds = "key int, part int, node long, root long, meets int, fp binary"
    open_ = materialize(by_list(_dealt(postings, long), _unresolved(most, shared), kinds), "simhash-wide-open")
    ends = materialize(open_.select(F.col("node").alias("id")).distinct(), "simhash-wide-open-ends")
    # every end is the end of a forest's link as well, so its text has been written
    sets = texts.join(if_small(ends), "id", "left_semi").mapInArrow(_shingle_sets(size), "node long, set binary")
    again = open_.join(sets, "node").select("key", "part", "node", "root", "meets", "fp", "set")
    more = materialize(by_list(again, _confirmed(most, shared, similarity), "u long, v long"), "simhash-wide-more")
    if more.isEmpty():
        return roots
    return component_roots(more.union(linked), "simhash-wide-components")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 56, shared: int = 4) -> DataFrame:
    """``doc_id, component_id`` for every row with an id: classes of documents
    joined by links of Jaccard ``similarity`` or more between their sets of
    ``size``-word shingles.

    Candidates share an entry of the wide positional-byte index and pass the
    count filter; all of them are verified on the whole texts, but for those
    within a component that others confirm.
    At similarity 0.8 a byte is shared with probability 0.27, so that two
    documents share one of the 48 two-byte entries with probability 0.97, at
    0.9 of more than 0.999.

    Rows without an id are not grouped and not returned.  Wordless texts form
    one class; repeated rows share one.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = materialize(rows.mapInArrow(_wide(size), "id long, fp binary, n long, keys array<int>"), "simhash-wide")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("node"), F.max("n").alias("n"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "simhash-wide-distinct")
    roots = _verified_roots(distinct, rows, size, similarity, most_bits, shared)
    named = distinct.join(roots.select(F.col("node"), "root"), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), "component_id")
