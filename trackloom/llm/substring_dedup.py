"""Substring dedup: suffix automata of reference shards.

A window of ``size`` words goes where the same words start in a document with
a smaller id.  Every document is a possible reference for every other, so the
work is first routed, then decided by automata:

1. *Anchors.*  Each window names its least hash of 7 words (its minimiser).
   Equal windows name the same anchor, and neighbouring windows mostly share
   one, so there is an anchor for about four words.  Tasks pack their anchors
   into sorted, compressed blocks by anchor bucket; a bucket finds the anchors
   that two ids have, and the smallest id owns them.  An anchor that one block
   holds many times is folded there, and its other holders are joined to it
   apart, so a bucket gets a bounded number of rows from each block.
2. *Reference shards.*  The stretches of an owner whose windows have shared
   anchors form its shard; the same stretches of the others are dealt to it.
   An anchor that many documents have is dealt over many salts, and the shard
   is broadcast to each of them, so no passage meets in one task.  A long
   owner is cut into pieces of ``PIECE`` windows, each a shard of its own.
3. *Automata.*  A task builds the suffix automaton of a shard and streams the
   stretches dealt to it for their matching statistics: wherever the longest
   match has ``size`` words or more, the window that ends there is the
   owner's as well, and goes.
4. *Rest.*  A window that its owner lacks (it only shares the anchor) may
   still be a third document's.  All holders of such a window are among the
   windows left over.  Those whose 64-bit hash two ids have are spelled out,
   and the smallest id for the same words settles them.

Nothing is broadcast to all tasks that grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

#: Words hashed together in an anchor.
GRAM = 7
#: A shard serves about this many documents for each salt.
PER_SALT = 128
#: Windows of an owner in one shard, so that an automaton is bounded however long a document is.
PIECE = 1 << 16
#: Owners of several pieces that are broadcast; more of them are joined by key.
LONG_OWNERS = 100_000
#: Stands for a null id: larger than any other.
NULL_ID = (1 << 63) - 1
#: Words hashed at a time, and anchors in a block.
WORDS, BLOCK = 300_000, 1_000_000
#: An anchor held more often than this in one block is folded.
FOLD = 32

_ODD = np.array([((2 * i + 1) * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 * i) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1024)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    k = len(h) - n + 1
    total = np.zeros(max(k, 0), np.uint64)
    for i in range(n) if k > 0 else ():
        total += _mix(h[i : i + k] + np.uint64(i)) * _ODD[i % len(_ODD)] + (total << np.uint64(1))
    return _mix(total)


def window_anchors(h: np.ndarray, size: int) -> np.ndarray:
    """The minimiser of every window of ``size`` words (none if there are fewer), as 48 bits."""
    if len(h) < size:
        return np.empty(0, np.int64)
    low, width = gram_hashes(h, min(GRAM, size)), 1
    want = size - min(GRAM, size) + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return (low >> np.uint64(16)).view(np.int64)


class SuffixAutomaton:
    """Of a sequence of hashables; grows one symbol at a time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def extend(self, seq) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = self.last
        for c in seq:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.last = last

    def statistics(self, seq) -> list[int]:
        """For each position the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        at = n = 0
        out = []
        for c in seq:
            to = nxt[at].get(c)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nxt[at].get(c)
            if to is None:
                n = 0
            else:
                at, n = to, n + 1
            out.append(n)
        return out


def pack(x: np.ndarray) -> bytes:
    """64-bit integers, their byte planes compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()


def scatter(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, list]:
    """A row for each bucket, with the packed values of its entries."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    starts = np.r_[0, cuts] if len(ordered) else np.empty(0, np.int64)
    out: dict[str, list] = {"bucket": ordered[starts].tolist()}
    for name, x in columns.items():
        out[name] = [pack(part) for part in np.split(x[order], cuts)] if len(ordered) else []
    return out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of consecutive texts, about ``WORDS`` at a time, with the first text's position."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        words = text.split()
        held.append(words)
        n += len(words)
        if n >= WORDS:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def chunk_anchors(split: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of several texts at once: anchor, text, first word in its text."""
    flat = [w for words in split for w in words]
    lengths = np.array([len(w) for w in split], np.int64)
    m = window_anchors(word_hashes(flat), size)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(split)), lengths)[: len(m)]
    at = np.arange(len(m))
    inside = at + size <= ends[text]  # no window runs over the end of its text
    return m[inside], text[inside], (at - (ends - lengths)[text])[inside]


_FIRST = "kind int, id long, h long, n_words long, sha binary, bucket long, a binary, key binary, ord binary, weight binary, hot_a binary, hot_key binary"
_FIRST_KINDS = [("kind", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("bucket", pa.int64()), ("a", pa.binary()), ("key", pa.binary()), ("ord", pa.binary()), ("weight", pa.binary()), ("hot_a", pa.binary()), ("hot_key", pa.binary())]


def _rows_of(kinds: list, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in kinds], names=[name for name, _ in kinds])


def _first_pass(size: int, buckets: int):
    """A row of kind 0 for each document, rows of kind 1 with packed anchors for buckets."""

    def block(a: np.ndarray, key: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rank, a))
        a, key, rank = a[order], key[order], rank[order]
        starts = np.flatnonzero(np.r_[True, np.diff(a) != 0])
        nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        kept = nth < FOLD
        # of a folded anchor the holder with the largest id matters too: it may be the only other id
        last = np.r_[np.diff(a) != 0, True]
        kept |= last
        # it stands for the holders left out as well
        weight = np.where(last & (nth > FOLD), nth - FOLD + 1, 1)
        rows = scatter(a[kept] & (buckets - 1), {"a": a[kept], "key": key[kept], "ord": rank[kept], "weight": weight[kept]})
        out = _rows_of(_FIRST_KINDS, kind=[1] * len(rows["bucket"]), **rows)
        if not kept.all():
            hot = scatter(a[~kept] & (buckets - 1), {"hot_a": a[~kept], "hot_key": key[~kept]})
            out = pa.concat_batches([out, _rows_of(_FIRST_KINDS, kind=[2] * len(hot["bucket"]), **hot)])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0
        for batch in batches:
            ids, hs, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            n_words, shas = [], []
            for first, split in _chunks(texts):
                n_words += [len(w) for w in split]
                shas += [hashlib.sha256(b" ".join(w)).digest() for w in split]
                m, text, _ = chunk_anchors(split, size)
                if not len(m):
                    continue
                order = np.lexsort((m, text))
                m, text = m[order], text[order] + first
                once = np.r_[True, (np.diff(m) != 0) | (np.diff(text) != 0)]
                m, text = m[once], text[once]
                rank = ids[text]
                held.append((m, np.where(rank == NULL_ID, hs[text], rank), rank))
                n_held += len(m)
                if n_held >= BLOCK:
                    yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n_held = [], 0
            yield _rows_of(_FIRST_KINDS, kind=[0] * len(texts), id=ids, h=hs, n_words=n_words, sha=shas)
        if held:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


_LISTED = "bucket long, key binary, a binary, owner binary, n binary, shared_a long, shared_owner long, shared_n long"
_LISTED_KINDS = [("bucket", pa.int64()), ("key", pa.binary()), ("a", pa.binary()), ("owner", pa.binary()), ("n", pa.binary()), ("shared_a", pa.int64()), ("shared_owner", pa.int64()), ("shared_n", pa.int64())]


def _owners(buckets: int):
    """Rows come sorted by bucket.  Out go the shared anchors' holders, packed by bucket of
    their key, and each folded anchor with its owner."""

    def settle(rows: list[tuple]) -> tuple[tuple, list[tuple]] | None:
        a, key, rank, weight = (np.concatenate([unpack(r[i]) for r in rows]) for i in range(4))
        order = np.lexsort((rank, a))
        a, key, rank, weight = a[order], key[order], rank[order], weight[order]
        starts = np.flatnonzero(np.r_[True, np.diff(a) != 0])
        ends = np.r_[starts[1:], len(a)]
        owner, n, total = rank[starts], ends - starts, np.add.reduceat(weight, starts)
        shared = owner < rank[ends - 1]
        fold = shared & (n > FOLD)
        folded = list(zip(a[starts][fold].tolist(), owner[fold].tolist(), total[fold].tolist(), strict=True))
        pick = np.repeat(shared, n)
        return (key[pick], a[pick], np.repeat(owner, n)[pick], np.repeat(total, n)[pick]), folded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, held, n_held = None, [], [], 0

        def emit():
            key, a, owner, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return _rows_of(_LISTED_KINDS, **scatter(xxhash_of(key) & (buckets - 1), {"key": key, "a": a, "owner": owner, "n": n}))

        def close():
            nonlocal n_held
            entries, folded = settle(rows)
            held.append(entries)
            n_held += len(entries[0])
            return _rows_of(_LISTED_KINDS, shared_a=[x[0] for x in folded], shared_owner=[x[1] for x in folded], shared_n=[x[2] for x in folded]) if folded else None

        for batch in batches:
            for b, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if rows and (out := close()):
                        yield out
                    if n_held >= BLOCK:
                        yield emit()
                        held, n_held = [], 0
                    bucket, rows = b, []
                rows.append(packed)
        if rows and (out := close()):
            yield out
        if held:
            yield emit()

    return run


def xxhash_of(key: np.ndarray) -> np.ndarray:
    return (_mix(key.view(np.uint64)) >> np.uint64(16)).view(np.int64)


def _lists():
    """Rows come sorted by bucket; out goes one row a key with its shared anchors."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        key, a, owner, n = (np.concatenate([unpack(r[i]) for r in rows]) for i in range(4))
        order = np.argsort(key, kind="stable")
        key, a, owner, n = key[order], a[order], owner[order], n[order]
        starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        offsets = pa.array(np.r_[starts, len(key)].astype(np.int32))
        return pa.record_batch({"key": pa.array(key[starts]), **{name: pa.ListArray.from_arrays(offsets, pa.array(x)) for name, x in (("a", a), ("owner", owner), ("n", n))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if rows:
                        yield settle(rows)
                    bucket, rows = b, []
                rows.append(packed)
        if rows:
            yield settle(rows)

    return run


def _unfold():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.record_batch({"shared_a": pa.array(unpack(a)), "key": pa.array(unpack(key))})

    return run


def _salts(count: np.ndarray) -> np.ndarray:
    return -(-count // PER_SALT)


def _runs(mask: np.ndarray, *same: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches (first, end) of true positions with equal values of ``same``."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    breaks = np.diff(at) != 1
    for x in same:
        breaks |= np.diff(x[at]) != 0
    cut = np.flatnonzero(breaks)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + 1).tolist(), strict=True))


_SHARD = "owner long, salt long, piece int, role int, id long, h long, firsts array<int>, words binary"
_SHARD_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]


def _stretches(size: int):
    """Rows for the shards: each document's stretches for each (owner, salt), with role 1.
    An owner's own stretches have role 0, their piece, and in place of a salt the number of
    salts that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # an anchor's owner does not depend on the document: one table for the batch
            a, owners, counts = (batch.column(i).flatten().to_numpy() for i in (3, 4, 5))
            a, once = np.unique(a, return_index=True)
            owners, salts = owners[once], _salts(counts[once])
            for base, split in _chunks(batch.column(2).to_pylist()):
                m, text, first = chunk_anchors(split, size)
                if not len(m) or not len(a):
                    continue
                at = np.minimum(np.searchsorted(a, m), len(a) - 1)
                shared = a[at] == m
                owner, n_salts = np.where(shared, owners[at], -1), np.where(shared, salts[at], 0)
                ident = ids[base : base + len(split)][text]
                own = shared & (owner == ident)
                follows = shared & ~own
                here = slice(base, base + len(split))
                seed = xxhash_of(hs[here] ^ xxhash_of(ids[here])) & 0x7FFFFFFF  # equal texts part as well
                salt = seed[text] % np.maximum(n_salts, 1)
                piece = first // PIECE
                found: dict[tuple[int, int, int, int, int], list[tuple[int, int]]] = {}
                for i, j in _runs(follows, owner, salt, text):
                    found.setdefault((int(owner[i]), int(salt[i]), 0, 1, int(text[i])), []).append((int(first[i]), int(first[i]) + j - i))
                for i, j in _runs(own, n_salts, piece, text):
                    found.setdefault((int(ident[i]), int(n_salts[i]), int(piece[i]), 0, int(text[i])), []).append((int(first[i]), int(first[i]) + j - i))
                rows = [(o, s, p, role, int(ids[base + t]), int(hs[base + t]), *_cut(split[t], runs, size)) for (o, s, p, role, t), runs in found.items()]
                for i in range(0, len(rows), 4000):
                    columns = zip(*rows[i : i + 4000], strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, _SHARD_KINDS, strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])

    return run


def _cut(words: list[bytes], runs: list[tuple[int, int]], size: int) -> tuple[list[int], bytes]:
    """First windows of the runs, and the words of each run (a line each)."""
    return [a for a, _ in runs], b"\n".join(b" ".join(words[a : b + size - 1]) for a, b in runs)


_FOUND = "id long, h long, first array<int>, end array<int>, pos array<int>, hash array<long>"
_FOUND_KINDS = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]


def _matched(statistics: list[int], start: int, size: int, first: list[int], end: list[int]) -> list[int]:
    """Adds the runs of matched windows to ``first`` and ``end``; the windows left over."""
    left, open_ = [], False
    for i in range(size - 1, len(statistics)):
        at = start + i - size + 1
        if statistics[i] >= size:
            if open_:
                end[-1] = at + 1
            else:
                first.append(at)
                end.append(at + 1)
                open_ = True
        else:
            left.append(at)
            open_ = False
    return left


def _match(size: int):
    """Rows come sorted by (owner, salt, piece, role): a shard's reference, then its documents."""

    def rows_of(out: list[tuple], rest_words: list[bytes], rest_at: list[int]) -> pa.RecordBatch:
        # hashes of all windows left over in the batch, in one go
        h = gram_hashes(word_hashes(rest_words), size).view(np.int64)[rest_at].tolist() if rest_at else []
        at, rows = 0, []
        for *row, pos in out:
            rows.append((*row, pos, h[at : at + len(pos)]))
            at += len(pos)
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _FOUND_KINDS, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, number, marks = None, SuffixAutomaton(), {}, 0
        for batch in batches:
            out: list[tuple] = []
            rest_words: list[bytes] = []
            rest_at: list[int] = []
            for owner, salt, piece, role, ident, h, firsts, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, salt, piece) != shard:
                    shard, automaton, number, marks = (owner, salt, piece), SuffixAutomaton(), {}, 0
                lines = [line.split(b" ") for line in words.split(b"\n")]
                if role == 0:
                    for line in lines:
                        marks -= 1  # no match runs over the end of a stretch
                        automaton.extend([number.setdefault(w, len(number)) for w in line])
                        automaton.extend([marks])
                    continue
                first, end, pos = [], [], []
                for start, line in zip(firsts, lines, strict=True):
                    left = _matched(automaton.statistics(map(number.get, line)), start, size, first, end)
                    if left:
                        pos += left
                        rest_at += [len(rest_words) + x - start for x in left]
                        rest_words += line
                out.append((ident, h, first, end, pos))
                if len(rest_words) > WORDS:
                    yield rows_of(out, rest_words, rest_at)
                    out, rest_words, rest_at = [], [], []
            if out:
                yield rows_of(out, rest_words, rest_at)

    return run


def _spell(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, h, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                yield pa.record_batch({"id": pa.array([ident] * len(places), pa.int64()), "h": pa.array([h] * len(places), pa.int64()), "pos": pa.array(places, pa.int32()), "words": pa.array([b" ".join(words[p : p + size]) for p in places], pa.binary())})

    return run


def late_windows(found: DataFrame, candidates: DataFrame, size: int) -> DataFrame:
    """``id, h, first, end``: of the windows left over (``pos`` and ``hash`` of ``found``), those whose
    words a smaller id has as well.  Hashes only say which windows to spell out."""
    rest = found.where(F.size("pos") > 0).select("id", "h", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select("id", "h", F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"))
    twice = rest.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("top")).where("least < top").select("hash")
    places = rest.join(twice, "hash", "left_semi").groupBy("id", "h").agg(F.collect_set("pos").alias("places"))
    spelled = candidates.select("id", "h", "text").join(places, ["id", "h"]).mapInArrow(_spell(size), "id long, h long, pos int, words binary")
    spelled = materialize(spelled, "substring-spelled")
    least = spelled.groupBy("words").agg(F.min("id").alias("least"), F.max("id").alias("top")).where("least < top").select("words", "least")
    late = spelled.join(least, "words").where("id > least").groupBy("id", "h").agg(F.collect_set("pos").alias("first"))
    return late.select("id", "h", "first", F.transform("first", lambda p: p + 1).alias("end"))


def _dealt(stretches: DataFrame, pieces: DataFrame) -> DataFrame:
    """An owner's rows for each of its salts, the others' for each piece of their owner (``owner, pieces``: those of several)."""
    salts = F.when(F.col("role") == 0, F.sequence(F.lit(0).cast("long"), F.col("salt") - 1)).otherwise(F.array("salt"))
    each = stretches.select("owner", F.explode(salts).alias("salt"), "piece", "role", "id", "h", "firsts", "words")
    # a checked bound for the broadcast; more long owners are joined by key
    few = pieces.limit(LONG_OWNERS + 1).count() <= LONG_OWNERS
    every = F.when((F.col("role") == 1) & F.col("pieces").isNotNull(), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array("piece"))
    return each.join(F.broadcast(pieces) if few else pieces, "owner", "left").select("owner", "salt", F.explode(every).alias("piece"), "role", "id", "h", "firsts", "words")


def _remove(size: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept_texts = [], [], []
            for text, first, end in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for a, b in zip(first, end, strict=True):  # windows a to b - 1 cover words a to b + size - 2
                    edge[a] += 1
                    edge[b + size - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).digest())
                kept_texts.append(kept.decode("utf-8", "replace") if texts else None)
            yield pa.record_batch({"id": batch.column(0), "h": batch.column(1), "n_removed": pa.array(removed, pa.int64()), "kept_sha": pa.array(shas, pa.binary()), "kept": pa.array(kept_texts, pa.string())})

    return run


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row, and with
    ``texts`` the kept words of rows that lose some (``kept``).

    Every word goes that is covered by a window of ``size`` words which also
    starts in a row with a smaller id.

    Defined cases: null texts have no words; a null id counts as larger than
    any other; rows with one id never cost each other words; texts of fewer
    words than a window keep all; texts may be of any length; an empty table
    gives an empty result; other columns are ignored.
    """
    n = docs.count()
    buckets = 1 << max(8, min(22, (n // 64).bit_length()))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    keyed = rows.select("id", F.xxhash64("text").alias("h"), "text")
    everything = materialize(keyed.mapInArrow(_first_pass(size, buckets), _FIRST), "substring-first")
    first = everything.where("kind = 0").select("id", "h", "n_words", "sha")

    packed = everything.where("kind = 1").select("bucket", "a", "key", "ord", "weight")
    settled = materialize(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_owners(buckets), _LISTED), "substring-shared")
    folded = settled.where("shared_a IS NOT NULL").select("shared_a", "shared_owner", "shared_n").distinct()
    holders = everything.where("kind = 2").select("hot_a", "hot_key").mapInArrow(_unfold(), "shared_a long, key long")
    more = holders.join(folded, "shared_a").groupBy("key").agg(F.collect_list(F.struct("shared_a", "shared_owner", "shared_n")).alias("x")).select("key", F.col("x.shared_a").alias("a"), F.col("x.shared_owner").alias("owner"), F.col("x.shared_n").alias("n"))
    lists = settled.where("bucket IS NOT NULL").select("bucket", "key", "a", "owner", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_lists(), "key long, a array<long>, owner array<long>, n array<long>")
    # a key has a row from its bucket, and one more if it holds folded anchors
    both = lists.join(more.select("key", F.col("a").alias("a2"), F.col("owner").alias("owner2"), F.col("n").alias("n2")), "key", "full")
    none = F.array().cast("array<long>")
    listed = both.select("key", *(F.concat(F.coalesce(c, none), F.coalesce(f"{c}2", none)).alias(c) for c in ("a", "owner", "n")))
    with_key = keyed.withColumn("key", F.when(F.col("id") == NULL_ID, F.col("h")).otherwise(F.col("id")))
    candidates = materialize(with_key.join(listed, "key").select("id", "h", "text", "a", "owner", "n"), "substring-candidates")

    pieces = first.where(F.col("n_words") > PIECE).groupBy(F.col("id").alias("owner")).agg(F.ceil(F.max("n_words") / PIECE).cast("int").alias("pieces"))
    dealt = _dealt(candidates.mapInArrow(_stretches(size), _SHARD), materialize(pieces, "substring-pieces"))
    shard = ["owner", "salt", "piece"]
    found = materialize(dealt.repartition(*shard).sortWithinPartitions(*shard, "role").mapInArrow(_match(size), _FOUND), "substring-found")

    late = late_windows(found, candidates, size)
    spans = found.where(F.size("first") > 0).select("id", "h", "first", "end").unionByName(late).groupBy("id", "h").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("end")).alias("end"))
    changed = candidates.select("id", "h", "text").join(spans, ["id", "h"]).select("id", "h", "text", "first", "end").mapInArrow(_remove(size, texts), "id long, h long, n_removed long, kept_sha binary, kept string")
    changed = changed.dropDuplicates(["id", "h"])  # repeated rows lose the same words
    out = first.join(changed, ["id", "h"], "left")
    return out.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"), *(["kept"] if texts else []))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
r AS (SELECT doc_id, i FROM t QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
g AS (SELECT doc_id, list(j ORDER BY j) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r) GROUP BY 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM g)),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) FILTER (q.j IS NULL) AS kept FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS j FROM g) q ON q.doc_id = x.doc_id AND q.j = x.j GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN y USING (doc_id)
"""
