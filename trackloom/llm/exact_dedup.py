"""Exact dedup: Patricia-trie owners.

1. Map side: every Arrow batch folds its rows by normalised text, so a text
   leaves a batch once however many copies the batch holds.  The row that
   leaves is a *local group*: its text, its ids (best first) and their count.
2. Owners: local groups are dealt by (byte length, 64-bit content hash); each
   owner task inserts the full byte strings into a compressed radix trie whose
   terminal nodes keep the best identifier and the member count.  A trie that
   outgrows its memory budget spills its heaviest subtrees: their terminals
   leave the task as rows, later keys of those subtrees follow them, and the
   next round deals them to owners anew.
3. Hot texts: a (length, hash) that more than ``FEW`` local groups share, and
   more than a ten-thousandth of all of them, is dealt over salts first; each
   salt's owner sends one group on.  At most 10,000 such keys can exist, so
   they may be broadcast.
4. Verdicts come back by local-group id, which is unique on both sides, so a
   text that a third of all rows share causes no skewed join.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

#: Local groups of one text that an owner takes without salting.
FEW = 64
#: Bytes that a trie node takes besides its label, and a terminal besides its groups.
NODE, END = 400, 200

_LABEL, _KIDS, _END = 0, 1, 2


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``."""
    hi = min(len(a), len(b) - at)
    if a[:hi] == b[at : at + hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """A radix trie over byte strings with path compression.

    A node is ``[edge label, children by first byte, terminal]``; a terminal
    is a list the caller owns.  A child that is None stands for a subtree that
    has been spilled.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes_held = 0
        self.terminals = 0

    def terminal(self, key: bytes) -> list | None:
        """The terminal of ``key``, made (empty) if it is new; None if its subtree has been spilled."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[_END] is None:
                    node[_END] = []
                    self.bytes_held += END
                    self.terminals += 1
                return node[_END]
            kids = node[_KIDS]
            kid = kids.get(key[at], False)
            if kid is None:
                return None
            if kid is False:
                end: list = []
                kids[key[at]] = [key[at:], {}, end]
                self.bytes_held += len(key) - at + NODE + END
                self.terminals += 1
                return end
            label = kid[_LABEL]
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            n = common_prefix(label, key, at)
            fork = [label[:n], {label[n]: kid}, None]
            kid[_LABEL] = label[n:]
            kids[key[at]] = fork
            self.bytes_held += NODE
            node, at = fork, at + n

    @staticmethod
    def walk(node: list, path: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            if node[_END] is not None:
                yield path, node[_END]
            stack.extend((kid, path + kid[_LABEL]) for kid in node[_KIDS].values() if kid is not None)

    def weights(self, weigh: Callable[[list], int]) -> dict[int, list[int]]:
        """Bytes and terminals below each node, by the node's identity."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(kid for kid in node[_KIDS].values() if kid is not None)
        out: dict[int, list[int]] = {}
        for node in reversed(order):
            below = [out[id(kid)] for kid in node[_KIDS].values() if kid is not None]
            held = NODE + len(node[_LABEL]) + (0 if node[_END] is None else END + weigh(node[_END]))
            out[id(node)] = [held + sum(x for x, _ in below), (node[_END] is not None) + sum(n for _, n in below)]
        return out


class TrieOwner:
    """Terminals for a stream of ``(key, payload)``, within a memory budget.

    ``merge(terminal, payload)`` folds a payload into a terminal; a terminal
    has the form of a payload, so a spilled one is merged like any other, and
    ``weigh(payload)`` is about its size in bytes.  When the trie holds more
    than ``budget`` bytes, its heaviest subtrees go to ``sink(key, payload)``
    until half the budget is held, and so do later keys of those subtrees.
    One terminal always stays, so that rounds over what was spilled come to an
    end.  Without a sink the spilled payloads are kept for ``drain``, which
    yields every terminal once.
    """

    def __init__(self, merge, budget: int = 64 << 20, sink=None, weigh=lambda payload: 0) -> None:
        self.merge, self.budget, self.weigh = merge, budget, weigh
        self.trie, self.spills = PatriciaTrie(), 0
        self.kept: list[tuple[bytes, tuple]] = []
        self.sink = sink or (lambda key, payload: self.kept.append((key, payload)))

    def add(self, key: bytes, payload) -> None:
        end = self.trie.terminal(key)
        if end is None:
            self.sink(key, payload)
            return
        before = self.weigh(end) if end else 0
        self.merge(end, payload)
        self.trie.bytes_held += self.weigh(end) - before
        if self.trie.bytes_held > self.budget and self.trie.terminals > 1:
            self._spill()

    def _spill(self) -> None:
        trie, target = self.trie, self.budget // 2
        weights = trie.weights(self.weigh)
        while trie.bytes_held > target and trie.terminals > 1:
            path, node, prefix = [trie.root], trie.root, b""
            while True:
                kids = {b: kid for b, kid in node[_KIDS].items() if kid is not None}
                if not kids:
                    return
                byte = max(kids, key=lambda b: weights[id(kids[b])][0])
                kid = kids[byte]
                held, ends = weights[id(kid)]
                if (held > target or ends == trie.terminals) and any(x is not None for x in kid[_KIDS].values()):
                    path.append(kid)
                    node, prefix = kid, prefix + kid[_LABEL]
                    continue
                break
            if ends == trie.terminals:
                return
            node[_KIDS][byte] = None
            for key, end in PatriciaTrie.walk(kid, prefix + kid[_LABEL]):
                self.sink(key, tuple(end))
            for x in path:
                weights[id(x)][0] -= held
                weights[id(x)][1] -= ends
            trie.bytes_held -= held
            trie.terminals -= ends
            self.spills += 1

    def drain(self) -> Iterator[tuple[bytes, list]]:
        yield from PatriciaTrie.walk(self.trie.root, b"")
        self.trie, kept = PatriciaTrie(), self.kept
        if kept:
            below = TrieOwner(self.merge, self.budget, weigh=self.weigh)
            for key, payload in kept:
                below.add(key, payload)
            yield from below.drain()


def _fold(largest: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        at = 0
        for batch in batches:
            groups: dict[bytes, list] = {}
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault((text or b"").lower(), []).append(ident)
            for ids in groups.values():
                ids.sort(key=lambda x: (x is None, (-x if largest else x) if x is not None else 0))
            yield pa.record_batch(
                {
                    "gid": pa.array(range(base + at, base + at + len(groups)), pa.int64()),
                    "sha": pa.array([hashlib.sha256(k).digest() for k in groups], pa.binary()),
                    "key": pa.array(list(groups), pa.binary()),
                    "ids": pa.array(list(groups.values()), pa.list_(pa.int64())),
                }
            )
            at += len(groups)

    return fold


def _own(largest: bool, budget: int, send_on: bool):
    def better(a, b) -> bool:
        """Is (id, gid) a ahead of b?  Null ids come last, ties go to the lower gid."""
        if (a[0] is None) != (b[0] is None):
            return b[0] is None
        if a[0] != b[0]:
            return a[0] > b[0] if largest else a[0] < b[0]
        return a[1] < b[1]

    def merge(end: list, payload) -> None:
        # terminal: best (id, gid), member count, then the local groups
        best, n, gids = payload
        if not end:
            end.extend((best, n, list(gids)))
            return
        if better(best, end[0]):
            end[0] = best
        end[1] += n
        end[2].extend(gids)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def spill(key: bytes, payload) -> None:
            nonlocal held
            best, n, gids = payload
            rows.append((SPILLED, None, best[0], n, best[1], key, list(gids)))
            held += len(key) + 8 * len(gids)

        owner = TrieOwner(merge, budget, spill, lambda payload: 120 + 40 * len(payload[2]))
        for batch in batches:
            for gids, key, best, best_gid, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owner.add(key, ((best, best_gid), n, gids))
                if held > 16 << 20:
                    yield _owned_rows(rows)
                    rows, held = [], 0
        for key, (best, n, gids) in owner.drain():
            rows.extend((VERDICT, gid, best[0], n, best[1], None, None) for gid in gids)
            if send_on:
                rows.append((SENT_ON, None, best[0], n, best[1], key, [best[1]]))
                held += len(key)
            if len(rows) >= 20_000 or held > 16 << 20:
                yield _owned_rows(rows)
                rows, held = [], 0
        if rows:
            yield _owned_rows(rows)

    return own


#: What an owner's row is: a group's verdict, a spilled terminal, or one group of a salt for the next level.
VERDICT, SPILLED, SENT_ON = 0, 1, 2
_OWNED = "state int, gid long, keep_id long, group_size long, win long, key binary, gids array<long>"
_OWNED_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def _owned_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _OWNED_KINDS, strict=True)], names=[c.split()[0] for c in _OWNED.split(", ")])


def _settled(groups: DataFrame, largest: bool, budget: int, send_on: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Verdicts of ``gids, key, best, best_gid, n, salt``, and with ``send_on`` one row of each salt's text."""
    done, sent, around = [], [], 0
    while True:
        dealt = groups.repartition(F.octet_length("key"), F.xxhash64("key", F.lit(around)), "salt").select("gids", "key", "best", "best_gid", "n")
        out = materialize(dealt.mapInArrow(_own(largest, budget, send_on), _OWNED), "exact-owned")
        done.append(out.where(F.col("state") == VERDICT).select("gid", "keep_id", "group_size", "win"))
        form = lambda state, out=out: out.where(F.col("state") == state).select("gids", "key", F.col("keep_id").alias("best"), F.col("win").alias("best_gid"), F.col("group_size").alias("n"), F.lit(0).alias("salt"))
        sent.append(form(SENT_ON))
        groups = form(SPILLED)
        if groups.isEmpty():
            break
        around += 1
    union = lambda parts: functools.reduce(DataFrame.unionAll, parts)
    return union(done), union(sent) if send_on else None


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", budget: int = 64 << 20) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only.  ``keep`` says
    which identifier of a group stays, ``smallest`` or ``largest``.

    Defined cases: a null text counts as empty; a null id loses to any other;
    among repeated rows with the winning id exactly one is kept; texts may be
    of any length (an owner holds ``budget`` bytes, or one text if that is
    longer); an empty table gives an empty result; other columns of ``docs``
    are ignored.
    """
    largest = keep == "largest"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    local = rows.mapInArrow(_fold(largest), "gid long, sha binary, key binary, ids array<long>").withColumns({"len": F.octet_length("key"), "h": F.xxhash64("key")})
    local = materialize(local, "exact-local")
    groups = local.select(F.array("gid").alias("gids"), "key", F.element_at("ids", 1).alias("best"), F.col("gid").alias("best_gid"), F.size("ids").cast("long").alias("n"), F.lit(0).alias("salt"), "len", "h")
    least = max(FEW, local.count() // 10_000)
    hot = materialize(local.groupBy("len", "h").count().where(F.col("count") > least), "exact-hot")
    if hot.isEmpty():
        owned, _ = _settled(groups, largest, budget)
    else:
        salted = groups.join(F.broadcast(hot), ["len", "h"]).withColumn("salt", F.pmod("best_gid", F.ceil(F.sqrt("count"))).cast("int"))
        first, sent = _settled(salted, largest, budget, send_on=True)
        cold = groups.join(F.broadcast(hot), ["len", "h"], "left_anti").select(*sent.columns)
        second, _ = _settled(cold.unionAll(sent), largest, budget)
        # a group of a hot text has the verdict of the group that its salt sent on
        onward = first.select("gid", F.col("win").alias("via")).join(second.withColumnRenamed("gid", "via"), "via").select("gid", "keep_id", "group_size", "win")
        owned = second.join(first.select("gid"), "gid", "left_anti").unionAll(onward)
    return (
        local.select("gid", "sha", "ids")
        .join(owned, "gid")
        .select("gid", "keep_id", "group_size", "win", F.lower(F.hex("sha")).alias("text_sha256"), F.posexplode("ids").alias("pos", "doc_id"))
        .select("doc_id", "keep_id", "group_size", ((F.col("gid") == F.col("win")) & (F.col("pos") == 0)).alias("kept"), "text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
