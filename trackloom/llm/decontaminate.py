"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Documents and test strings become sequences of word numbers (0: a word that no
test string has).  For the patterns of one length, a block shift table says
how far a window may move when it ends in a given block of words; a block of
shift 0 selects the bucket of patterns with that suffix, and direct
comparison confirms an occurrence.

Patterns are the one thing broadcast.  Their size is checked: distinct windows
are counted by their bytes, and those beyond ``block_bytes`` are cut into
blocks.  Each block is a pass of its own over the documents, in its own Python
workers, so a worker holds the tables of one block; it keeps them for its
later tasks.
"""

from __future__ import annotations

import array
import functools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

#: Lower-cases A-Z; every byte that is no word byte becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows_of(words: list, size: int) -> list[tuple]:
    """All windows of ``size`` words; a shorter sequence, but not an empty one, is one window."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Occurrences of equally long sequences of numbers in a sequence."""

    def __init__(self, patterns: Iterable[tuple[int, ...]], base: int, block: int = 3) -> None:
        self.base = base
        self.flat = array.array("q")  # all patterns, one after the other
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, int | list[int]] = {}
        for k, pattern in enumerate(patterns):
            if not k:
                self.m = len(pattern)
                self.block = min(block, self.m)
                self.far = self.m - self.block + 1
            for end in range(self.block, self.m + 1):
                key = self._key(pattern, end - self.block)
                self.shift[key] = min(self.shift.get(key, self.far), self.m - end)
            self.flat.extend(pattern)
            key = self._key(pattern, self.m - self.block)
            others = self.bucket.get(key)
            if others is None:
                self.bucket[key] = k
            elif isinstance(others, int):
                self.bucket[key] = [others, k]
            else:
                others.append(k)

    def _key(self, seq, at: int) -> int:
        key = 0
        for x in seq[at : at + self.block]:
            key = key * self.base + x
        return key

    def search(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence."""
        m, base, far, shift, n = self.m, self.base, self.far, self.shift, len(seq)
        at = m  # one past the window's last word
        if self.block == 3:
            while at <= n:
                last = seq[at - 1]
                key = (seq[at - 3] * base + seq[at - 2]) * base + last
                s = shift.get(key, far) if last else far
                if s:
                    at += s
                    continue
                yield from self._confirm(seq, at, key)
                at += 1
            return
        while at <= n:
            key = self._key(seq, at - self.block)
            s = shift.get(key, far)
            if s:
                at += s
                continue
            yield from self._confirm(seq, at, key)
            at += 1

    def _confirm(self, seq: list[int], at: int, key: int) -> Iterator[tuple[int, int]]:
        window, m, flat = array.array("q", seq[at - self.m : at]), self.m, self.flat
        found = self.bucket.get(key, ())
        for k in (found,) if isinstance(found, int) else found:
            if flat[k * m : k * m + m] == window:
                yield at - m, k


class PatternSet:
    """Windows (their words joined by a space) and the items that have them, ready to search."""

    def __init__(self, windows: list[tuple[bytes, list]]) -> None:
        self.number: dict[bytes, int] = {}
        by_length: dict[int, tuple[list[bytes], list]] = {}
        same: dict[tuple, tuple] = {}
        for window, items in windows:
            some, names = by_length.setdefault(window.count(b" ") + 1, ([], []))
            some.append(window)
            names.append(same.setdefault(tuple(items), tuple(items)))
            for w in window.split():
                self.number.setdefault(w, len(self.number) + 1)
        number, base = self.number, len(self.number) + 1
        self.searches = [(WuManber((tuple([number[w] for w in x.split()]) for x in some), base), names) for some, names in by_length.values()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans (first word, one past the last) and the items hit."""
        get = self.number.get
        seq = [get(w, 0) for w in words]
        spans, items = [], set()
        for search, names in self.searches:
            for start, k in search.search(seq):
                spans.append((start, start + search.m))
                items.update(names[k])
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b" ".join(w), item) for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in windows_of(words_of(text), size)]
            yield pa.record_batch({"window": pa.array([w for w, _ in found], pa.binary()), "item": pa.array([i for _, i in found], pa.string())})

    return run


_BUILT: dict[str, PatternSet] = {}


def _patterns(token: str, broadcast) -> PatternSet:
    """The tables of a block, made once for each Python worker."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = PatternSet(broadcast.value)
    return _BUILT[token]


_STATE = "id long, h long, n long, n_words long, spans array<struct<first: long, end: long>>, items array<string>, shared array<long>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _in_order(items: set) -> list:
    return sorted(items, key=lambda x: (x is None, x or ""))


def _search(token: str, broadcast, every: bool):
    """A row for each document, or for each that is hit."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(token, broadcast)
        for batch in batches:
            spans_out, items_out, shared_out, n_out, rows = [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                words = words_of(text or b"")
                spans, items = patterns.find(words)
                if every or spans:
                    rows.append(i)
                    n_out.append(len(words))
                    spans_out.append([{"first": a, "end": b} for a, b in spans])
                    # a window of many items goes by a number
                    shared_out.append([x for x in items if isinstance(x, int)])
                    items_out.append(_in_order({x for x in items if not isinstance(x, int)}))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.record_batch({**{c: kept.column(c) for c in ("id", "h", "n")}, "n_words": pa.array(n_out, pa.int64()), "spans": pa.array(spans_out, _SPANS), "items": pa.array(items_out, pa.list_(pa.string())), "shared": pa.array(shared_out, pa.list_(pa.int64()))})

    return search


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"first": a, "end": b} for a, b in merge_spans([(x["first"], x["end"]) for x in some])] for some in batch.column("spans").to_pylist()]
        items = [_in_order(set(some)) for some in batch.column("items").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("id"), "n_words": batch.column("n_words"), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))})


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20, most_names: int = 256) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every row: the word spans inside any
    occurrence of a benchmark window, and the items whose windows occur.

    ``block_bytes`` bounds the distinct windows (each with all its words) and the names of
    their items that one pass searches; a worker's tables take about eight
    times that.  A window of more than ``most_names`` items takes part by a number, and
    their names are joined to what it hits afterwards.

    Defined cases: null texts have no words; an item without an id is named
    null; items without words match nothing; repeated rows and items are
    searched like any other; texts and items may be of any length; either
    table may be empty; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("binary").alias("text")).where(F.col("text").isNotNull())
    windows = materialize(items.mapInArrow(_item_windows(size), "window binary, item string").distinct(), "benchmark-windows")
    names = windows.groupBy("window").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("item"), F.lit(0)) + 64).alias("bytes"))
    names = materialize(names.select("window", "bytes", F.when(F.col("n") > most_names, F.monotonically_increasing_id()).alias("key")), "benchmark-names")
    sums = names.agg(F.coalesce(F.sum(F.octet_length("window") + F.when(F.col("key").isNull(), F.col("bytes")).otherwise(64)), F.lit(0)).alias("b"), F.count("key").alias("shared")).first()
    blocks = max(1, -(-sums["b"] // block_bytes))
    named = windows.join(names.where("key IS NULL").select("window"), "window") if sums["shared"] else windows
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    passes = []
    for block in range(blocks):
        here = F.pmod(F.xxhash64("window"), F.lit(blocks)) == block
        patterns = [(bytes(r["window"]), sorted((x["item"] for x in r["items"]), key=lambda x: (x is None, x or ""))) for r in named.where(here).groupBy("window").agg(F.collect_list(F.struct("item")).alias("items")).collect()]
        if sums["shared"]:
            patterns += [(bytes(r["window"]), [r["key"]]) for r in names.where(here & F.col("key").isNotNull()).collect()]
        patterns.sort(key=lambda p: p[0])
        passes.append(rows.mapInArrow(_search(uuid.uuid4().hex, spark.sparkContext.broadcast(patterns), not block), _STATE))
    if blocks == 1 and not sums["shared"]:
        return passes[0].select(F.col("id").alias("doc_id"), "n_words", "spans", "items")
    # rows with one id and text have the same hits in every block
    others = [p.select("id", "h", "n", "spans", "items") for p in passes[1:]]
    if sums["shared"]:
        passes = [materialize(p, "benchmark-hits") for p in passes]
        hit = functools.reduce(DataFrame.unionAll, passes).select("id", "h", "n", F.explode("shared").alias("key")).distinct()
        known = names.where("key IS NOT NULL").select("window", "key").join(windows, "window").select("key", F.array("item").alias("items"))
        none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("end"))), 1, 0)
        others = [p.select("id", "h", "n", "spans", "items") for p in passes[1:]] + [hit.join(known, "key").select("id", "h", "n", none.alias("spans"), "items")]
    more = functools.reduce(DataFrame.unionAll, others).select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("spans").alias("s2"), F.col("items").alias("i2"))
    more = more.groupBy("id2", "h2", "n2").agg(F.flatten(F.collect_set("s2")).alias("s2"), F.flatten(F.collect_set("i2")).alias("i2"))
    same = F.col("id").eqNullSafe(F.col("id2")) & F.col("h").eqNullSafe(F.col("h2")) & F.col("n").eqNullSafe(F.col("n2"))
    both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b)).alias(a)
    joined = passes[0].join(more, same, "left").select("id", "n_words", both("spans", "s2"), both("items", "i2"))
    return joined.mapInArrow(_merged, "doc_id long, n_words long, spans array<struct<first: long, end: long>>, items array<string>")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``find_contamination``; the item without an id goes by the name ``null``."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("items", F.array_sort(F.transform("items", lambda x: F.coalesce(x, F.lit("null")))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT DISTINCT doc_id, i, m, item FROM t JOIN p USING (m, s)),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(k.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
