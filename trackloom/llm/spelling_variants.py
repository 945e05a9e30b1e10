"""Spelling variant grouping by full neighbourhood generation.

Words are counted in Spark.  For every word of the vocabulary all distinct
deletions, replacements and insertions over the alphabet of the vocabulary are
generated, as polynomial hashes that follow from the word's prefix sums, so a candidate costs a few
operations whatever the word's length.  A bitmap of the vocabulary's hashes, of a fixed
size, thins them where they are made; it has no false negatives.  What is left is hash-joined to the
vocabulary by hash and length, and needs no distance; the equal hashes of unlike words are sorted out by one
comparison of the joined pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

RUNS = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the vocabulary's bitmap (16 MB), and of a part of it.
BITS, PART = 1 << 27, 1 << 18
#: Leaves of a hash the bits that number a bit of the map.
SHIFT = np.uint64(64 - 27)
#: Odd multipliers of the hashes.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Candidates looked up at once.
SLICE = 1 << 17


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUNS, damage: int = 199) -> DataFrame:
    """``word, n``: the lower-cased runs (A-Z only) of all texts, one code point less where ``damage``
    divides the crc32 of ``<id>:<run>``."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % damage == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Polynomial hashes of code points, modulo 2 to the 64, each code point mixed first.  Words of one
    length are hashed together, as rows of a matrix."""

    def __init__(self, longest: int):
        self.powers = np.ones(longest + 2, np.uint64)
        np.multiply.accumulate(np.full(longest + 1, BASE), out=self.powers[1:])
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed code points, and the sums before each place and after the last, which is the hash."""
        points = _mixed(words.astype(np.uint64) + np.uint64(1))
        sums = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        np.cumsum(points * self.powers[: words.shape[1]], axis=1, out=sums[:, 1:])
        return points, sums

    def neighbours(self, words: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, hashes, real)`` of all deletions, replacements and insertions, in slices whose first axis
        are the words; ``real`` marks one of each that are the same and none of the word itself."""
        points, sums = self.sums(words)
        n, letters = words.shape[1], _mixed(alphabet.astype(np.uint64) + np.uint64(1))
        whole = sums[:, n, None]
        # a run of one letter gives the same word whichever of it goes
        last = np.ones(words.shape, bool)
        last[:, :-1] = words[:, 1:] != words[:, :-1]
        if n > 1:
            yield n - 1, sums[:, :n] + (whole - sums[:, 1:]) * self.inverse, last
        step = max(1, SLICE // max(1, len(words) * len(alphabet)))
        for k in range(0, n, step):
            at = slice(k, min(k + step, n))
            fixed = whole - points[:, at] * self.powers[at]
            yield n, fixed[:, :, None] + letters * self.powers[at, None], words[:, at, None] != alphabet
        # before its like, a letter gives the same word as after it
        follows = np.concatenate([words.astype(np.int64), np.full((len(words), 1), -1)], 1)
        for k in range(0, n + 1, step):
            at = slice(k, min(k + step, n + 1))
            fixed = sums[:, at] + (whole - sums[:, at]) * BASE
            yield n + 1, fixed[:, :, None] + letters * self.powers[at, None], follows[:, at, None] != alphabet


def by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, matrix)`` of the words of each length, at most ``most`` code points at once where several."""
    held: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        held.setdefault(len(w), []).append(i)
    for n, places in held.items():
        step = max(1, most // max(1, n))
        for k in range(0, len(places), step):
            at = places[k : k + step]
            yield np.array(at), code_points("".join(words[i] for i in at)).reshape(len(at), n)


def code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(words: list[str]) -> np.ndarray:
    hasher, out = Hasher(max(map(len, words), default=0)), np.zeros(len(words), np.int64)
    for places, matrix in by_length(words, 1 << 18):
        out[places] = hasher.sums(matrix)[1][:, -1].view(np.int64)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.record_batch([*batch.columns, pa.array(hashes(words)), pa.array(list(map(len, words)), pa.int32())], names=["word", "n", "h", "length"])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.unique(np.concatenate([np.zeros(0, np.uint32), *(code_points(w) for w in batch.column(0).to_pylist())]))
        yield pa.record_batch({"c": pa.array(found.astype(np.int32))})


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's parts of the bitmap, as far as it has any of their bits."""
    seen = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        at = (batch.column(0).to_numpy().view(np.uint64) >> SHIFT).astype(np.int64)
        np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for p in range(BITS // PART):
        part = seen[p * PART // 8 : (p + 1) * PART // 8]
        if part.any():
            yield pa.record_batch({"part": pa.array([p], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})


def _joined(parts: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts.column("bits").to_pylist()])
    return pa.table({"part": parts.column("part").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of all ``h``: ``BITS`` of them, whatever the table."""
    parts = hashes.select("h").mapInArrow(_bits, "part int, bits binary").groupBy("part").applyInArrow(_joined, "part int, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _neighbourhood(alphabet: np.ndarray, seen):
    """``key, h, length``: the candidates of each word whose hash the vocabulary may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.value
        for batch in batches:
            keys, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            hasher = Hasher(max(map(len, words), default=0))
            for places, matrix in by_length(words, max(1, SLICE // max(1, len(alphabet)))):
                for n, h, real in hasher.neighbours(matrix, alphabet):
                    at = h >> SHIFT
                    found = (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    hit = np.nonzero(real & (found == 1))
                    if len(hit[0]):
                        yield pa.record_batch({"key": pa.array(keys[places[hit[0]]]), "h": pa.array(h[hit].view(np.int64)), "length": pa.array(np.full(len(hit[0]), n, np.int32))})

    return run


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for every ordered pair of words of ``word, n`` that differ by one
    inserted, deleted or replaced code point."""
    spark = vocabulary.sparkSession
    words = materialize(vocabulary.select("word", "n").mapInArrow(_hashed, "word string, n long, h long, length int").withColumn("key", F.monotonically_increasing_id()), "vocabulary")
    letters = words.select("word").mapInArrow(_letters, "c int").distinct().collect()
    alphabet = np.array(sorted(r["c"] for r in letters), np.uint32)
    seen = spark.sparkContext.broadcast(bitmap(words))
    found = words.select("key", "word").mapInArrow(_neighbourhood(alphabet, seen), "key long, h long, length int")
    pairs = found.join(words.select("h", "length", F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n")), ["h", "length"])
    pairs = pairs.join(words.select("key", "word", "n"), "key")
    # equal hashes of unlike words: next to none
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` by pointer doubling over ``word, form`` (null at an end); ``form`` leads to no circle."""
    at = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(onward, "root").select("word", F.col("root").alias("before"), F.col("next").alias("root")), "roots")
        at = moved.select("word", "root")
        if moved.where(F.col("before") != F.col("root")).isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5, ratio: int = 5, pattern: str = RUNS, damage: int = 199) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of at least ``least_length`` code points that
    occurs ``least_n`` times: how many words are near it, the most frequent of them (ties: the
    first in code-point order) if it occurs ``ratio`` times as often, and the end of the chain of forms.

    ``pattern`` is a class of letters, repeated; ``damage`` as in :func:`counted_words`.

    Defined cases: null and empty texts have no words; texts and words may be of any length;
    repeated rows count again; a null id counts as empty in the damage; a table without
    frequent words gives no rows; other columns are ignored, whatever their names.
    """
    counts = counted_words(docs, id_col, text_col, pattern, damage).where((F.length("word") >= least_length) & (F.col("n") >= least_n))
    words = materialize(counts, "counts")
    pairs = near_words(words)
    # the most frequent first, then the first in code-point order, which is that of UTF-8
    best = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    led = best.select("word", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"), F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    told = materialize(words.join(led, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n"), "forms")
    return told.join(roots_of(told), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
