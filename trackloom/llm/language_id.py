"""Language ID: a byte convolutional network, trained and applied in numpy.

A text is cut into windows of fixed length.  Each window's bytes are embedded,
convolved with filters of several widths, max-pooled over the window and
classified by softmax; a document takes the mean of its windows' class
probabilities, weighted by their bytes.  All windows of a text count.

The network is fitted on the driver on a bounded sample of labelled rows
(about ``per_language`` of each label, ``max_rows`` in all, ``max_characters``
of each); its few thousand weights are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import table

UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Is any character of Unicode category L (which number signs such as ``½`` and ``Ⅷ`` are not)?"""
    return any(map(str.isalpha, text))


@dataclass
class ByteCNN:
    """Embedding, multi-width filters, max pooling, softmax."""

    labels: list[str]
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    dim: int = 8
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        rng = np.random.default_rng(7)
        wide, n = max(self.widths), self.filters * len(self.widths)
        kernel = rng.normal(0, (2 / (wide * self.dim)) ** 0.5, (n, wide * self.dim))
        self.weights = {"embed": rng.normal(0, 0.5, (self.dim, 256)), "kernel": kernel * self._mask(), "bias": np.zeros(n), "out": rng.normal(0, 0.3, (len(self.labels), n)), "out_bias": np.zeros(len(self.labels))}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _mask(self) -> np.ndarray:
        """A narrow filter has zeros beyond its width."""
        wide = max(self.widths)
        return np.concatenate([np.repeat((np.arange(wide) < w)[None, :], self.filters, 0) for w in self.widths]).repeat(self.dim, axis=1).astype(np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(width x dim, windows, positions) patches of embedded bytes."""
        wide = max(self.widths)
        planes = self.weights["embed"][:, x]
        n = x.shape[1] - wide + 1
        return np.concatenate([planes[:, :, k : k + n] for k in range(wide)])

    def _pool(self, x: np.ndarray):
        cols = self._columns(x)
        d, n, p = cols.shape
        conv = (self.weights["kernel"] @ cols.reshape(d, n * p)).reshape(-1, n, p)
        return conv, cols

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, labels) for (windows, window) bytes, in cache-sized blocks."""
        out = []
        for at in range(0, len(x), 64):
            conv, _ = self._pool(x[at : at + 64])
            pooled = np.maximum(conv.max(axis=2).T + self.weights["bias"], 0)
            out.append(pooled @ self.weights["out"].T + self.weights["out_bias"])
        z = np.concatenate(out)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, texts: list[bytes], y: list[int], steps: int = 700, batch: int = 64, rate: float = 0.01) -> ByteCNN:
        """Adam on the cross entropy of random windows, some of them short."""
        rng = np.random.default_rng(11)
        w, moments = self.weights, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        by_class = [[t for t, c in zip(texts, y, strict=True) if c == k and t] for k in range(len(self.labels))]
        wide, dim, mask = max(self.widths), self.dim, self._mask()
        for step in range(1, steps + 1):
            target = rng.integers(0, len(self.labels), batch)
            x = np.zeros((batch, self.window), np.uint8)
            for i, k in enumerate(target):
                if not by_class[k]:
                    continue
                t = by_class[k][rng.integers(len(by_class[k]))]
                n = self.window if rng.random() < 0.6 else int(rng.integers(8, self.window))
                at = int(rng.integers(0, max(1, len(t) - n + 1)))
                part = t[at : at + n]
                x[i, : len(part)] = np.frombuffer(part, np.uint8)
            conv, cols = self._pool(x)
            best = conv.argmax(axis=2)  # (filters, batch)
            raw = np.take_along_axis(conv, best[:, :, None], 2)[:, :, 0].T + w["bias"]
            pooled = np.maximum(raw, 0)
            z = pooled @ w["out"].T + w["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(batch), target] -= 1
            z /= batch
            d_raw = (z @ w["out"]) * (raw > 0)  # (batch, filters)
            patch = cols[:, np.arange(batch)[None, :], best]  # (wide*dim, filters, batch)
            grads = {"out": z.T @ pooled, "out_bias": z.sum(0), "bias": d_raw.sum(0), "kernel": np.einsum("bf,dfb->fd", d_raw, patch, optimize=True) * mask}
            d_patch = d_raw.T[:, :, None] * w["kernel"][:, None, :]  # (filters, batch, wide*dim)
            g_embed = np.zeros_like(w["embed"])
            for k in range(wide):
                seen = x[np.arange(batch)[None, :], best + k]
                for e in range(dim):
                    g_embed[e] += np.bincount(seen.ravel(), d_patch[:, :, k * dim + e].ravel(), 256)
            grads["embed"] = g_embed
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return self

    def classify(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(label, probability) of every whole text; empty texts are unknown."""
        size = self.window
        out: list[tuple[str, float]] = []
        sums, held, owners = np.zeros((len(texts), len(self.labels))), [], []

        def flush() -> None:
            if held:
                x = np.frombuffer(b"".join(held), np.uint8).reshape(-1, size)
                who, weight = np.concatenate([o for o, _ in owners]), np.concatenate([v for _, v in owners])
                np.add.at(sums, who, self.probabilities(x) * weight[:, None])
                held.clear()
                owners.clear()

        pending = 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), size << 12):  # at most 4096 windows of a text are held
                part = t[at : at + (size << 12)]
                n = -(-len(part) // size)
                held.append(part.ljust(n * size, b"\0"))
                weight = np.full(n, size, np.float64)
                weight[-1] = len(part) - (n - 1) * size
                owners.append((np.full(n, i), weight))
                pending += n
                if pending >= 4096:
                    flush()
                    pending = 0
        flush()
        for t, s in zip(texts, sums, strict=True):
            k = int(s.argmax())
            out.append((self.labels[k], float(min(1.0, s[k] / len(t)))) if t else (UNKNOWN, 0.0))
        return out


def labelled_sample(rows: DataFrame, per_language: int, max_rows: int, max_characters: int) -> list[tuple[str, bytes]]:
    """A bounded sample of ``lang, text`` from ``doc_id, text, lang``: about ``per_language``
    rows by hash of each label (fewer where the labels are so many that this
    would pass ``max_rows``), and of each row at most ``max_characters`` from a
    hashed place.  The cut for each label follows from its count, so the rows
    are found in the scan, without a shuffle."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not frequent:
        return []
    each = max(1, min(per_language, max_rows // len(frequent)))
    cuts = F.create_map(*(F.lit(x) for r in frequent for x in (r["lang"], min(1.0, each / r["count"]))))
    drawn = rows.withColumn("order", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).where(F.col("order") < F.element_at(cuts, F.col("lang")) * (1 << 30))
    somewhere = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - max_characters, F.lit(0)) + 1).cast("int") + 1
    # rows repeated under one id share a hash: the limit, in hash order, keeps them from adding up
    drawn = drawn.select("order", "lang", F.substring("text", somewhere, F.lit(max_characters)).cast("binary").alias("text"))
    found = drawn.orderBy("order", "lang", "text").limit(4 * each * len(frequent)).collect()
    return sorted((r["lang"], bytes(r["text"])) for r in found)


def _predict(model_cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_cast.value
        for batch in batches:
            texts = [(t.encode() if t and model.labels and has_letter(t) else b"") for t in batch.column(2).to_pylist()]
            found = model.classify(texts) if model.labels else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([a for a, _ in found], pa.string()), "score": pa.array([b for _, b in found], pa.float64())})

    return run


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, max_rows: int = 80_000, max_characters: int = 4096) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Rows whose ``crc32(id as text) mod 4`` is 2 are held out: the network
    learns from the others only, from their text and non-null label.  It fits
    on about ``per_language`` rows of each label, ``max_rows`` in all (labels
    beyond the ``max_rows`` most frequent are not learned), and on
    ``max_characters`` characters of each; predictions take whole texts.

    Defined cases: null texts and texts without a letter (Unicode category L)
    are ``und`` with score 0; texts may be of any length; a null id is not
    held out; without any label everything is ``und``; repeated rows and empty
    tables pass through; other columns are ignored, whatever their names, and
    no column but the text enters a prediction.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    sample = labelled_sample(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"), per_language, max_rows, max_characters)
    labels = sorted({lang for lang, _ in sample})
    model = ByteCNN(labels)
    if len(labels) > 1:
        model.fit([t for _, t in sample], [labels.index(lang) for lang, _ in sample])
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
