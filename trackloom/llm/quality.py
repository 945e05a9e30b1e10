"""Quality classifier: hierarchical empirical Bayes over documents and sites.

*Document evidence.*  Two logistic models, quality and toxicity, fitted in
numpy on a bounded sample of labelled rows (``max_labelled``).  Features are
the words, and beginnings of words shared by one or by several words of a text,
that separate the classes significantly in the sample, and binned measures of
form: case, symbols, digits, repetition, length.

*Site posteriors.*  Documents' probabilities are summed for each (host, path)
by grouped aggregation, over all documents.  A beta prior, its strength
estimated by the method of moments, shrinks a host towards the corpus and a
path towards its host, so sparse sites say little.

*Verdict.*  A document's log-odds move by how far its path's posterior lies
from the corpus mean.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

_KEEP = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "mark": b"!?",
    "symbol": b"#$%&*|<>{}[]=~^\\/@_+",
    "stop": b".,;:",
}
_OTHERS = {k: bytes(b for b in range(256) if b not in v) for k, v in _KEEP.items()}
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def measures(text: bytes) -> list[float]:
    """Form of a text, as ratios that do not depend on its length."""
    tokens = text.lower().split()
    n, k = max(1, len(text)), max(1, len(tokens))
    counts = {name: len(text.translate(None, drop)) for name, drop in _OTHERS.items()}
    lines = text.split(b"\n")
    variety = lambda x: math.log(max(1, len(set(x)))) / math.log(len(x)) if len(x) > 1 else 1.0
    return [
        counts["upper"] / max(1, counts["upper"] + counts["lower"]), counts["digit"] / n, counts["mark"] / n, counts["symbol"] / n, counts["stop"] / n,
        variety(tokens), variety(lines), variety(list(zip(tokens, tokens[1:], strict=False))), sum(map(len, tokens)) / k, text.count(b" ") / n, math.log2(k),
    ]


PREFIXES = (5, 6, 7, 8)
_BITS = 20
QUANTILES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998)


def lexical(words: set[bytes], gate: set[bytes] | None = None) -> set[bytes]:
    """Words, and their beginnings: ``p*`` if some longer word starts with p, ``p**`` if several do.

    With a ``gate`` only beginnings whose first bytes are in it are formed.
    """
    starts: Counter[bytes] = Counter()
    least = PREFIXES[0]
    for w in words:
        if len(w) > least and (gate is None or w[:least] in gate):
            starts.update([w[:n] for n in PREFIXES if len(w) > n])
    return words.union([p + b"*" for p in starts], [p + b"**" for p, n in starts.items() if n > 1])


@dataclass
class DocumentModel:
    """Two linear scores over words and binned measures; empty: no evidence."""

    words: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    bias: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self) -> None:
        self.gate = {w[: PREFIXES[0]] for w in self.words if w.endswith(b"*")}

    def score(self, text: str | None) -> tuple[float, float]:
        """Log-odds of high quality and of toxicity."""
        if not self.edges:
            return 0.0, 0.0
        raw = (text or "").encode()
        words = _WORD.findall(raw.lower())
        q, t = self.bias
        for x, edges, weights in zip(measures(raw), self.edges, self.bins, strict=True):
            w = weights[int(np.searchsorted(edges, x))]
            q, t = q + w[0], t + w[1]
        known = self.words
        for word in known.keys() & lexical(set(words), self.gate):
            w = known[word]
            q, t = q + w[0], t + w[1]
        return max(-30.0, min(30.0, q)), max(-30.0, min(30.0, t))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Newton steps for L2-penalised logistic regression; the last column is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_model(rows: list[tuple[str | None, int, int]], most_words: int = 300, z_least: float = 5.0) -> DocumentModel:
    """``rows``: (text, quality 0/1, toxic 0/1).  Without two classes there is no evidence."""
    if not rows:
        return DocumentModel()
    raw = [(t or "").encode() for t, _, _ in rows]
    targets = np.array([[q, t] for _, q, t in rows], np.float64)
    n, totals = len(rows), targets.sum(0)

    def z_scores(c: np.ndarray) -> np.ndarray:
        """How far each row's class counts (seen, of good, of toxic) are from chance."""
        rate = np.clip(totals / n, 1e-9, 1 - 1e-9)
        noise = c[:, :1] * rate * (1 - rate) * np.maximum(1e-9, 1 - c[:, :1] / (n + 1))
        return (c[:, 1:] - c[:, :1] * rate) / np.sqrt(noise + 1e-9)

    # first by hash, to find the few that can matter in little memory, then exactly
    form, buckets = [], np.zeros((1 << _BITS, 3))
    for r, y in zip(raw, targets, strict=True):
        words = _WORD.findall(r.lower())
        form.append(measures(r))
        at = [zlib.crc32(w) & ((1 << _BITS) - 1) for w in lexical(set(words))]
        buckets[at] += (1, y[0], y[1])
    form = np.array(form)
    likely = (buckets[:, 0] >= 8) & (np.abs(z_scores(buckets)) >= z_least - 1).any(axis=1)
    exact: dict[bytes, np.ndarray] = {}
    for r, y in zip(raw, targets, strict=True):
        for w in lexical(set(_WORD.findall(r.lower()))):
            if likely[zlib.crc32(w) & ((1 << _BITS) - 1)]:
                exact[w] = exact.get(w, 0) + np.array((1, y[0], y[1]))
    vocabulary = sorted(w for w, c in exact.items() if c[0] >= 8)
    z = z_scores(np.array([exact[w] for w in vocabulary]).reshape(-1, 3))
    chosen = [np.array(sorted(np.flatnonzero(np.abs(z[:, k]) >= z_least), key=lambda i: (-abs(z[i, k]), vocabulary[i]))[:most_words], int) for k in range(2)]
    column = [{vocabulary[i]: j for j, i in enumerate(chosen[k])} for k in range(2)]
    has = [np.zeros((n, len(chosen[k]))) for k in range(2)]
    for d, r in enumerate(raw):
        found = lexical(set(_WORD.findall(r.lower())))
        for k in range(2):
            for w in column[k].keys() & found:
                has[k][d, column[k][w]] = 1
    # bins by the quantiles of good documents, fine towards the ends: what lies far out is told from what is only rare
    good = form[targets[:, 0] > 0] if targets[:, 0].any() else form
    edges = [np.unique(np.quantile(good[:, j], QUANTILES)) for j in range(form.shape[1])]
    onehot = np.concatenate([np.eye(len(e) + 1)[np.searchsorted(e, form[:, j])] for j, e in enumerate(edges)], axis=1)
    words: dict[bytes, list[float]] = {}
    weights, bias = np.zeros((onehot.shape[1], 2)), [0.0, 0.0]
    for k in range(2):
        if len(np.unique(targets[:, k])) < 2:
            bias[k] = 30.0 if totals[k] else -30.0
            continue
        names = [vocabulary[i] for i in chosen[k]]
        x = np.concatenate([has[k], onehot, np.ones((n, 1))], axis=1)
        # words are strong evidence, form a weak one for toxicity
        penalty = np.concatenate([np.full(len(names), 0.3), np.full(onehot.shape[1], 2.0 if k == 0 else 20.0), [1e-3]])
        w = _logistic(x, targets[:, k], penalty)
        for name, v in zip(names, w, strict=False):
            words.setdefault(name, [0.0, 0.0])[k] = float(v)
        weights[:, k], bias[k] = w[len(names) : -1], float(w[-1])
    cuts = np.cumsum([len(e) + 1 for e in edges])[:-1]
    return DocumentModel({w: (v[0], v[1]) for w, v in words.items()}, edges, np.split(weights, cuts), (bias[0], bias[1]))


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 6000, max_characters: int = 100_000) -> DocumentModel:
    """Fit on the ``max_labelled`` labelled rows of least hash (null labels are left out).

    The ids chosen are at most ``max_labelled`` longs, so they are broadcast.
    A text of more than ``max_characters`` characters takes part with that many
    from a hashed place, so the driver gets at most ``max_labelled`` times
    ``max_characters`` characters, however often an id is repeated.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), "quality", "toxic").distinct().orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(max_labelled)
    text = F.coalesce(F.col(text_col), F.lit(""))
    somewhere = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - max_characters, F.lit(0)) + 1).cast("int") + 1
    rows = docs.select(F.col(id_col).alias("id"), F.substring(text, somewhere, F.lit(max_characters)).alias("text")).join(F.broadcast(chosen), "id")
    found = rows.select("text", "quality", "toxic").orderBy(F.xxhash64("id"), F.xxhash64("text"), "quality", "toxic").limit(max_labelled).collect()
    return fit_model(sorted(((r["text"], int(r["quality"]), int(r["toxic"])) for r in found)))


def document_scores(model_cast):
    @F.pandas_udf("quality double, toxic double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_cast.value
        for texts in batches:
            yield pd.DataFrame([model.score(t) for t in texts], columns=["quality", "toxic"])

    return score


def site_of(source: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL or site name; null and empty are one host."""
    bare = F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(bare, r"^([^/?#]*)", 1), F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, s: str, centre: str) -> float:
    """Beta strength from the spread of group rates around ``centre`` beyond sampling noise."""
    n, rate = F.col("n"), F.col(s) / F.col("n")
    r = groups.agg(F.sum(n * (rate - F.col(centre)) ** 2).alias("ss"), F.sum(F.col(centre) * (1 - F.col(centre))).alias("noise"), F.sum("n").alias("n"), F.sum(n * F.col(centre) * (1 - F.col(centre))).alias("v")).first()
    if not r["n"]:
        return 1e4
    between = max((r["ss"] - r["noise"]) / r["n"], 1e-9)
    return min(1e4, max(1.0, (r["v"] / r["n"]) / between - 1))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """``host, path, post_q, post_t`` from ``host, path, quality, toxic`` (log-odds), and the corpus means."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_sigmoid(F.col("quality"))).alias("q"), F.sum(_sigmoid(F.col("toxic"))).alias("t"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "q", "t")))
    whole = hosts.agg(*(F.sum(c).alias(c) for c in ("n", "q", "t"))).first()
    n = whole["n"] or 0
    means = tuple(((whole[c] or 0.0) + 0.5) / (n + 1) for c in ("q", "t"))
    out = {}
    for c, mean in zip(("q", "t"), means, strict=True):
        hosts = hosts.withColumn("mean", F.lit(mean))
        k = _strength(hosts, c, "mean")
        out[c] = hosts.select("host", ((F.col(c) + k * mean) / (F.col("n") + k)).alias(f"host_{c}"))
    nested = paths.join(out["q"], "host").join(out["t"], "host")
    for c in ("q", "t"):
        k = _strength(nested, c, f"host_{c}")
        nested = nested.withColumn(f"post_{c}", (F.col(c) + k * F.col(f"host_{c}")) / (F.col("n") + k))
    return nested.select("host", "path", "post_q", "post_t"), means


def verdict_name(columns: list[str]) -> str:
    """``__judged``, with as many underscores behind it as it takes to be none of the columns."""
    name, taken = "__judged", {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_labelled: int = 6000, max_characters: int = 100_000, broadcast_sites: int = 50_000, quality_least: float = 0.3, toxic_least: float = 0.15, passed: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``passed``) with a struct ``__judged`` (:func:`verdict_name`): document log-odds, site posteriors, final
    probabilities ``p_quality`` and ``p_toxic``, and ``keep``: quality at least
    ``quality_least`` (on held-out labels it costs hardly any good document) and
    toxicity below ``toxic_least`` (which costs as few).  The models are fitted
    on at most ``max_labelled`` labelled rows and ``max_characters`` characters
    of each, and have at most 300 words each (see ``fit_model``); every whole
    text is judged.

    Defined cases: a null text is judged as an empty one; null sources form
    one site; without labels (or with one class) documents carry no evidence
    of that kind and are kept; repeated rows count as often as they occur;
    texts may be of any length; an empty table gives an empty result; further
    columns pass through, whatever they are called.
    """
    verdict = verdict_name(passed or docs.columns)
    spark = docs.sparkSession
    model = fit_on_labels(docs, labels, id_col, text_col, max_labelled, max_characters)
    udf = document_scores(spark.sparkContext.broadcast(model))
    host, path = site_of(F.col(source_col))
    rows = materialize(docs.select(F.struct(*(passed or ["*"])).alias("__row"), udf(F.col(text_col)).alias("__s"), host.alias("__host"), path.alias("__path")), "quality-scored")
    sites, (mean_q, mean_t) = site_posteriors(rows.select(F.col("__host").alias("host"), F.col("__path").alias("path"), "__s.quality", "__s.toxic"))
    sites = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.struct("post_q", "post_t").alias("__site"))
    # a checked bound for the broadcast; more sites are joined by key
    few = sites.limit(broadcast_sites + 1).count() <= broadcast_sites
    joined = rows.join(F.broadcast(sites) if few else sites, ["__host", "__path"], "left")
    site = lambda c, mean: F.coalesce(_logit(F.col(f"__site.{c}")) - math.log(mean / (1 - mean)), F.lit(0.0))
    p_q, p_t = _sigmoid(F.col("__s.quality") + site("post_q", mean_q)), _sigmoid(F.col("__s.toxic") + site("post_t", mean_t))
    none = not model.edges
    judged = F.struct(
        F.col("__s.quality").alias("logit_quality"), F.col("__s.toxic").alias("logit_toxic"), F.col("__site.post_q").alias("site_quality"), F.col("__site.post_t").alias("site_toxic"),
        p_q.alias("p_quality"), p_t.alias("p_toxic"), (F.lit(True) if none else (p_q >= quality_least) & (p_t < toxic_least)).alias("keep"),
    )
    return joined.select("__row.*", judged.alias(verdict))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the classifier keeps, with their own columns only."""
    verdict = verdict_name(docs.columns)
    return judge(docs, labels, **options).where(F.col(verdict)["keep"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), passed=["doc_id"])
    return judged.select("doc_id", "__judged.site_quality", "__judged.site_toxic", "__judged.p_quality", "__judged.p_toxic", "__judged.keep")
