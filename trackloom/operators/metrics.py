"""Ranking metrics: true and false positive counts, precision-recall, ROC and DET curves.

Inputs are ``id, label, score``; label > 0 is positive, < 0 negative, 0
ignored.  Rows are ranked by falling score, ties by id; scores of minus
infinity are never retrieved but count in the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.ordered import running_max, running_sums

SMALL = 1e-10


def tp_fp(df: DataFrame, include_inf: bool = False, num_positives: int | None = None, num_negatives: int | None = None) -> DataFrame:
    """``k, id, label, score, tp, fp, p, n`` for ranks k from 0 (nothing retrieved) on."""
    pos, neg = F.when(F.col("label") > 0, 1).otherwise(0), F.when(F.col("label") < 0, 1).otherwise(0)
    totals = df.agg(F.coalesce(F.sum(pos), F.lit(0)).alias("p"), F.coalesce(F.sum(neg), F.lit(0)).alias("n"))
    totals = totals.select((F.lit(num_positives) if num_positives is not None else F.col("p")).cast("long").alias("p"), (F.lit(num_negatives) if num_negatives is not None else F.col("n")).cast("long").alias("n"))
    kept = df if include_inf else df.where(F.col("score") > float("-inf"))
    ranked = running_sums(kept.select("id", "label", "score"), [-F.col("score"), F.col("id")], {"tp": pos, "fp": neg}).withColumnRenamed("rank", "k")
    start = df.sparkSession.sql("SELECT 0L k, 0L tp, 0L fp")
    rows = ranked.select("k", "id", "label", "score", "tp", "fp").unionByName(start, allowMissingColumns=True)
    return rows.crossJoin(F.broadcast(totals))  # one row


def _rates(c: DataFrame) -> tuple[Column, Column]:
    return F.col("tp") / F.greatest(F.col("p"), F.lit(SMALL)), F.col("fp") / F.greatest(F.col("n"), F.lit(SMALL))


def _precision(tp: Column, fp: Column, prior: float | None) -> Column:
    if prior is None:
        return F.greatest(tp, F.lit(SMALL)) / F.greatest(tp + fp, F.lit(SMALL))
    good = tp * prior / F.greatest(F.col("p"), F.lit(SMALL))
    bad = fp * (1 - prior) / F.greatest(F.col("n"), F.lit(SMALL))
    return F.greatest(good, F.lit(SMALL)) / F.greatest(good + bad, F.lit(SMALL))


def precision_recall(df: DataFrame, prior: float | None = None, interpolate: bool = False, **counting) -> DataFrame:
    """``k, id, tp, fp, p, n, recall, precision``; ``prior`` normalises the classes to that
    share of positives, ``interpolate`` makes the precision non-increasing."""
    curve = tp_fp(df, **counting)
    curve = curve.withColumn("recall", _rates(curve)[0]).withColumn("precision", _precision(F.col("tp"), F.col("fp"), prior))
    if interpolate:
        curve = running_max(curve, [-F.col("k")], F.col("precision"), "precision")
    return curve.select("k", "id", "label", "tp", "fp", "p", "n", "recall", "precision")


def pr_summary(df: DataFrame, prior: float | None = None, **counting) -> DataFrame:
    """``auc, ap, ap_interp_11`` of the precision-recall curve, in one row.

    The rank before is known from a row's own counts and label, so the
    trapezoids need no lag.
    """
    curve = precision_recall(df, prior, **counting)
    hit = F.when(F.col("label") > 0, 1).otherwise(0)
    before_tp, before_fp = F.col("tp") - hit, F.col("fp") - F.when(F.col("label") < 0, 1).otherwise(0)
    before = _precision(before_tp, before_fp, prior)
    step = hit / F.greatest(F.col("p"), F.lit(SMALL))
    eleven = [F.coalesce(F.max(F.when(F.col("recall") >= t / 10, F.col("precision"))), F.lit(0.0)) / 11 for t in range(11)]
    return curve.agg(
        F.coalesce(F.sum(F.when(F.col("k") > 0, (F.col("precision") + before) / 2 * step)), F.lit(0.0)).alias("auc"),
        (F.coalesce(F.sum(F.when((F.col("k") > 0) & (hit == 1), F.col("precision"))), F.lit(0.0)) / F.max("p")).alias("ap"),
        sum(eleven[1:], eleven[0]).alias("ap_interp_11"),
    )


def roc(df: DataFrame, **counting) -> DataFrame:
    """``k, id, label, tp, fp, p, n, tpr, tnr``."""
    curve = tp_fp(df, **counting)
    tpr, fpr = _rates(curve)
    return curve.select("k", "id", "label", "tp", "fp", "p", "n", tpr.alias("tpr"), (1 - fpr).alias("tnr"))


def roc_summary(df: DataFrame, **counting) -> DataFrame:
    """``auc`` (area under TPR over FPR), ``auc_tptn``, ``auc_fpfn`` and ``eer`` in one row.

    The equal error rate is taken at the last rank whose TNR exceeds its TPR;
    NaN if that is the last rank of all.
    """
    curve = roc(df, **counting)
    down = F.when(F.col("label") < 0, 1).otherwise(0) / F.greatest(F.col("n"), F.lit(SMALL))
    up = F.when(F.col("label") > 0, 1).otherwise(0) / F.greatest(F.col("p"), F.lit(SMALL))
    zero = F.lit(0.0)
    sums = curve.agg(F.sum(F.when(F.col("k") > 0, F.col("tpr") * down).otherwise(zero)).alias("auc"), F.sum(F.when(F.col("k") > 0, F.col("tnr") * up).otherwise(zero)).alias("auc_tptn"), F.sum(F.when(F.col("k") > 0, (1 - F.col("tpr")) * down).otherwise(zero)).alias("auc_fpfn"), F.max("k").alias("last"), F.max(F.when(F.col("tnr") > F.col("tpr"), F.col("k"))).alias("s"))
    ahead = curve.select((F.col("k") - 1).alias("s"), F.col("tpr").alias("tpr_after"))
    at = sums.join(curve.select(F.col("k").alias("s"), "tpr", "tnr"), "s", "left").join(ahead, "s", "left")
    eer = F.when(F.col("s").isNull() | (F.col("s") == F.col("last")), F.lit(float("nan"))).when(F.col("tpr") == F.col("tpr_after"), 1 - F.col("tpr")).otherwise(1 - F.col("tnr"))
    return at.select("auc", "auc_tptn", "auc_fpfn", eer.alias("eer"))


def det(df: DataFrame, **counting) -> DataFrame:
    """``k, id, miss, false_alarm``."""
    return roc(df, **counting).select("k", "id", (1 - F.col("tpr")).alias("miss"), (1 - F.col("tnr")).alias("false_alarm"))
