"""Queries on ranking metrics, order, subsets and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import metrics as M
from trackloom.operators import sampling as S
from trackloom.plans.ordered import running_max
from trackloom.plans.tables import SCORES_SQL, labelled_scores, table


def tp_fp(spark, sf_dir):
    return M.tp_fp(labelled_scores(spark, sf_dir)).select("k", "id", "tp", "fp", "p", "n")


def precision_recall(spark, sf_dir):
    return M.precision_recall(labelled_scores(spark, sf_dir)).select("k", "id", F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"))


def pr_interpolated(spark, sf_dir):
    return M.precision_recall(labelled_scores(spark, sf_dir), interpolate=True).select("k", F.round("precision", 8).alias("precision"))


def pr_prior(spark, sf_dir):
    return M.precision_recall(labelled_scores(spark, sf_dir), prior=0.25).select("k", F.round("precision", 8).alias("precision"))


def pr_summary(spark, sf_dir):
    return M.pr_summary(labelled_scores(spark, sf_dir)).select(*(F.round(c, 8).alias(c) for c in ("auc", "ap", "ap_interp_11")))


def roc(spark, sf_dir):
    return M.roc(labelled_scores(spark, sf_dir)).select("k", "id", F.round("tpr", 8).alias("tpr"), F.round("tnr", 8).alias("tnr"))


def roc_summary(spark, sf_dir):
    return M.roc_summary(labelled_scores(spark, sf_dir)).select(*(F.round(c, 8).alias(c) for c in ("auc", "auc_tptn", "auc_fpfn", "eer")))


def det(spark, sf_dir):
    return M.det(labelled_scores(spark, sf_dir)).select("k", F.round("miss", 8).alias("miss"), F.round("false_alarm", 8).alias("false_alarm"))


def running_maximum(spark, sf_dir):
    return running_max(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("event_id")], F.col("value"), "m")


def _subset(mode, n, keys=None):
    def run(spark, sf_dir):
        return S.subset(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), n, mode, "c_custkey", keys)

    return run


def natural_order(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.natural_key(F.col("c_name")).alias("key"))


def cap_per_group(spark, sf_dir):
    return S.cap_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 3)


def top_up(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return S.top_up(ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), ["user_id"], 20, ["event_id"])


def unique_index(spark, sf_dir):
    return S.unique_index(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


def set_difference(spark, sf_dir):
    return S.set_difference(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


def members(spark, sf_dir):
    rare = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 60").select("user_id")
    return S.members(table(spark, sf_dir, "events").select("event_id", "user_id"), rare, ["user_id"])


def concatenated(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b)


def distinct_labelings(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return S.distinct_labelings(line, "l_orderkey", "l_linenumber", "l_returnflag").select(F.array_join("labels", ",").alias("labels"), "groups")


QUERIES = {
    "tp_fp": tp_fp, "precision_recall": precision_recall, "pr_interpolated": pr_interpolated, "pr_prior": pr_prior, "pr_summary": pr_summary, "roc": roc, "roc_summary": roc_summary, "det": det,
    "running_maximum": running_maximum, "subset_beginning": _subset("beginning", 0.1), "subset_ending": _subset("ending", 25), "subset_uniform": _subset("uniform", 37),
    "subset_largest": _subset("largest", 20, ["c_acctbal"]), "subset_smallest": _subset("smallest", 20, ["c_acctbal"]), "subset_random": _subset("random", 0.05),
    "natural_order": natural_order, "cap_per_group": cap_per_group, "top_up": top_up, "unique_index": unique_index, "set_difference": set_difference, "members": members,
    "concatenated": concatenated, "distinct_labelings": distinct_labelings,
}

_RANKED = f"""{SCORES_SQL}, z AS (SELECT count(*) FILTER (label > 0) AS p, count(*) FILTER (label < 0) AS n FROM s),
    r AS (SELECT row_number() OVER w AS k, id, label, sum((label > 0)::INT) OVER w AS tp, sum((label < 0)::INT) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC, id)
          UNION ALL SELECT 0, NULL, NULL, 0, 0),
    c AS (SELECT k, id, label, tp::BIGINT AS tp, fp::BIGINT AS fp, p, n, tp / greatest(p, 1e-10) AS recall, greatest(tp, 1e-10) / greatest(tp + fp, 1e-10) AS precision, 1 - fp / greatest(n, 1e-10) AS tnr FROM r, z)"""

ORACLE_SQL = {
    "tp_fp": f"WITH {_RANKED} SELECT k, id, tp, fp, p, n FROM c",
    "precision_recall": f"WITH {_RANKED} SELECT k, id, round(recall, 8) AS recall, round(precision, 8) AS precision FROM c",
    "pr_interpolated": f"WITH {_RANKED} SELECT k, round(max(precision) OVER (ORDER BY k DESC), 8) AS precision FROM c",
    "pr_prior": f"WITH {_RANKED} SELECT k, round(greatest(tp * 0.25 / p, 1e-10) / greatest(tp * 0.25 / p + fp * 0.75 / n, 1e-10), 8) AS precision FROM c",
    "pr_summary": f"""
        WITH {_RANKED}, l AS (SELECT *, lag(precision) OVER (ORDER BY k) AS p0, lag(recall) OVER (ORDER BY k) AS r0 FROM c)
        SELECT round(sum((precision + p0) / 2 * (recall - r0)), 8) AS auc, round(sum(precision) FILTER (recall > r0) / max(p), 8) AS ap,
               round((SELECT sum(m) / 11 FROM (SELECT coalesce(max(precision), 0) AS m FROM range(11) t(i) LEFT JOIN c ON recall >= i / 10 GROUP BY i)), 8) AS ap_interp_11 FROM l""",
    "roc": f"WITH {_RANKED} SELECT k, id, round(recall, 8) AS tpr, round(tnr, 8) AS tnr FROM c",
    "roc_summary": f"""
        WITH {_RANKED}, l AS (SELECT *, lag(tnr) OVER (ORDER BY k) AS n0, lag(recall) OVER (ORDER BY k) AS r0, lead(recall) OVER (ORDER BY k) AS r1 FROM c), s0 AS (SELECT max(k) AS s FROM c WHERE tnr > recall)
        SELECT round(sum(recall * (n0 - tnr)), 8) AS auc, round(sum(tnr * (recall - r0)), 8) AS auc_tptn, round(sum((1 - recall) * (n0 - tnr)), 8) AS auc_fpfn,
               round((SELECT CASE WHEN r1 IS NULL THEN 'nan'::DOUBLE WHEN r1 = recall THEN 1 - recall ELSE 1 - tnr END FROM l, s0 WHERE k = s), 8) AS eer FROM l""",
    "det": f"WITH {_RANKED} SELECT k, round(1 - recall, 8) AS miss, round(1 - tnr, 8) AS false_alarm FROM c",
    "running_maximum": "SELECT event_id, value, max(value) OVER (ORDER BY event_id) AS m FROM events",
    "subset_beginning": "SELECT c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <= round(0.1 * count(*) OVER ())",
    "subset_ending": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey DESC LIMIT 25",
    "subset_uniform": """
        WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS m FROM customer)
        SELECT c_custkey, c_acctbal FROM c WHERE r IN (SELECT floor(1 + i * (m - 1) / 36 + 0.5) FROM range(37) t(i))""",
    "subset_largest": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20",
    "subset_random": "SELECT c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (ORDER BY md5('0:' || c_custkey), c_custkey) <= round(0.05 * count(*) OVER ())",
    "subset_smallest": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20",
    "natural_order": "SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 20, '0') ELSE r END), '') AS key FROM customer",
    "cap_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3",
    "top_up": """
        WITH h AS (SELECT user_id, count(*) AS held FROM events WHERE event_type = 'purchase' GROUP BY 1),
        v AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'view')
        SELECT user_id, event_type, event_id FROM v LEFT JOIN h USING (user_id) WHERE coalesce(held, 0) < 14 AND r <= 20 - coalesce(held, 0)""",
    "unique_index": "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) AS idx FROM part",
    "set_difference": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "members": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 60)",
    "concatenated": "SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer",
    "distinct_labelings": """
        WITH s AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS seq FROM lineitem GROUP BY 1),
        n AS (SELECT l_orderkey, list_transform(seq, lambda x: list_position(list_filter(seq, lambda y, i: list_position(seq, y) = i), x)) AS labels FROM s)
        SELECT array_to_string(labels, ',') AS labels, count(*) AS groups FROM n GROUP BY 1""",
}
