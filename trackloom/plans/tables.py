"""Table access and the stand-ins that queries build from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, score``: quality as +1/-1 against the length of the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), (2 * F.col("quality") - 1).alias("label"), F.col("n_chars").cast("double").alias("score"))


SCORES_SQL = "s AS (SELECT l.doc_id AS id, 2 * quality - 1 AS label, n_chars::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, v``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


VECTORS_SQL = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a small dense image: y = hour, x = day of the month, v = summed value in cents."""
    ev = table(spark, sf_dir, "events")
    sums = ev.groupBy(F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return dense(spark).join(sums, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def dense(spark: SparkSession) -> DataFrame:
    """All hours and days."""
    return spark.range(24 * 31).select((F.col("id") / 31).cast("int").alias("y"), (F.col("id") % 31 + 1).cast("int").alias("x"))


DENSE_SQL = "z AS (SELECT (i // 31)::INT AS y, (i % 31 + 1)::INT AS x FROM range(744) r(i))"
GRID_SQL = f"{DENSE_SQL}, g AS (SELECT z.y, z.x, coalesce(sum(round(value * 100)::BIGINT), 0)::BIGINT AS v FROM z LEFT JOIN events ON hour(ts) = z.y AND day(ts) = z.x GROUP BY 1, 2)"


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_id, frame, x, y``: a user as a trajectory, the hours since the start as frames (from 1)."""
    ev = table(spark, sf_dir, "events")
    frame = F.expr("cast(floor((unix_micros(cast(ts as timestamp)) - 1704067200000000L) / 3600000000L) as int) + 1")
    cents = F.round(F.col("value") * 100).cast("long")
    return ev.withColumn("frame", frame).groupBy(F.col("user_id").alias("track_id"), "frame").agg(F.max(cents).alias("x"), F.count("*").alias("y"))


TRACKS_SQL = "t AS (SELECT user_id AS track_id, floor((epoch_us(ts) - 1704067200000000) / 3600000000)::INT + 1 AS frame, max(round(value * 100)::BIGINT) AS x, count(*) AS y FROM events GROUP BY 1, 2)"
