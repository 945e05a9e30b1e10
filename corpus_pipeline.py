"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``.  All stages but the last return the columns of
``docs``, whatever they are called, and keep whole rows.

Texts stay where they are: a stage learns which rows go from short rows of
keys, and these are broadcast where a count proves them few, else joined by
key.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bpe import bpe_round_trip, vocabulary_path
from trackloom.llm.common import if_small, materialize, table
from trackloom.llm.decontaminate import find_contamination
from trackloom.llm.exact_dedup import exact_dedup
from trackloom.llm.quality import keep_good
from trackloom.llm.simhash import similar_groups

#: A document goes if benchmark passages cover this many of its words, or this share of them.
MOST_HIT_WORDS, MOST_HIT_SHARE = 0, 0.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.  Of rows that share both id and text (but
    for the case of letters), that stays whose columns come first in order."""
    d, h = _free(docs, "__d"), _free(docs, "__h")
    nobody = F.lit(-(1 << 63))
    verdict = exact_dedup(docs, keep="largest").groupBy(F.coalesce("doc_id", nobody).alias(d), F.col("text_sha256").alias(h)).agg(F.max("kept").alias("any"), F.count("*").alias("n"))
    verdict = materialize(verdict.where("NOT any OR n > 1"), "pipeline-verdict")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hashed = docs.withColumn(h, F.sha2(F.translate(F.coalesce("text", F.lit("")), letters, letters.lower()), 256)).withColumn(d, F.coalesce("doc_id", nobody))
    once = hashed.join(if_small(verdict.select(d, h)), [d, h], "left_anti").select(*docs.columns)
    repeated = hashed.join(if_small(verdict.where("any").select(d, h)), [d, h], "left_semi")
    first = repeated.groupBy(d, h).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(first)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key of id and text, so that a verdict holds for a row: ids may be null or repeat."""
    k = _free(docs, "__k")
    return docs.withColumn(k, F.xxhash64(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))), k


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; rows without an id come last."""
    keyed, k = _keyed(docs)
    groups = materialize(similar_groups(keyed, id_col=k).select(F.col("doc_id").alias("k"), "component_id").distinct(), "near-groups")
    joined = materialize(groups.where("k != component_id").select("component_id").distinct().join(groups, "component_id"), "near-members")
    at = keyed.select(F.col(k).alias("k"), "doc_id").join(if_small(joined), "k").select("k", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "k").alias("at"))
    rows = materialize(at.distinct(), "near-rows")
    best = rows.groupBy("component_id").agg(F.min("at").alias("best"))
    dropped = materialize(rows.join(best, "component_id").where(F.col("at.k") != F.col("best.k")).select(F.col("k").alias(k)).distinct(), "near-dropped")
    return keyed.join(if_small(dropped), k, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark passage go, with or without an id; other rows of the same id stay."""
    keyed, k = _keyed(docs)
    found = find_contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=k)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    bad = materialize(found.where((hit > MOST_HIT_WORDS) & (hit > MOST_HIT_SHARE * F.col("n_words"))).select(F.col("doc_id").alias(k)).distinct(), "pipeline-hit")
    return keyed.join(if_small(bad), k, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of ids and of the decoded text."""
    return bpe_round_trip(docs, vocabulary_path(), digest=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("bpe", tokens)]

#: SQL cannot express a trained classifier; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
