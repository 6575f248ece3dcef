"""Table readers, and the bank's tables as views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stored question types that the view deals out by id; one is stored under its display label, one is missing.
TYPES = ["single_choice", "选择题", "fill_blank", "calculation", "essay", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question bank: one question a document, with null, blank and filled answers."""
    d = F.col("doc_id")
    kind = F.lit(None).cast("string")
    for i, name in enumerate(TYPES):
        kind = F.when(d % len(TYPES) == i, F.lit(name).cast("string")).otherwise(kind)
    answer = F.when(d % 7 == 0, F.lit(None).cast("string")).when(d % 7 == 1, "").when(d % 7 == 2, "  ").otherwise(F.substring("text", 1, 20))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        (d % 30 + 1).cast("int").alias("question_number"),
        F.col("text").alias("content"),
        F.col("lang").alias("subject"),
        F.col("source").alias("source_id"),
        F.concat("source", F.lit(".PDF")).alias("filename"),
        (F.col("n_chars") % 5 + 1).cast("int").alias("difficulty"),
        kind.alias("question_type"),
        answer.alias("answer"),
        F.when(d % 5 != 0, F.substring("text", 21, 30)).alias("explanation"),
        F.concat(F.lit("G"), (d % 3 + 7).cast("string")).alias("grade"),
        (d % 11 == 0).alias("is_deleted"),
        F.when(d % 4 != 0, (d % 10) / 2).alias("score"),
        F.when(d % 13 == 0, "pending").otherwise("approved").alias("review_status"),
    )


def question_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, tag_id: the labels that are set."""
    labels = table(spark, sf_dir, "labels")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return labels.select(F.col("doc_id").alias("question_id"), F.explode(tags).alias("tag_id"))


def used_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id: those in the basket or in a practice; ids may be missing."""
    basket = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("question_id"))
    practice = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") == 1, F.col("conv_id") * 5).alias("question_id"))
    return basket.unionByName(practice).distinct()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job log: one job an event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), "user_id", "value")
