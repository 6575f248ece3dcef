"""Recommendation: candidates, score, a quota for each difficulty band, reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itembank.functions.dictionaries import BANDS, LEVELS, lookup, type_label
from itembank.functions.text import file_title, snippet
from itembank.operators.library import Filter, found


def scored(questions: DataFrame, links: DataFrame, tags: Sequence[str] = (), types: Sequence[str] = (), condition: Filter = Filter()) -> DataFrame:
    """Candidates with hits, hit_tags and score: 3 a tag, 2 for a wanted type, 0.5 each for a source and a content. With tags, only questions that have one."""
    hits = links.where(F.col("tag_id").isin(list(tags))).groupBy(F.col("question_id").alias("id")).agg(F.count_distinct("tag_id").alias("hits"), F.array_sort(F.collect_set("tag_id"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("hit_tags"))
    labels = [type_label(F.lit(t)) for t in types]
    wanted = type_label(F.col("question_type")).isin(*labels) & F.col("question_type").isNotNull() if types else F.lit(False)
    rows = found(questions, condition).join(hits, "id", "inner" if tags else "left")
    score = 3 * F.coalesce("hits", F.lit(0)) + F.when(wanted, 2.0).otherwise(0.0) + F.when(F.coalesce("filename", F.lit("")) != "", 0.5).otherwise(0.0) + F.when(F.coalesce("content", F.lit("")) != "", 0.5).otherwise(0.0)
    return rows.withColumn("score", score.cast("double"))


def without_used(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates that aren't in the basket or a practice; missing ids among the used ones exclude nothing."""
    return candidates.join(used.select(F.col("question_id").alias("id")), "id", "left_anti")


def quota(candidates: DataFrame, bands: Sequence[str], count: int, seed: int | None = None) -> DataFrame:
    """Twice count candidates: an equal part of each band by score, filled up with the best of the rest; score, then id, decides.

    With a seed, candidates of one score are in a random order that the seed fixes, instead of by id.

    One window ranks within bands, and one top-k takes those within their part first; nothing else is sorted.
    """
    want, names = max(1, count) * 2, list(dict.fromkeys(b for b in bands if b in BANDS))
    tie = [F.col("id")] if seed is None else [F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"))), F.col("id")]
    if len(names) < 2:
        return candidates.orderBy(F.desc("score"), *tie).limit(want)
    part = -(-want // len(names))
    band = F.lit(None).cast("string")
    for name in names:
        band = F.when(F.col("difficulty").isin(BANDS[name]), name).otherwise(band)
    ranked = candidates.withColumn("band", band).where("band IS NOT NULL")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("score"), *tie))).where(F.col("rank") <= want)
    return ranked.withColumn("within", F.col("rank") <= part).orderBy(F.desc("within"), F.desc("score"), *tie).limit(want)


def reasons(picked: DataFrame) -> DataFrame:
    """id, reason, preview: hit tags (the four shortest), difficulty and source, for people."""
    tags = F.when(F.size("hit_tags") > 0, F.concat(F.lit("命中"), F.size("hit_tags").cast("string"), F.lit("个考点："), F.array_join(F.slice("hit_tags", 1, 4), "、")))
    level = F.when(F.col("difficulty") > 0, F.concat(F.lit("难度："), lookup(F.col("difficulty"), LEVELS, F.col("difficulty").cast("string"))))
    source = F.when(F.col("filename") != "", F.concat(F.lit("来自《"), file_title(F.col("filename")), F.lit("》")))
    said = F.array_join(F.array_compact(F.array(tags, level, source)), " · ")
    return picked.select("id", F.when(said == "", "符合筛选条件").otherwise(said).alias("reason"), snippet(F.col("content")).alias("preview"))
