"""Queries of the library and the recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions import text as X
from itembank.functions.dictionaries import type_label
from itembank.operators import library as L
from itembank.operators import recommend as R
from itembank.plans.registry import query
from itembank.sources import tables as T

FOUND = "NOT is_deleted AND subject = 'en' AND (contains(lower(content), 'tion') OR coalesce(contains(lower(answer), 'tion'), false) OR coalesce(contains(lower(explanation), 'tion'), false))"
SEARCH = L.Filter(subject="en", search="TION")


@query("library_page", f"SELECT id, question_number, difficulty FROM questions WHERE {FOUND} ORDER BY question_number, id LIMIT 20 OFFSET 20", bank=True)
def library_page(spark: SparkSession, d: str) -> DataFrame:
    return L.page(L.found(T.questions(spark, d), SEARCH), 2, 20, "question_number", "id").select("id", "question_number", "difficulty")


@query("library_total", f"SELECT count(*) AS total FROM questions WHERE {FOUND}", bank=True)
def library_total(spark: SparkSession, d: str) -> DataFrame:
    return L.total(L.found(T.questions(spark, d), SEARCH))


@query("library_tag_any", "SELECT id, subject FROM questions WHERE NOT is_deleted AND id IN (SELECT question_id FROM links WHERE tag_id IN ('toxic', 'quality'))", bank=True)
def library_tag_any(spark: SparkSession, d: str) -> DataFrame:
    return L.with_any_tag(L.live(T.questions(spark, d)), T.question_tags(spark, d), L.tag_ids("toxic, quality,")).select("id", "subject")


@query("library_untagged", "SELECT id, subject FROM questions q WHERE NOT is_deleted AND NOT EXISTS (SELECT 1 FROM links WHERE question_id = q.id)", bank=True)
def library_untagged(spark: SparkSession, d: str) -> DataFrame:
    return L.with_any_tag(L.live(T.questions(spark, d)), T.question_tags(spark, d), ["none"]).select("id", "subject")


@query("library_presence", """
SELECT subject, count(*) FILTER (WHERE answer IS NOT NULL AND trim(answer) <> '') AS with_answer,
  count(*) FILTER (WHERE answer IS NULL OR trim(answer) = '') AS without_answer,
  count(*) FILTER (WHERE explanation IS NOT NULL AND trim(explanation) <> '') AS with_explanation,
  count(*) FILTER (WHERE explanation IS NULL OR trim(explanation) = '') AS without_explanation
FROM questions WHERE NOT is_deleted GROUP BY subject""", bank=True)
def library_presence(spark: SparkSession, d: str) -> DataFrame:
    return L.presence(T.questions(spark, d))


@query("library_type_alias", "SELECT id, question_type, '选择题' AS label FROM questions WHERE NOT is_deleted AND question_type IN ('single_choice', '选择题')", bank=True)
def library_type_alias(spark: SparkSession, d: str) -> DataFrame:
    rows = L.found(T.questions(spark, d), L.Filter(question_types=("选择题",)))
    return rows.select("id", "question_type", type_label(F.col("question_type")).alias("label"))


@query("library_with_tags", """
SELECT q.id, q.filename, coalesce(t.tags, '') AS tags, coalesce(t.n, 0) AS n_tags
FROM questions q LEFT JOIN (SELECT question_id, string_agg(DISTINCT tag_id, ',' ORDER BY tag_id) AS tags, count(DISTINCT tag_id) AS n FROM links GROUP BY 1) t ON t.question_id = q.id
WHERE NOT q.is_deleted""", bank=True)
def library_with_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = L.with_tags(L.live(T.questions(spark, d)), T.question_tags(spark, d))
    return rows.select("id", "filename", F.array_join("tags", ",").alias("tags"), F.size("tags").cast("long").alias("n_tags"))


@query("questions_by_ids", """
SELECT id, subject, difficulty FROM questions JOIN (VALUES (0, 7), (1, 3), (2, 11), (3, 5), (4, 999999999)) v(position, want) ON id = want WHERE NOT is_deleted""", bank=True)
def questions_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return L.by_ids(T.questions(spark, d), [7, 3, 11, 5, 999_999_999]).select("id", "subject", "difficulty")


@query("distinct_subjects", "SELECT DISTINCT subject FROM questions WHERE subject IS NOT NULL AND trim(subject) <> ''", bank=True)
def distinct_subjects(spark: SparkSession, d: str) -> DataFrame:
    return L.subjects(T.questions(spark, d))


@query("latest_jobs", """
SELECT event_id AS id, event_type AS status, 'src' || (user_id % 20) AS source_id, s.n_questions
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) e
LEFT JOIN (SELECT source, count(*) AS n_questions FROM documents GROUP BY source) s ON s.source = 'src' || (user_id % 20)""")
def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    sources = T.questions(spark, d).groupBy("source_id").agg(F.count("*").alias("n_questions"))
    return L.latest(T.jobs(spark, d), sources).select("id", "status", "source_id", "n_questions")


TAGS, TYPES, WANT = ("quality", "toxic"), ("选择题", "essay"), L.Filter(subject="en", bands=("easy", "hard"))
SCORED = """
, scored AS (
  SELECT q.* EXCLUDE (score), h.hits, h.hit_tags,
    3.0::DOUBLE * h.hits + CASE WHEN question_type IN ('single_choice', '选择题', 'essay') THEN 2 ELSE 0 END
      + CASE WHEN coalesce(filename, '') <> '' THEN 0.5 ELSE 0 END + CASE WHEN coalesce(content, '') <> '' THEN 0.5 ELSE 0 END AS score
  FROM questions q
  JOIN (SELECT question_id, count(DISTINCT tag_id) AS hits, list(DISTINCT tag_id ORDER BY tag_id) AS hit_tags FROM links WHERE tag_id IN ('quality', 'toxic') GROUP BY 1) h ON h.question_id = q.id
  WHERE NOT is_deleted AND subject = 'en' AND difficulty IN (1, 2, 4, 5))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.scored(T.questions(spark, d), T.question_tags(spark, d), TAGS, TYPES, WANT)


@query("recommend_scored", f"{SCORED} SELECT id, hits, score::DOUBLE AS score FROM scored", bank=True)
def recommend_scored(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("id", "hits", "score")


@query("recommend_exclude_used", f"{SCORED} SELECT id, score::DOUBLE AS score FROM scored s WHERE NOT EXISTS (SELECT 1 FROM used WHERE question_id = s.id)", bank=True)
def recommend_exclude_used(spark: SparkSession, d: str) -> DataFrame:
    return R.without_used(_candidates(spark, d), T.used_questions(spark, d)).select("id", "score")


@query("recommend_band_quota", f"""{SCORED}, ranked AS (
  SELECT id, difficulty, score, CASE WHEN difficulty IN (1, 2) THEN 'easy' ELSE 'hard' END AS band
  FROM scored s WHERE NOT EXISTS (SELECT 1 FROM used WHERE question_id = s.id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, id) AS rank FROM ranked)
SELECT id, band, difficulty, score::DOUBLE AS score FROM placed ORDER BY rank <= 10 DESC, score DESC, id LIMIT 20""", bank=True)
def recommend_band_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = R.without_used(_candidates(spark, d), T.used_questions(spark, d))
    return R.quota(rows, ("easy", "hard", "easy"), 10).select("id", "band", "difficulty", "score")


@query("recommend_reason", f"""{SCORED}
SELECT id, '命中' || hits || '个考点：' || array_to_string(list_sort(list_transform(hit_tags, lambda t: lpad(length(t)::VARCHAR, 4, '0') || t)).list_transform(lambda t: t[5:]), '、')
  || ' · 难度：' || CASE difficulty WHEN 1 THEN '易' WHEN 2 THEN '较易' WHEN 4 THEN '较难' ELSE '难' END
  || ' · 来自《' || source_id || '》' AS reason
FROM scored""", bank=True)
def recommend_reason(spark: SparkSession, d: str) -> DataFrame:
    return R.reasons(_candidates(spark, d)).select("id", "reason")


@query("snippet", r"""
SELECT doc_id AS id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS preview FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(replace(replace(replace(text,
    '\(', ''), '\)', ''), '\[', ''), '\]', ''), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '**', ''), '__', ''), '~~', ''),
    '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g')) AS t FROM documents)""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return T.questions(spark, d).select("id", X.snippet(F.col("content")).alias("preview"))


@query("tag_tree", """
WITH tags AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, CASE WHEN n_nationkey % 6 = 5 THEN 'r99' ELSE 'r' || n_regionkey END FROM nation)
SELECT t.id, t.name, p.id IS NULL AS is_root, coalesce(c.children, '') AS children
FROM tags t LEFT JOIN tags p ON p.id = t.parent_id
LEFT JOIN (SELECT parent_id, string_agg(name, ',' ORDER BY name) AS children FROM tags GROUP BY 1) c ON c.parent_id = t.id""")
def tag_tree(spark: SparkSession, d: str) -> DataFrame:
    tags = _region_tags(spark, d)
    return L.tag_tree(tags).select("id", "name", "is_root", F.array_join("children", ",").alias("children"))


def _region_tags(spark: SparkSession, d: str) -> DataFrame:
    roots = T.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    parent = F.when(F.col("n_nationkey") % 6 == 5, "r99").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    leaves = T.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), parent.alias("parent_id"))
    return roots.unionByName(leaves).withColumn("subject", F.lit("physics"))


@query("tags_without_subtree", "SELECT 'r' || r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 OR n_nationkey % 6 = 5")
def tags_without_subtree(spark: SparkSession, d: str) -> DataFrame:
    from itembank.operators.dml import without_subtree

    return without_subtree(_region_tags(spark, d), "r1").select("id", "name")


@query("first_wins", """
SELECT user_id, event_type, event_id, duplicates FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id, event_type) - 1 AS duplicates FROM events) WHERE rn = 1""")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return L.first_of_each(T.table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "duplicates")


@query("mask_and_names", r"""
SELECT c_custkey AS id, CASE WHEN length(c_name) >= 8 THEN left(c_name, 4) || '****' || right(c_name, 4) END AS masked,
  CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN stem || '-' || sha256(path)[1:8] ELSE stem END AS output
FROM (SELECT *, 'seg/' || c_mktsegment || c_nationkey || '.pdf' AS path, c_mktsegment || c_nationkey AS stem FROM customer)""")
def mask_and_names(spark: SparkSession, d: str) -> DataFrame:
    from itembank.sources.files import output_names

    rows = T.table(spark, d, "customer").withColumn("path", F.concat(F.lit("seg/"), "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit(".pdf")))
    return output_names(rows).select(F.col("c_custkey").alias("id"), X.mask_key(F.col("c_name")).alias("masked"), "output")
