"""Queries of features, served assets, totals, live baskets, sources and random ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions import text as X
from itembank.functions.dictionaries import type_label
from itembank.operators import inventory as I
from itembank.operators import library as L
from itembank.operators import recommend as R
from itembank.operators import workbook as W
from itembank.plans.library import SCORED, _candidates
from itembank.plans.registry import query
from itembank.sources import tables as T

PICTURED = """pictured AS (SELECT id, subject, is_deleted, source_id, question_type, length(content) AS n, content || CASE id % 5 WHEN 1 THEN ' ![图](asset://figures/figures/a.png)' WHEN 2 THEN ' asset://figures/a.png asset://questions/b.webp' WHEN 3 THEN ' /api/practices/p/c.png asset:// $x$' ELSE '' END AS content,
  CASE id % 3 WHEN 0 THEN 'see asset://figures/o.png' WHEN 1 THEN 'none' END AS option FROM questions)"""


def _pictured(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose content and options refer to pictures; a third has no options."""
    i = F.col("id")
    more = F.when(i % 5 == 1, " ![图](asset://figures/figures/a.png)").when(i % 5 == 2, " asset://figures/a.png asset://questions/b.webp").when(i % 5 == 3, " /api/practices/p/c.png asset:// $x$").otherwise("")
    option = lambda text: F.array(F.struct(F.lit("A").alias("label"), F.lit(text).alias("content")), F.struct(F.lit("B").alias("label"), F.lit(None).cast("string").alias("content")))
    return T.questions(spark, d).withColumn("content", F.concat("content", more)).withColumn("options", F.when(i % 3 == 0, option("see asset://figures/o.png")).when(i % 3 == 1, option("none")))


HAS_FORMULA = r"""(regexp_matches(content, '\$\$([^$]+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)') OR regexp_matches(content, '(^|[^\d$])\$[^$\n]+\$($|[^$])'))"""
PICTURES = r"""len(regexp_extract_all(content, 'asset://[^\s)"]+|/api/practices/[^\s)"]+'))"""


@query("practice_features", f""", {PICTURED}
SELECT id // 10 AS practice, count(*) AS questions, count(*) FILTER ({HAS_FORMULA}) AS formula_questions, count(*) FILTER ({PICTURES} > 0) AS image_questions, count(*) FILTER (id % 3 = 0) AS option_image_questions,
  sum(CASE WHEN id % 4 = 0 THEN 2 WHEN id % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS answer_space_blocks, sum(length(content))::BIGINT AS total_chars FROM pictured GROUP BY 1""", bank=True)
def practice_features(spark: SparkSession, d: str) -> DataFrame:
    """Ten questions a practice; some have one or two blocks of answer lines."""
    q = _pictured(spark, d).select(F.floor(F.col("id") / 10).alias("practice"), F.col("id").alias("question"), "content", "options")
    kinds = F.when(F.col("question") % 4 == 0, F.array(F.lit("answer_space"), F.lit("text"), F.lit("answer_space"))).when(F.col("question") % 4 == 1, F.array(F.lit("answer_space"))).otherwise(F.array(F.lit("text")))
    return I.practice_features(q, q.select("question", F.explode(kinds).alias("type")), "practice")


@query("candidate_ids", f""", {PICTURED},
b AS (SELECT subject, id, length(content) AS n, unnest(list_filter([CASE WHEN {HAS_FORMULA} THEN 'formula' END, CASE WHEN id % 3 = 0 THEN 'option_img' END, CASE WHEN length(content) >= 300 THEN 'long_text' END, CASE WHEN {PICTURES} >= 2 THEN 'multi_img' WHEN {PICTURES} = 1 THEN 'single_img' END], lambda x: x IS NOT NULL)) AS bucket FROM pictured WHERE NOT is_deleted)
SELECT subject, bucket, id, n FROM b""", bank=True)
def candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    q = L.live(_pictured(spark, d)).withColumn("n", F.length("content")).withColumn("pictures", X.picture_count(F.col("content")))
    rules = [("formula", X.has_formula(F.col("content"))), ("option_img", X.options_have_picture(F.col("options"))), ("long_text", F.col("n") >= 300)]
    return I.bucket_members(q, "subject", rules, [("multi_img", F.col("pictures") >= 2), ("single_img", F.col("pictures") == 1)], ["id", "n"])


@query("served_questions", f""", {PICTURED},
s AS (SELECT *, '/api/ocr-assets/' || source_id || '/' AS base FROM pictured)
SELECT id, md5(regexp_replace(replace(content, 'asset://figures/figures/', 'asset://figures/'), 'asset://([^\\s)])', base || '\\1', 'g')) AS content_md5, CASE id % 3 WHEN 0 THEN 'A=see ' || base || 'figures/o.png;B=' WHEN 1 THEN 'A=none;B=' END AS options,
  CASE id % 4 WHEN 0 THEN base || 'questions/Q001.webp' WHEN 1 THEN base || 'questions/Q2.webp' WHEN 2 THEN '/elsewhere/x.webp' ELSE 'ocr_output/d/r.webp' END AS card,
  CASE WHEN question_type IS NULL THEN '未知题型' WHEN question_type IN ('single_choice', '选择题') THEN '选择题' WHEN question_type = 'fill_blank' THEN '填空题' WHEN question_type = 'calculation' THEN '计算题' ELSE '论述题' END AS label FROM s""", bank=True)
def served_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions as they are read: addresses in contents, options and cards, and the type's label."""
    i, source = F.col("id"), F.col("source_id")
    card = F.when(i % 4 == 0, "D:\\data\\ocr_output\\doc\\questions\\Q001.webp").when(i % 4 == 1, "/srv/ocr_output/doc/questions/Q2.webp").when(i % 4 == 2, "/elsewhere/x.webp").otherwise("ocr_output/d/r.webp")
    q = _pictured(spark, d).select("id", F.md5(X.served_assets(F.col("content"), source)).alias("content_md5"), X.served_options(F.col("options"), source).alias("o"), X.served_card(card, source).alias("card"), type_label(F.col("question_type")).alias("label"))
    return q.select("id", "content_md5", F.array_join(F.transform("o", lambda o: F.concat(o["label"], F.lit("="), F.coalesce(o["content"], F.lit("")))), ";").alias("options"), "card", "label")


@query("library_search_raw", """
SELECT id, contains(lower(content), 'scan-7') AS in_content FROM questions WHERE NOT is_deleted AND (contains(lower(content), 'scan-7') OR coalesce(contains(lower(answer), 'scan-7'), false) OR coalesce(contains(lower(explanation), 'scan-7'), false) OR CASE WHEN id % 3 <> 0 THEN contains('scan-' || (id % 100), 'scan-7') ELSE false END)""", bank=True)
def library_search_raw(spark: SparkSession, d: str) -> DataFrame:
    """A search that only the first reading's text answers."""
    q = T.questions(spark, d).withColumn("raw_ocr_content", F.when(F.col("id") % 3 != 0, F.concat(F.lit("SCAN-"), (F.col("id") % 100).cast("string"))))
    return L.found(q, L.Filter(search="scan-7")).select("id", F.contains(F.lower("content"), F.lit("scan-7")).alias("in_content"))


@query("document_totals", """
SELECT count(*) AS total, count(*) FILTER (doc_id % 6 < 2) AS missing, count(*) FILTER (doc_id % 6 IN (2, 3)) AS bad, count(*) FILTER (doc_id % 6 > 3) AS valid FROM documents""")
def document_totals(spark: SparkSession, d: str) -> DataFrame:
    """Texts as documents; of six, two are missing, one is broken, one has a wrong version."""
    k = F.col("doc_id") % 6
    said = F.to_json(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))).alias("content")))
    doc = lambda version: F.concat(F.lit(f'{{"type": "doc", "schema_version": {version}, "content": ['), said, F.lit("]}"))
    text = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, F.concat(F.lit("{"), said)).when(k == 3, doc(2)).otherwise(doc(1))
    return I.document_totals(T.table(spark, d, "documents").select(text.alias("doc")), "doc")


LIVE_BASKET = """, basket AS (SELECT p_brand AS basket, p_partkey AS question, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part),
live AS (SELECT b.*, CASE WHEN question_type IS NULL THEN '未知题型' WHEN question_type IN ('single_choice', '选择题') THEN '选择题' WHEN question_type = 'fill_blank' THEN '填空题' WHEN question_type = 'calculation' THEN '计算题' ELSE '论述题' END AS label FROM basket b JOIN questions q ON q.id = b.question WHERE NOT q.is_deleted)"""


def _live_basket(spark: SparkSession, d: str) -> DataFrame:
    items = T.table(spark, d, "part").select(F.col("p_brand").alias("basket"), F.col("p_partkey").alias("question"))
    return L.basket_items(W.renumbered(items, "basket", "question", name="position", start=0), T.questions(spark, d))


@query("basket_live", f"{LIVE_BASKET} SELECT basket, position::INT AS position, question, label FROM live", bank=True)
def basket_live(spark: SparkSession, d: str) -> DataFrame:
    return _live_basket(spark, d)


@query("basket_live_stats", f"{LIVE_BASKET} SELECT basket, label, n, sum(n) OVER (PARTITION BY basket)::BIGINT AS total FROM (SELECT basket, label, count(*) AS n FROM live GROUP BY ALL)", bank=True)
def basket_live_stats(spark: SparkSession, d: str) -> DataFrame:
    counts = _live_basket(spark, d).groupBy("basket", "label").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("basket").agg(F.sum("n").alias("total")), "basket")


@query("question_sources", """
, s AS (SELECT p_brand AS source_id, min(p_name) AS filename, count(*) AS parts FROM part GROUP BY 1 UNION ALL SELECT source, source || '.docx', n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE n % 2 = 0)
SELECT id, s.filename, s.parts FROM questions q LEFT JOIN s ON s.source_id = q.source_id""", bank=True)
def question_sources(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the file of their source; sources with an odd number of questions are unknown."""
    parts = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("source_id")).agg(F.min("p_name").alias("filename"), F.count("*").alias("parts"))
    own = T.table(spark, d, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("parts")).where("parts % 2 = 0")
    sources = parts.unionByName(own.select("source_id", F.concat("source_id", F.lit(".docx")).alias("filename"), "parts"))
    return L.with_sources(T.questions(spark, d), sources, "filename", "parts").select("id", "filename", "parts")


@query("recommend_random_ties", f"""{SCORED}, ranked AS (SELECT id, difficulty, score, CASE WHEN difficulty IN (1, 2) THEN 'easy' ELSE 'hard' END AS band, md5('11/' || id) AS tie FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, tie) AS rank FROM ranked)
SELECT id, band, difficulty, score::DOUBLE AS score FROM placed ORDER BY rank <= 10 DESC, score DESC, tie LIMIT 20""", bank=True)
def recommend_random_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.quota(_candidates(spark, d), ("easy", "hard"), 10, seed=11).select("id", "band", "difficulty", "score")
