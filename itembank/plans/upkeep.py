"""Queries of lists by status, tags, choices, layouts of practices, and of changes that count or create rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.operators import dml as D
from itembank.operators import inventory as I
from itembank.operators import library as L
from itembank.operators import workbook as W
from itembank.plans.library import _region_tags
from itembank.plans.registry import query
from itembank.sources import tables as T


@query("jobs_by_status", "SELECT event_id AS id, event_type AS status FROM events WHERE event_type IN ('signup', 'error')")
def jobs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return L.only(T.jobs(spark, d), status=["signup", "error"]).select("id", "status")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """id, status, files: a source is done if all its texts have words, else pending."""
    docs = T.table(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("files"), F.min(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("least"))
    return docs.withColumn("status", F.when(F.col("least") > 10, "done").otherwise("pending"))


@query("sources_by_status", "SELECT source AS id, count(*) AS files FROM documents GROUP BY 1 HAVING min(length(trim(coalesce(text, '')))) > 10")
def sources_by_status(spark: SparkSession, d: str) -> DataFrame:
    return L.only(_sources(spark, d), status="done").select("id", "files")


@query("tags_filtered", "SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def tags_filtered(spark: SparkSession, d: str) -> DataFrame:
    tags = _region_tags(spark, d).withColumn("category", F.when(F.col("id").startswith("r"), "chapter").otherwise("topic"))
    tags = tags.withColumn("subject", F.when(F.substring("id", 2, 9).cast("int") % 2 == 0, "physics").otherwise("math"))
    return L.only(tags, category="topic", subject="physics").orderBy("subject", "category", "name").select("id", "name")


@query("basket_by_label", "SELECT id, question_type FROM questions WHERE NOT is_deleted AND question_type IN ('calculation', 'essay')", bank=True)
def basket_by_label(spark: SparkSession, d: str) -> DataFrame:
    return L.found(T.questions(spark, d), L.Filter(question_types=("计算题", "论述题"))).select("id", "question_type")


@query("earliest_practice", "SELECT o_orderkey AS practice, o_orderstatus AS status FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def earliest_practice(spark: SparkSession, d: str) -> DataFrame:
    orders = T.table(spark, d, "orders").select("o_orderdate", F.col("o_orderkey").alias("practice"), F.col("o_orderstatus").alias("status"))
    return orders.orderBy("o_orderdate", "practice").limit(1).select("practice", "status")


@query("basket_or_new", "SELECT o_orderkey::VARCHAR AS name, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 1")
def basket_or_new(spark: SparkSession, d: str) -> DataFrame:
    """The first finished practice is the basket; one is made where there is none."""
    practices = T.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    default = spark.range(1).select(F.lit("basket").alias("name"), F.lit("draft").alias("status"), F.lit(None).cast(practices.schema["o_orderdate"].dataType).alias("o_orderdate"))
    return D.get_or_create(practices.where("status = 'F'"), default, "o_orderdate", "name").select("name", "status")


@query("random_picks", "SELECT id, subject FROM questions WHERE NOT is_deleted ORDER BY md5('7/' || id), id LIMIT 25", bank=True)
def random_picks(spark: SparkSession, d: str) -> DataFrame:
    return L.shuffled(L.live(T.questions(spark, d)), 7).limit(25).select("id", "subject")


@query("repeated_labels", "SELECT conv_id, len(list(role)) <> len(list(DISTINCT role)) AS repeats FROM conversations GROUP BY 1")
def repeated_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("labels")).select("conv_id", I.has_repeats(F.col("labels")).alias("repeats"))


@query("subject_choices", """
SELECT array_to_string(list_concat(['physics', 'en'], list(DISTINCT subject ORDER BY subject) FILTER (WHERE trim(subject) <> '' AND subject NOT IN ('physics', 'en'))), ',') AS choices,
  array_to_string(list(DISTINCT subject ORDER BY subject) FILTER (WHERE trim(subject) <> '' AND subject NOT IN ('physics', 'en')), ',') AS added FROM questions""", bank=True)
def subject_choices(spark: SparkSession, d: str) -> DataFrame:
    return L.choices(["physics", "en"], T.questions(spark, d), "subject").select(F.array_join("choices", ",").alias("choices"), F.array_join("added", ",").alias("added"))


@query("layout_numbered", """
WITH b AS (SELECT conv_id AS practice, turn AS position, CASE WHEN role = 'user' THEN 'question_ref' WHEN role = 'system' THEN 'subtitle' ELSE 'spacer' END AS type, CASE WHEN role = 'user' THEN turn END AS question FROM conversations),
s AS (SELECT conv_id AS practice, turn AS question, length(text)::INT AS score FROM conversations WHERE turn % 3 <> 0),
j AS (SELECT b.*, s.score FROM b LEFT JOIN s ON b.type = 'question_ref' AND s.practice = b.practice AND s.question = b.question WHERE b.type <> 'question_ref' OR s.question IS NOT NULL)
SELECT practice, position, type, score, CASE WHEN type = 'question_ref' THEN sum((type = 'question_ref')::INT) OVER w END::INT AS number, CASE WHEN type = 'subtitle' THEN sum((type = 'subtitle')::INT) OVER w END::INT AS title_number
FROM j WINDOW w AS (PARTITION BY practice ORDER BY position)""")
def layout_numbered(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "question_ref").when(F.col("role") == "system", "subtitle").otherwise("spacer")
    blocks = rows.select(F.col("conv_id").alias("practice"), F.col("turn").alias("position"), kind.alias("type"), F.when(F.col("role") == "user", F.col("turn")).alias("question"))
    snaps = rows.where("turn % 3 != 0").select(F.col("conv_id").alias("practice"), F.col("turn").alias("question"), F.length("text").alias("score"))
    return W.numbered_blocks(blocks, snaps, "practice", "position", "type", "question").select("practice", "position", "type", "score", "number", "title_number")


@query("sections_of_all_types", """
WITH l AS (SELECT l_orderkey AS practice, l_linenumber AS position, ['选择题', '多选题', '填空题', '实验题', '计算题', '解答题', '简答题', '论述题', '综合题', '未知题型', '附加题'][(l_partkey % 11 + 1)::INT] AS label FROM lineitem),
r AS (SELECT *, l_rank FROM (SELECT *, list_position(['选择题', '多选题', '填空题', '实验题', '计算题', '解答题', '简答题', '论述题', '综合题', '未知题型', '附加题'], label) AS l_rank FROM l))
SELECT practice, position, label, (dense_rank() OVER (PARTITION BY practice ORDER BY l_rank) - 1)::INT AS section, row_number() OVER (PARTITION BY practice ORDER BY l_rank, position)::INT AS number FROM r""")
def sections_of_all_types(spark: SparkSession, d: str) -> DataFrame:
    names = ["选择题", "多选题", "填空题", "实验题", "计算题", "解答题", "简答题", "论述题", "综合题", "未知题型", "附加题"]
    label = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("l_partkey") % 11 + 1).cast("int"))
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("practice"), F.col("l_linenumber").alias("position"), label.alias("label"))
    return W.grouped_by_type(rows, "practice", "label", "position").select("practice", "position", "label", "section", "number")


@query("dml_bulk_delete", "SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'deleted' ELSE 'left' END AS what, count(*) AS n FROM events GROUP BY 1")
def dml_bulk_delete(spark: SparkSession, d: str) -> DataFrame:
    left, gone = D.deleted(T.jobs(spark, d), F.col("status").isin("error", "purchase"))
    return gone.select(F.lit("deleted").alias("what"), F.col("deleted").alias("n")).unionByName(left.agg(F.count("*").alias("n")).withColumn("what", F.lit("left")))


@query("dml_filled_suggestions", "SELECT id, coalesce(difficulty, 3) AS difficulty, coalesce(question_type, 'essay') AS question_type FROM (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN NULL ELSE difficulty END AS difficulty) FROM questions)", bank=True)
def dml_filled_suggestions(spark: SparkSession, d: str) -> DataFrame:
    q, links = T.questions(spark, d), T.question_tags(spark, d)
    q = q.withColumn("difficulty", F.when(F.col("id") % 4 != 0, F.col("difficulty")))
    suggested = q.select("id", F.lit(3).alias("difficulty"), F.lit("essay").alias("question_type"), F.array(F.lit("quality")).alias("tag_ids"), F.lit(0.9).alias("confidence"))
    return D.suggestions_accepted(q, links, suggested, links.select("tag_id").distinct())[0].select("id", "difficulty", "question_type")


@query("dml_new_columns", "SELECT id, subject, 1 AS schema_version, NULL::VARCHAR AS rich_document FROM questions", bank=True)
def dml_new_columns(spark: SparkSession, d: str) -> DataFrame:
    return D.evolved(T.questions(spark, d), {"schema_version": F.lit(1), "rich_document": F.lit(None).cast("string"), "subject": F.lit("never")}).select("id", "subject", "schema_version", "rich_document")


@query("rich_documents_present", "SELECT o_orderkey AS practice FROM orders WHERE o_orderkey % 3 <> 0")
def rich_documents_present(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("practice"), F.when(F.col("o_orderkey") % 3 != 0, "{}").alias("rich_document"))
    return rows.where(F.col("rich_document").isNotNull()).select("practice")
