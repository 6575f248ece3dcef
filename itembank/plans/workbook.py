"""Queries of baskets, practices, layouts and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions.dictionaries import lookup, type_label
from itembank.operators import inventory as I
from itembank.operators import workbook as W
from itembank.plans.registry import query
from itembank.sources import tables as T

#: Labels that the roles of a conversation stand for.
ROLES = {"system": "填空题", "user": "选择题", "assistant": "附加题"}


def _basket(spark: SparkSession, d: str) -> DataFrame:
    """basket, question, position: parts of a brand, from the smaller ones."""
    part = T.table(spark, d, "part").where(F.col("p_size") <= 25)
    return W.renumbered(part.select(F.col("p_brand").alias("basket"), F.col("p_partkey").alias("question"), "p_type"), "basket", "question", name="position", start=0)


BASKET = "basket AS (SELECT p_brand AS basket, p_partkey AS question, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part WHERE p_size <= 25)"


@query("basket_type_stats", f"WITH {BASKET} SELECT basket, p_type, count(*) AS n FROM basket GROUP BY ALL")
def basket_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return _basket(spark, d).groupBy("basket", "p_type").agg(F.count("*").alias("n"))


@query("basket_append", f"""WITH {BASKET}, new AS (SELECT p_brand AS basket, p_partkey AS question, p_partkey % 97 AS asked FROM part WHERE p_size > 15),
fresh AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM basket b WHERE b.basket = n.basket AND b.question = n.question))
SELECT f.basket, f.question, (row_number() OVER (PARTITION BY f.basket ORDER BY asked * 1000000 + f.question) + coalesce(l.last, -1))::INT AS position
FROM fresh f LEFT JOIN (SELECT basket, max(position) AS last FROM basket GROUP BY 1) l ON l.basket = f.basket""")
def basket_append(spark: SparkSession, d: str) -> DataFrame:
    new = T.table(spark, d, "part").where("p_size > 15").select(F.col("p_brand").alias("basket"), F.col("p_partkey").alias("question"), (F.col("p_partkey") % 97 * 1000000 + F.col("p_partkey")).alias("asked"))
    return W.next_positions(_basket(spark, d), new.unionByName(new), "basket", "question", "asked").select("basket", "question", F.col("position").cast("int").alias("position"))


@query("basket_reorder", f"""WITH {BASKET}, seen AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY position) AS k FROM basket WHERE question % 3 = 0),
turned AS (SELECT basket, question, row_number() OVER (PARTITION BY basket ORDER BY question DESC) AS k FROM seen)
SELECT b.basket, b.question, coalesce(s.position, b.position)::INT AS position FROM basket b
LEFT JOIN turned t ON t.question = b.question LEFT JOIN seen s ON s.basket = t.basket AND s.k = t.k""")
def basket_reorder(spark: SparkSession, d: str) -> DataFrame:
    rows = _basket(spark, d)
    wanted = rows.where("question % 3 = 0").select("question", (-F.col("question")).alias("new_position"))
    return W.subset_reordered(rows, wanted, "question", "basket").select("basket", "question", F.col("position").cast("int").alias("position"))


@query("practice_briefs", "SELECT o_orderkey AS practice, o_orderstatus AS status, coalesce(n, 0) AS n_children FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def practice_briefs(spark: SparkSession, d: str) -> DataFrame:
    headers = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("practice"), F.col("o_orderstatus").alias("status"))
    return W.briefs(headers, T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("practice")), "practice")


def _practice(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "conversations")
    return rows.select(F.col("conv_id").alias("practice"), F.col("turn").alias("position"), "role", lookup(F.col("role"), ROLES).alias("label"), F.length("text").alias("n"))


PRACTICE = "practice AS (SELECT conv_id AS practice, turn AS position, role, CASE role WHEN 'system' THEN '填空题' WHEN 'user' THEN '选择题' ELSE '附加题' END AS label FROM conversations)"


@query("practice_group_number", f"""WITH {PRACTICE}, r AS (SELECT *, CASE label WHEN '选择题' THEN 1 WHEN '填空题' THEN 3 ELSE 11 END AS rank FROM practice)
SELECT practice, position, label, (dense_rank() OVER (PARTITION BY practice ORDER BY rank) - 1)::INT AS section,
  row_number() OVER (PARTITION BY practice ORDER BY rank, position)::INT AS number FROM r""")
def practice_group_number(spark: SparkSession, d: str) -> DataFrame:
    return W.grouped_by_type(_practice(spark, d), "practice", "label", "position").select("practice", "position", "label", "section", "number")


@query("practice_regroup_plan", f"""WITH {PRACTICE}, r AS (SELECT *, CASE label WHEN '选择题' THEN 1 WHEN '填空题' THEN 3 ELSE 11 END AS rank FROM practice),
n AS (SELECT practice, position, row_number() OVER (PARTITION BY practice ORDER BY position)::INT AS old_number, row_number() OVER (PARTITION BY practice ORDER BY rank, position)::INT AS number FROM r)
SELECT * FROM n WHERE old_number <> number""")
def practice_regroup_plan(spark: SparkSession, d: str) -> DataFrame:
    return W.regroup_plan(_practice(spark, d), "practice", "label", "position").select("practice", "position", "old_number", "number")


@query("practice_move_densify", f"""WITH {PRACTICE}, s AS (SELECT *, CASE WHEN position = 0 THEN 1 ELSE (position // 3)::INT END AS section, position = 0 AS moved FROM practice),
a AS (SELECT practice, section, position AS old_position, row_number() OVER (PARTITION BY practice, section ORDER BY moved, position) - 1 AS position FROM s)
SELECT practice, section, old_position, position::INT AS position, row_number() OVER (PARTITION BY practice ORDER BY section, position)::INT AS number FROM a""")
def practice_move_densify(spark: SparkSession, d: str) -> DataFrame:
    rows = _practice(spark, d).withColumn("section", F.floor(F.col("position") / 3).cast("int")).withColumn("old_position", F.col("position"))
    return W.moved(rows, "practice", "section", "position", F.col("position") == 0, F.lit(1)).select("practice", "section", "old_position", "position", "number")


@query("layout_segments", f"""WITH {PRACTICE}, o AS (SELECT practice, position, role = 'user' AS opens FROM practice)
SELECT practice, position, sum(opens::INT) OVER w AS segment,
  CASE WHEN NOT opens THEN sum((NOT opens)::INT) OVER w END AS question_number,
  CASE WHEN opens THEN CASE WHEN sum(opens::INT) OVER w <= 12 THEN ['一','二','三','四','五','六','七','八','九','十','十一','十二'][(sum(opens::INT) OVER w)::INT] ELSE (sum(opens::INT) OVER w)::VARCHAR END END AS segment_label
FROM o WINDOW w AS (PARTITION BY practice ORDER BY position)""")
def layout_segments(spark: SparkSession, d: str) -> DataFrame:
    return W.segments(_practice(spark, d), "practice", "position", F.col("role") == "user").select("practice", "position", "segment", "question_number", "segment_label")


@query("layout_drop_empty", f"""WITH {PRACTICE}, o AS (SELECT *, role = 'user' AS title, lead(role = 'user', 1, true) OVER (PARTITION BY practice ORDER BY position) AS before_title FROM practice)
SELECT practice, position, role FROM o WHERE NOT (title AND before_title)""")
def layout_drop_empty(spark: SparkSession, d: str) -> DataFrame:
    return W.without_empty_titles(_practice(spark, d), "practice", "position", F.col("role") == "user").select("practice", "position", "role")


@query("layout_build", f"""WITH {PRACTICE}, b AS (
  SELECT DISTINCT practice, label AS section, 0 AS kind, -1 AS position, 'subtitle' AS type, label AS ref FROM practice
  UNION ALL SELECT practice, label, 1, position, 'question_ref', position::VARCHAR FROM practice)
SELECT practice, (row_number() OVER (PARTITION BY practice ORDER BY section, kind, position, ref) - 1)::INT AS block, type, ref FROM b""")
def layout_build(spark: SparkSession, d: str) -> DataFrame:
    rows = _practice(spark, d)
    sections = rows.select("practice", F.col("label").alias("section"), F.col("label").alias("title")).distinct()
    items = rows.select("practice", F.col("label").alias("section"), "position", F.col("position").alias("question"))
    return W.layout(sections, items).select("practice", "block", "type", "ref")


@query("layout_validate", """
SELECT conv_id AS practice, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position,
  CASE role WHEN 'user' THEN 'subtitle' ELSE 'spacer' END AS type, CASE role WHEN 'user' THEN 't' || turn ELSE '' END AS title,
  true AS show_title, CASE WHEN role <> 'user' THEN CASE WHEN turn % 2 = 0 THEN 20 ELSE turn::INT END END AS height
FROM conversations WHERE role <> 'system'""")
def layout_validate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "subtitle").when(F.col("role") == "assistant", "spacer").otherwise("unknown")
    block = F.struct(F.col("turn"), kind.alias("type"), F.when(F.col("role") == "user", F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("title"), F.lit(None).cast("boolean").alias("show_title"), F.when(F.col("turn") % 2 == 1, F.col("turn").cast("int")).alias("height"))
    raw = T.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("practice")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return W.valid_blocks(raw)


@query("run_islands", """
WITH n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY ALL""")
def run_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    out = W.islands(rows, "user_id", "event_type", "at")
    return out.select("user_id", "run", "event_type", "n", F.col("first_at.event_id").alias("first_id"), F.col("last_at.event_id").alias("last_id"))


@query("content_rebuild", """
SELECT conv_id AS practice, md5(string_agg(CASE WHEN role = 'system' THEN '![图](' || 'asset://' || turn || ')' ELSE trim(text) END, chr(10) || chr(10) ORDER BY turn)) AS content_md5
FROM conversations GROUP BY 1""")
def content_rebuild(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "conversations").select(F.col("conv_id").alias("practice"), "turn", F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), F.when(F.col("role") == "system", F.concat(F.lit("asset://"), F.col("turn").cast("string"))).otherwise(F.col("text")).alias("content"))
    return W.content_of(rows, "practice", "turn").select("practice", F.md5("content").alias("content_md5"))


@query("style_unify", """
SELECT conv_id AS practice, turn, CASE WHEN role = 'system' AND turn % 2 = 0 THEN 'center' WHEN turn % 2 = 0 THEN NULL ELSE 'left' END AS style, role = 'system' AND turn % 2 = 0 AS adjusted FROM conversations""")
def style_unify(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "conversations").select(F.col("conv_id").alias("practice"), "turn", F.col("role").alias("type"), F.when(F.col("turn") % 2 == 1, "left").alias("style"))
    return W.unified(rows, ["system"], "center").select("practice", "turn", "style", "adjusted")


@query("practice_nested", f"""WITH {PRACTICE}
SELECT practice, count(DISTINCT label) AS n_sections, count(*) AS n_questions, string_agg(label || ':' || position, ',' ORDER BY label, position) AS outline FROM practice GROUP BY 1""")
def practice_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = _practice(spark, d)
    items = rows.select("practice", F.col("label").alias("section"), "position", F.col("position").alias("question"))
    sections = items.select("practice", "section", F.col("section").alias("title")).distinct()
    out = W.nested(rows.select("practice").distinct(), sections, items)
    outline = F.flatten(F.transform("sections", lambda s: F.transform(s["questions"], lambda q: F.concat(s["section"], F.lit(":"), q["question"].cast("string")))))
    return out.select("practice", F.size("sections").cast("long").alias("n_sections"), F.size(outline).cast("long").alias("n_questions"), F.array_join(outline, ",").alias("outline"))


@query("score_totals", "SELECT source_id, coalesce(sum(score), 0) AS total_score, bool_or(score IS NOT NULL) AS any_score FROM questions WHERE NOT is_deleted GROUP BY 1", bank=True)
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    return T.questions(spark, d).where("NOT is_deleted").groupBy("source_id").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total_score"), F.bool_or(F.col("score").isNotNull()).alias("any_score"))


@query("inventory_counts", "SELECT coalesce(question_type, '(无)') AS value, count(*) AS n FROM questions GROUP BY 1", bank=True)
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.counts_by(T.questions(spark, d), "question_type")


@query("inventory_children", "SELECT o.o_orderkey AS practice, count(DISTINCT l_linenumber) AS sections, count(l_orderkey) AS items, coalesce(sum(l_quantity), 0) AS blocks FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def inventory_children(spark: SparkSession, d: str) -> DataFrame:
    children = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("practice")).agg(F.count_distinct("l_linenumber").alias("sections"), F.count("*").alias("items"), F.sum("l_quantity").alias("blocks"))
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("practice")).join(children, "practice", "left").na.fill(0)


@query("coverage_features", r"""
SELECT subject, count(*) AS total, count(*) FILTER (WHERE regexp_matches(content, '\$[^$]+\$')) AS formulas, count(*) FILTER (WHERE contains(content, '|')) AS tables,
  count(*) FILTER (WHERE length(content) >= 300) AS long_texts, sum(length(content))::BIGINT AS total_chars FROM questions GROUP BY 1""", bank=True)
def coverage_features(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return I.coverage(T.questions(spark, d), "subject", {"formulas": c.rlike(r"\$[^$]+\$"), "tables": F.contains(c, F.lit("|")), "long_texts": F.length(c) >= 300}, F.length(c))


@query("candidate_buckets", r""", b AS (
  SELECT subject, id, unnest(list_filter([CASE WHEN length(content) >= 300 THEN 'long_text' END, CASE WHEN contains(content, '$') THEN 'formula' END,
    CASE WHEN regexp_matches(content, '\|.*\|') THEN 'multi' WHEN contains(content, '|') THEN 'single' END], lambda x: x IS NOT NULL)) AS bucket FROM questions)
SELECT subject, bucket, count(*) AS n, min(id) AS first_id FROM b GROUP BY ALL""", bank=True)
def candidate_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return I.buckets(T.questions(spark, d), "subject", [("long_text", F.length(c) >= 300), ("formula", F.contains(c, F.lit("$")))], [("multi", c.rlike(r"\|.*\|")), ("single", F.contains(c, F.lit("|")))])


@query("issue_summary", r""", i AS (
  SELECT id, unnest(list_filter([CASE WHEN answer IS NULL OR trim(answer) = '' THEN 'no_answer' END, CASE WHEN question_type IS NULL THEN 'no_type' END,
    CASE WHEN (length(content) - length(replace(content, '$', ''))) % 2 = 1 THEN 'odd_dollars' END,
    CASE WHEN length(content) - length(replace(content, '{', '')) <> length(content) - length(replace(content, '}', '')) THEN 'braces' END], lambda x: x IS NOT NULL)) AS issue FROM questions)
SELECT issue, count(*) AS n, count(DISTINCT id) AS rows FROM i GROUP BY 1""", bank=True)
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    n = lambda mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    checks = {"no_answer": F.col("answer").isNull() | (F.trim("answer") == ""), "no_type": F.col("question_type").isNull(), "odd_dollars": n("$") % 2 == 1, "braces": n("{") != n("}")}
    return I.issue_summary(I.issues(T.questions(spark, d), checks))


@query("feature_rank_pick", """
SELECT id, subject, question_type, pick FROM (
  SELECT id, subject, question_type, row_number() OVER (PARTITION BY subject, question_type ORDER BY contains(content, '$') DESC, least(length(content) - length(replace(content, '|', '')), 2) DESC, length(content) DESC, id)::INT AS pick
  FROM questions q WHERE NOT is_deleted AND NOT EXISTS (SELECT 1 FROM used WHERE question_id = q.id)) WHERE pick <= 3""", bank=True)
def feature_rank_pick(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    marks = F.least(F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit(""))), F.lit(2))
    rows = I.picked(T.questions(spark, d).where("NOT is_deleted"), ["subject", "question_type"], 3, F.contains(c, F.lit("$")).desc(), marks.desc(), F.length(c).desc(), F.col("id"), taken=T.used_questions(spark, d).select(F.col("question_id").alias("id")))
    return rows.select("id", "subject", "question_type", "pick")


@query("sequence_gaps", """
WITH kept AS (SELECT l_orderkey, l_linenumber * (1 + l_orderkey % 3) AS l_linenumber FROM lineitem), g AS (SELECT l_orderkey AS practice, max(l_linenumber) AS expected, list(DISTINCT l_linenumber) AS found FROM kept GROUP BY 1),
n AS (SELECT practice, l_linenumber AS number, coalesce(lag(l_linenumber) OVER (PARTITION BY practice ORDER BY l_linenumber), 0) + 1 AS lo FROM (SELECT DISTINCT l_orderkey AS practice, l_linenumber FROM kept)),
m AS (SELECT practice, string_agg(CASE WHEN lo = number - 1 THEN lo::VARCHAR WHEN lo < number - 1 THEN lo || '-' || (number - 1) END, ',' ORDER BY number) AS missing FROM n GROUP BY 1)
SELECT g.practice, expected, len(found)::INT AS n_found, coalesce(missing, '') AS missing, missing IS NULL AS contiguous FROM g JOIN m ON m.practice = g.practice""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("practice"), (F.col("l_linenumber") * (1 + F.col("l_orderkey") % 3)).alias("number")), "practice", "number")


@query("broken_links", r"""
SELECT DISTINCT p.page_id AS id, r.ref FROM pages p, unnest(regexp_extract_all(html, '(?:href|src)="(/[^"/?#]*)', 1)) AS r(ref)
WHERE NOT EXISTS (SELECT 1 FROM pages f WHERE regexp_extract(f.url, 'https?://[^/]+(/[^/?#]*)', 1) = r.ref)""")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    pages = T.table(spark, d, "pages")
    files = pages.select(F.regexp_extract("url", r"https?://[^/]+(/[^/?#]*)", 1).alias("ref")).distinct()
    return I.broken_links(pages.select(F.col("page_id").alias("id"), F.col("html").alias("content")), files, r'(?:href|src)="(/[^"/?#]*)')


@query("type_label_counts", "SELECT CASE WHEN question_type IS NULL THEN '未知题型' WHEN question_type IN ('single_choice', '选择题') THEN '选择题' WHEN question_type = 'fill_blank' THEN '填空题' WHEN question_type = 'calculation' THEN '计算题' ELSE '论述题' END AS label, count(*) AS n FROM questions WHERE NOT is_deleted GROUP BY 1", bank=True)
def type_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.questions(spark, d).where("NOT is_deleted").groupBy(type_label(F.col("question_type")).alias("label")).agg(F.count("*").alias("n"))


@query("segment_insert", f"""WITH {PRACTICE}, n AS (
  SELECT practice, label AS segment, position, 0 AS new FROM practice
  UNION ALL SELECT DISTINCT practice, '选择题', NULL::BIGINT, 1 FROM practice UNION ALL SELECT DISTINCT practice, '附录', NULL, 1 FROM practice),
s AS (SELECT *, min(position) OVER (PARTITION BY practice, segment) AS start FROM n)
SELECT practice, segment, position AS old_position, (row_number() OVER (PARTITION BY practice ORDER BY start NULLS LAST, segment, new, position NULLS LAST) - 1)::INT AS position FROM s""")
def segment_insert(spark: SparkSession, d: str) -> DataFrame:
    blocks = _practice(spark, d).select("practice", F.col("label").alias("segment"), F.col("position").alias("old_position"))
    new = blocks.select("practice").distinct().select("practice", F.explode(F.array(F.lit("选择题"), F.lit("附录"))).alias("segment"))
    return W.inserted(blocks, new.withColumn("old_position", F.lit(None).cast("long")), "practice", "segment", "old_position").select("practice", "segment", "old_position", "position")


@query("snapshot_restore", """
SELECT id AS source_question_id, CASE WHEN id % 4 = 0 THEN 'old' ELSE question_type END AS question_type, difficulty, id % 4 <> 0 AND id % 3 = 0 AS changed FROM questions""", bank=True)
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d)
    copies = W.snapshots(q, F.lit("p"), "p").withColumn("source_version", F.when(F.col("source_question_id") % 3 == 0, "old").otherwise(F.col("source_version"))).withColumn("question_type", F.lit("old"))
    return W.restored(copies, q.where("id % 4 <> 0"), "p").select("source_question_id", "question_type", "difficulty", "changed")


@query("page_settings", """
SELECT o_orderkey AS practice, 'A4' AS size, CASE WHEN o_orderkey % 3 = 0 THEN '3' WHEN o_orderstatus = 'F' THEN '2' ELSE '1' END AS columns,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN '10.5' ELSE '12' END AS font_size FROM orders""")
def page_settings(spark: SparkSession, d: str) -> DataFrame:
    config = F.when(F.col("o_orderkey") % 3 == 0, '{"columns": "3", "font_size": null}').when(F.col("o_orderkey") % 3 == 1, "{}")
    rows = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("practice"), config.alias("page_config"), (F.col("o_orderstatus") == "F").alias("has_layout"))
    return W.page_settings(rows)
