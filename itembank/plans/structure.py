"""Queries of rectangles, answers inside lines, mixed JSON, changes of blocks, layouts and sections written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions.dictionaries import lookup
from itembank.operators import extract as E
from itembank.operators import workbook as W
from itembank.plans.registry import query
from itembank.plans.workbook import ROLES
from itembank.sources import files
from itembank.sources import tables as T


@query("figures_in_questions", """
WITH p AS (SELECT o_custkey AS page, o_orderkey % 5 AS xref, o_orderkey AS place, (o_orderkey * 37 % 500)::DOUBLE AS x0, (o_orderkey * 53 % 700)::DOUBLE AS y0, 20 + (o_orderkey * 7 % 160)::DOUBLE AS w, 20 + (o_orderkey * 11 % 330)::DOUBLE AS h FROM orders),
s AS (SELECT c_custkey AS question, 0 AS segment, c_custkey AS page, 40.0::DOUBLE AS x0, 44 + (c_custkey % 300)::DOUBLE AS y0, 140 + (c_custkey % 400)::DOUBLE AS x1, 760.0::DOUBLE AS y1 FROM customer
  UNION ALL SELECT c_custkey, 1, c_custkey + 1, 40, 44, 550, 44 + c_custkey % 500 FROM customer),
j AS (SELECT question, segment, p.page, xref, place, greatest(p.x0, s.x0) AS x0, greatest(p.y0, s.y0) AS y0, least(p.x0 + w, s.x1) AS x1, least(p.y0 + h, s.y1) AS y1 FROM p JOIN s ON s.page = p.page WHERE w >= 40 AND h >= 40),
k AS (SELECT *, min(segment) OVER (PARTITION BY question, xref) AS earliest FROM j WHERE x1 > x0 AND y1 > y0)
SELECT question, row_number() OVER (PARTITION BY question ORDER BY segment, place, xref)::INT AS figure, xref, page, x0, y0, x1, y1 FROM k WHERE segment = earliest""")
def figures_in_questions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pictures on the pages of their customers; customers as questions that go on to the next page."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    at = T.table(spark, d, "orders").select(F.col("o_custkey").alias("page"), (o % 5).alias("xref"), o.alias("place"), (o * 37 % 500).cast("double").alias("x0"), (o * 53 % 700).cast("double").alias("y0"), (20 + o * 7 % 160).cast("double").alias("w"), (20 + o * 11 % 330).cast("double").alias("h"))
    pictures = at.select("page", "xref", "place", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    number = lambda x: F.lit(x).cast("double") if isinstance(x, int) else x.cast("double")
    segment = lambda i, page, x0, y0, x1, y1: F.struct(F.lit(i).alias("segment"), page.alias("page"), *[number(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))])
    parts = F.array(segment(0, c, 40, 44 + c % 300, 140 + c % 400, 760), segment(1, c + 1, 40, 44, 550, 44 + c % 500))
    segments = T.table(spark, d, "customer").select(c.alias("question"), F.explode(parts).alias("s")).select("question", "s.*")
    return E.figures(pictures, segments)


PAGED = """pages_ AS (SELECT conv_id AS paper, turn AS page, CASE role WHEN 'user' THEN replace(text, '. ', '. ' || chr(10)) || ' x ' || (turn % 4 + 1) || '．（4分）rest' || chr(10) || '故选：BC' ELSE '第 3 页（共 9 页）' || chr(10) || '（多选）' || (turn % 3 + 5) || '、【答案】 ' || CASE WHEN turn % 2 = 0 THEN 'AB ' ELSE '' END || chr(10) || '一、 section' || chr(10) || text END AS t FROM conversations)"""


@query("answers_inside_lines", rf"""WITH {PAGED},
l AS (SELECT paper, page, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw FROM (SELECT paper, page, string_split(regexp_replace(t, '第\s*\d+\s*页[（(]共\s*\d+\s*页[）)]', '', 'g'), chr(10)) AS ls FROM pages_)),
s AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS said FROM l),
m AS (SELECT *, regexp_extract(said, '(?:[（(]\s*多选\s*[）)])?\s*(\d{{1,2}})\s*[.．、]\s*[（(]\s*\d+\s*分\s*[）)]?', 0) AS strong, regexp_extract(said, '^\s*(?:[（(]\s*多选\s*[）)])?\s*(\d{{1,2}})\s*[.．、]\s*[（(【]', 0) AS loose FROM s WHERE said <> ''),
c AS (SELECT *, CASE WHEN strong <> '' THEN strong WHEN loose <> '' THEN left(loose, length(loose) - 1) END AS mark FROM m),
p AS (SELECT paper, page, line, 1 AS piece, NULL AS number, CASE WHEN mark IS NOT NULL THEN trim(left(said, instr(said, mark) - 1)) WHEN regexp_matches(said, '^\s*[一二三四五六七八九十]+\s*、') THEN '' ELSE said END AS said FROM c
  UNION ALL SELECT paper, page, line, 2, regexp_extract(mark, '(\d{{1,2}})\s*[.．、]', 1)::INT, trim(substr(said, instr(said, mark) + length(mark)), ' ' || chr(9) || chr(13)) FROM c WHERE mark IS NOT NULL),
b AS (SELECT *, count(number) OVER (PARTITION BY paper ORDER BY page, line, piece) AS block FROM p),
g AS (SELECT paper, block, max(number) AS number, min(page) FILTER (number IS NOT NULL) AS page, coalesce(string_agg(nullif(said, ''), chr(10) ORDER BY page, line, piece), '') AS body FROM b WHERE block > 0 GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY paper, number ORDER BY block) AS rn, count(*) OVER (PARTITION BY paper, number) AS blocks FROM g)
SELECT paper, number, page, blocks, coalesce(nullif(trim(regexp_extract(body, '【\s*答案\s*】\s*([^\n]*)', 1)), ''), nullif(regexp_extract(body, '故选[：:]\s*([A-D]{{1,4}})', 1), '')) AS answer, nullif(body, '') AS analysis FROM f WHERE rn = 1""")
def answers_inside_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as answer pages: users' turns have a number inside their last line, others open with one."""
    turn = F.col("turn")
    mine = F.concat(F.replace("text", F.lit(". "), F.lit(". \n")), F.lit(" x "), (turn % 4 + 1).cast("string"), F.lit("．（4分）rest\n故选：BC"))
    other = F.concat(F.lit("第 3 页（共 9 页）\n（多选）"), (turn % 3 + 5).cast("string"), F.lit("、【答案】 "), F.when(turn % 2 == 0, "AB ").otherwise(""), F.lit("\n一、 section\n"), "text")
    pages = T.table(spark, d, "conversations").select(F.col("conv_id").alias("paper"), turn.alias("page"), F.when(F.col("role") == "user", mine).otherwise(other).alias("t"))
    return E.split_answers(pages, "paper", "page", "t")


@query("mixed_json", r"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t, doc_id % 7 AS k FROM documents),
c AS (SELECT *, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM d),
r AS (
  SELECT id, 'object' AS form, 0 AS position, 'Q' || id AS source_question_id, 3 AS question_number, 'single_choice' AS question_type, 'sel' AS raw_ocr_content, ltrim(t, ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN t <> '' THEN chr(10) || chr(10) ELSE '' END || '![figure](asset://f1.png)' || chr(10) || chr(10) || '![figure](asset://f2.png)' AS content, 'A=;B=y' AS options, 'A' AS answer, NULL AS explanation, 2.5::DOUBLE AS score, 0.9::DOUBLE AS ocr_confidence, false AS needs_review FROM c WHERE k = 0
  UNION ALL SELECT id, 'list', 0, '7', 0, 'single_choice', t, s, 'A=1;B=', 'B', 'why', NULL, NULL, true FROM c WHERE k = 1
  UNION ALL SELECT id, 'broken', NULL, NULL, NULL, NULL, '{"questions": [' || t, '{"questions": [' || t, NULL, NULL, NULL, NULL, NULL, true FROM c WHERE k = 2
  UNION ALL SELECT id, 'list', 0, '', 0, 'unknown', '', '', NULL, NULL, NULL, NULL, NULL, true FROM c WHERE k = 5
  UNION ALL SELECT id, 'list', 2, '', 12, 'essay', t, s, NULL, '7', NULL, 4, NULL, true FROM c WHERE k = 5)
SELECT *, CASE WHEN needs_review THEN 'pending' ELSE 'approved' END AS review_status FROM r""")
def mixed_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents as extraction files of seven forms: objects, lists, objects without a list, strings, lists with odd members, broken texts, none."""
    said = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    said = F.substring(said, F.lit(2), F.length(said) - 2)
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 7
    whole = F.concat(F.lit('{"questions": [{"id": "Q'), i, F.lit('", "number": 3, "type": "single_choice", "content": {"stem": '), said, F.lit(', "options": {"B": "y", "A": null}}, "text": {"selected": "sel"}, "answer": {"content": "A"}, "score": 2.5, "quality": {"confidence": 0.9, "needs_review": false}, "assets": {"figures": ["f1.png", "f2.png"]}}, "no object"]}'))
    bare = F.concat(F.lit('[{"id": 7, "number": "x", "text": '), said, F.lit(', "options": [{"label": "A", "content": "1"}, {"label": "B", "content": ""}], "answer": "B", "explanation": "why", "score": {"a": 1}, "quality": 3}]'))
    odd = F.concat(F.lit('[{"text": {"selected": ""}, "content": {"stem": ""}, "answer": 0, "assets": 5}, 4, {"number": 12, "type": "essay", "text": {"selected": "", "native": '), said, F.lit('}, "content": "oops", "answer": 7, "score": 4, "quality": {}}]'))
    text = F.when(k == 0, whole).when(k == 1, bare).when(k == 2, F.concat(F.lit('{"questions": ['), F.coalesce("text", F.lit("")))).when(k == 3, '{"questions": {"id": 1}}').when(k == 4, '"a string"').when(k == 5, odd)
    rows = files.mixed_extraction(T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("json")), "json")
    return rows.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["content"])), ";"))


BLOCKS = """b AS (SELECT conv_id AS question, 'b' || turn AS block, turn AS position, CASE role WHEN 'system' THEN 'image' ELSE 'text' END AS type, CASE role WHEN 'system' THEN 'asset://' || turn ELSE text END AS content, conv_id % 7 <> 0 AS c FROM conversations)"""


@query("block_changes", f"""WITH {BLOCKS},
k AS (SELECT question, block, type, CASE WHEN c AND position % 8 = 1 THEN 'newer' WHEN c AND position % 4 = 1 THEN 'new ' || position ELSE content END AS content, CASE WHEN c AND position % 8 = 1 THEN 'left' END AS style,
    CASE WHEN c AND position = 2 THEN 0 ELSE position END AS spot, CASE WHEN c AND position = 2 THEN 0 ELSE 1 END AS late FROM b WHERE NOT (c AND position % 4 = 3)
  UNION ALL SELECT DISTINCT question, 'x', 'text', 'tail', NULL, 99999, 2 FROM b WHERE c AND question % 2 = 0),
d AS (SELECT *, (row_number() OVER (PARTITION BY question ORDER BY spot, late) - 1)::INT AS place FROM k),
r AS (SELECT question, md5(string_agg(CASE WHEN type = 'image' THEN '![图](' || content || ')' ELSE nullif(trim(content), '') END, chr(10) || chr(10) ORDER BY place)) AS rebuilt FROM d GROUP BY 1),
m AS (SELECT question, bool_or(c AND (question % 2 = 0 OR position % 4 IN (1, 3) OR position = 2)) AS is_modified FROM b GROUP BY 1)
SELECT d.question, block, place AS position, type, content, style, is_modified, rebuilt FROM d JOIN r ON r.question = d.question JOIN m ON m.question = d.question""")
def block_changes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks; a mixed set of changes for six of seven conversations; the questions' content made anew."""
    turns = T.table(spark, d, "conversations")
    turn, image = F.col("turn"), F.col("role") == "system"
    blocks = turns.select(F.col("conv_id").alias("question"), F.concat(F.lit("b"), turn.cast("string")).alias("block"), turn.alias("position"), F.when(image, "image").otherwise("text").alias("type"), F.when(image, F.concat(F.lit("asset://"), turn.cast("string"))).otherwise(F.col("text")).alias("content"), F.lit(None).cast("string").alias("style"))
    change = lambda op, seq, content=None, style=None, to=None, block=None, kind=None: F.struct(F.lit(op).alias("op"), seq.cast("long").alias("seq"), F.lit(block).alias("named"), F.lit(kind).cast("string").alias("type"), (content if content is not None else F.lit(None)).cast("string").alias("content"), F.lit(content is not None).alias("content_set"), F.lit(style).cast("string").alias("style"), F.lit(style is not None).alias("style_set"), F.lit(to).cast("long").alias("to"))
    wanted = F.array_compact(F.array(F.when(turn % 4 == 3, change("delete", turn)), F.when(turn % 4 == 3, change("update", turn, F.lit("too late"))), F.when(turn % 4 == 1, change("update", turn, F.concat(F.lit("new "), turn.cast("string")))), F.when(turn % 8 == 1, change("update", turn + 100, F.lit("newer"), "left")), F.when(turn == 2, change("move", turn, to=0)), F.when((turn == 0) & (F.col("conv_id") % 2 == 0), change("add", turn + 50, F.lit("tail"), block="x", kind="text")), F.when((turn == 0) & (F.col("conv_id") % 5 == 0), change("delete", turn, block="zzz"))))
    changes = turns.where("conv_id % 7 <> 0").select(F.col("conv_id").alias("question"), F.concat(F.lit("b"), turn.cast("string")).alias("own"), F.explode(wanted).alias("w")).select("question", "w.*", F.coalesce("w.named", "own").alias("block")).drop("named")
    now = W.blocks_changed(blocks, changes)
    return now.join(W.content_of(now, "question", "position").select("question", F.md5("content").alias("rebuilt")), "question")


@query("layout_sync", """
WITH t AS (SELECT conv_id AS practice, turn, conv_id % 4 <> 3 AS stored FROM conversations),
b AS (SELECT practice, turn * 2 AS spot, CASE WHEN stored AND turn = 1 AND practice % 2 = 0 THEN 's0' ELSE 'new-' || left(sha256(practice || '/' || turn * 2), 12) END AS opened, CASE WHEN turn % 2 = 1 THEN 'T' || turn END AS title, turn % 2 = 0 AS new_page, NULL AS question FROM t WHERE turn % 3 = 1
  UNION ALL SELECT practice, turn * 2 + 1, NULL, NULL, NULL, 'q' || turn FROM t WHERE turn % 5 <> 4
  UNION ALL SELECT DISTINCT practice, 1000, NULL, NULL, NULL, 'q0' FROM t WHERE practice % 6 = 0 UNION ALL SELECT DISTINCT practice, 1001, NULL, NULL, NULL, 'q9999' FROM t),
u AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY practice ORDER BY spot) AS under FROM b),
q AS (SELECT practice, 'q' || turn AS question, 's' || turn % 2 AS section, turn // 2 + 1 AS position, turn + 1 AS number FROM t WHERE stored),
r AS (SELECT u.practice, u.question, spot, coalesce(under, 's1') AS target, row_number() OVER (PARTITION BY u.practice ORDER BY spot) AS q_number, row_number() OVER (PARTITION BY u.practice, coalesce(under, 's1') ORDER BY spot) AS q_place FROM u JOIN q ON q.practice = u.practice AND q.question = u.question),
p AS (SELECT practice, question, max({'spot': spot, 'target': target, 'q_number': q_number, 'q_place': q_place}) AS r FROM r GROUP BY ALL),
n AS (SELECT q.practice, q.question, coalesce(p.r.target, q.section) AS section, coalesce(p.r.q_place, q.position) AS place, p.r.target IS NOT NULL AND p.r.target <> q.section AS late, CASE WHEN p.r.target <> q.section THEN p.r.spot ELSE q.position END AS was, coalesce(p.r.q_number, q.number) AS number FROM q LEFT JOIN p ON p.practice = q.practice AND p.question = q.question),
qs AS (SELECT practice, question, section, row_number() OVER (PARTITION BY practice, section ORDER BY place, late, was, question)::INT AS position, number FROM n),
s AS (SELECT DISTINCT practice, unnest([{'section': 's0', 'position': 1, 'title': 'first'}, {'section': 's1', 'position': 0, 'title': 'second'}], recursive := true) FROM t WHERE stored),
o AS (SELECT practice, opened AS section, min(spot) AS first_at, arg_max(title, spot) FILTER (title IS NOT NULL) AS title, arg_max(new_page, spot) AS new_page FROM b WHERE opened IS NOT NULL GROUP BY ALL),
a AS (SELECT coalesce(s.practice, o.practice) AS practice, coalesce(s.section, o.section) AS section, s.position, o.first_at, coalesce(o.title, s.title, '小节') AS title, coalesce(o.new_page, false) AS new_page FROM s FULL JOIN o ON o.practice = s.practice AND o.section = s.section),
ss AS (SELECT practice, section, coalesce(position, CASE WHEN practice % 4 <> 3 THEN 2 ELSE 0 END + row_number() OVER (PARTITION BY practice, position IS NULL ORDER BY first_at) - 1)::INT AS s_position, title, new_page FROM a)
SELECT ss.practice, ss.section, s_position, title, true AS show_title, new_page, 'custom' AS kind, question, qs.position, number FROM ss LEFT JOIN qs ON qs.practice = ss.practice AND qs.section = ss.section""")
def layout_sync(spark: SparkSession, d: str) -> DataFrame:
    """Sections and questions after a layout with leading, repeated, unknown and missing references is saved; a quarter of the practices have no sections yet."""
    turns = T.table(spark, d, "conversations").select(F.col("conv_id").alias("practice"), "turn")
    t = F.col("turn")
    stored = turns.where("practice % 4 <> 3")
    section = lambda name, at, title: F.struct(F.lit(name).alias("section"), F.lit(at).alias("position"), F.lit(title).alias("title"))
    sections = stored.select("practice").distinct().select("practice", F.explode(F.array(section("s0", 1, "first"), section("s1", 0, "second"))).alias("s")).select("practice", "s.*", F.lit(None).cast("boolean").alias("show_title"), F.lit(None).cast("boolean").alias("new_page"), F.lit(None).cast("string").alias("kind"))
    questions = stored.select("practice", F.concat(F.lit("q"), t.cast("string")).alias("question"), F.concat(F.lit("s"), (t % 2).cast("string")).alias("section"), (F.floor(t / 2) + 1).alias("position"), (t + 1).alias("number"))
    block = lambda kind, at, section=None, title=None, page=None, question=None: F.struct(F.lit(kind).alias("type"), at.cast("long").alias("at"), (section if section is not None else F.lit(None)).cast("string").alias("section"), (title if title is not None else F.lit(None)).cast("string").alias("title"), F.lit(None).cast("boolean").alias("show_title"), (page if page is not None else F.lit(None)).cast("boolean").alias("new_page"), F.lit(None).cast("string").alias("kind"), (question if question is not None else F.lit(None)).cast("string").alias("question"))
    made = F.array_compact(F.array(F.when(t % 3 == 1, block("subtitle", t * 2, F.when((t == 1) & (F.col("practice") % 2 == 0), "s0"), F.when(t % 2 == 1, F.concat(F.lit("T"), t.cast("string"))), t % 2 == 0)), F.when(t % 5 != 4, block("question_ref", t * 2 + 1, question=F.concat(F.lit("q"), t.cast("string"))))))
    more = F.array_compact(F.array(F.when(F.col("practice") % 6 == 0, block("question_ref", F.lit(1000), question=F.lit("q0"))), block("question_ref", F.lit(1001), question=F.lit("q9999"))))
    layout = turns.select("practice", F.explode(made).alias("b")).unionByName(turns.select("practice").distinct().select("practice", F.explode(more).alias("b"))).select("practice", "b.*")
    s, q = W.layout_synced(sections, questions, layout)
    return s.withColumnRenamed("position", "s_position").join(q, ["practice", "section"], "left")


GROUPED = """q AS (SELECT conv_id AS practice, turn AS question, turn % 3 AS s, turn // 3 AS position, turn + 1 AS number, CASE role WHEN 'system' THEN '填空题' WHEN 'user' THEN '选择题' ELSE '附加题' END AS label, CASE role WHEN 'user' THEN 1 WHEN 'system' THEN 3 ELSE 11 END AS rank FROM conversations),
t AS (SELECT *, CASE s WHEN 0 THEN '选择题' WHEN 1 THEN '填空题' ELSE '自编' END AS title FROM q),
w AS (SELECT practice, string_agg(label, '、' ORDER BY rank) AS wanted FROM (SELECT DISTINCT practice, label, rank FROM q) GROUP BY 1)"""


def _typed_sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = T.table(spark, d, "conversations").select(F.col("conv_id").alias("practice"), F.col("turn").alias("question"), "role")
    section = lambda i, title, kind: F.struct(F.lit(f"s{i}").alias("section"), F.lit(i).alias("position"), F.lit(title).alias("title"), F.lit(kind).alias("kind"))
    sections = turns.select("practice").distinct().select("practice", F.explode(F.array(section(0, "选择题", "选择题"), section(1, "填空题", "填空题"), section(2, "自编", "custom"))).alias("s")).select("practice", "s.*")
    q = F.col("question")
    return sections, turns.select("practice", "question", F.concat(F.lit("s"), (q % 3).cast("string")).alias("section"), F.floor(q / 3).alias("position"), (q + 1).alias("number"), lookup(F.col("role"), ROLES).alias("label"))


@query("regroup_changes", f"""WITH {GROUPED}
SELECT practice, 'order' AS change, wanted AS detail FROM w WHERE wanted <> '选择题、填空题'
UNION ALL SELECT practice, 'merge', label FROM t GROUP BY practice, label HAVING count(DISTINCT title) > 1
UNION ALL SELECT practice, 'move', number || ':自编:' || label FROM t WHERE s = 2""")
def regroup_changes(spark: SparkSession, d: str) -> DataFrame:
    return W.regroup_changes(*_typed_sections(spark, d))


@query("regroup_applied", f"""WITH {GROUPED},
o AS (SELECT *, row_number() OVER (PARTITION BY practice ORDER BY rank, s, position)::INT AS new_number, (row_number() OVER (PARTITION BY practice, label ORDER BY s, position) - 1)::INT AS new_position, (dense_rank() OVER (PARTITION BY practice ORDER BY rank) - 1)::INT AS section FROM q),
e AS (SELECT practice, max(section) + 1 AS section FROM o GROUP BY 1)
SELECT practice, question, section, label AS title, new_position AS position, new_number AS number, 0 AS changes_left FROM o
UNION ALL SELECT practice, NULL, section, '自编', NULL, NULL, 0 FROM e""")
def regroup_applied(spark: SparkSession, d: str) -> DataFrame:
    """Practices after grouping by type, and how many changes a second grouping would make."""
    sections, questions = W.regrouped(*_typed_sections(spark, d))
    left = W.regroup_changes(sections, questions).groupBy("practice").agg(F.count("*").cast("int").alias("changes_left"))
    rows = sections.select("practice", F.col("section").alias("id"), F.col("position").alias("section"), "title").join(questions.select("practice", F.col("section").alias("id"), "question", "position", "number"), ["practice", "id"], "left")
    return rows.join(left, "practice", "left").select("practice", "question", F.col("section").cast("int").alias("section"), "title", "position", "number", F.coalesce("changes_left", F.lit(0)).alias("changes_left"))


@query("practice_blocks_nested", """
WITH b AS (SELECT conv_id AS practice, CASE role WHEN 'system' THEN '填空题' WHEN 'user' THEN '选择题' ELSE '附加题' END AS label, turn, string_split(text, chr(10)) AS lines FROM conversations)
SELECT practice, count(DISTINCT label) AS n_sections, count(*) AS n_questions, sum(len(lines))::BIGINT AS n_blocks, md5(string_agg(label || ':' || turn || ':' || array_to_string(lines, '|'), chr(10) ORDER BY label, turn)) AS outline FROM b GROUP BY 1""")
def practice_blocks_nested(spark: SparkSession, d: str) -> DataFrame:
    """Practices with their sections, questions and blocks (lines of the turns) inside one another, each level in order."""
    rows = T.table(spark, d, "conversations").select(F.col("conv_id").alias("practice"), lookup(F.col("role"), ROLES).alias("section"), F.col("turn").alias("position"), F.col("turn").alias("question"), "text")
    blocks = rows.select("practice", "question", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    sections = rows.select("practice", "section", F.col("section").alias("title")).distinct()
    out = W.nested(rows.select("practice").distinct(), sections, rows.drop("text"), blocks)
    lines = lambda q: F.array_join(F.transform(q["blocks"], lambda b: b["line"]), "|")
    outline = F.flatten(F.transform("sections", lambda s: F.transform(s["questions"], lambda q: F.concat(s["section"], F.lit(":"), q["question"].cast("string"), F.lit(":"), lines(q)))))
    n = F.aggregate(F.flatten(F.transform("sections", lambda s: F.transform(s["questions"], lambda q: F.size(q["blocks"])))), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("practice", F.size("sections").cast("long").alias("n_sections"), F.size(outline).cast("long").alias("n_questions"), n.alias("n_blocks"), F.md5(F.array_join(outline, "\n")).alias("outline"))
