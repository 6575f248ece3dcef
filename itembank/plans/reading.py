"""Queries of pages, anchors, answers, reconciled readings, options and their renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions import text as X
from itembank.operators import extract as E
from itembank.operators import inventory as I
from itembank.plans.extraction import paired
from itembank.plans.registry import query
from itembank.sources import tables as T


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """paper, page, text: turns as pages; those of assistants number a question, some of system messages open the answers."""
    said = F.coalesce("text", F.lit(""))
    text = F.when(F.col("role") == "assistant", F.concat((F.col("turn") % 9).cast("string"), F.lit("． "), said, F.lit(" （多选）3、(2分)"))).when(F.col("role") == "user", said).otherwise(F.concat(F.when(F.col("conv_id") % 2 == 0, "参考答案").otherwise("���"), said))
    return T.table(spark, d, "conversations").select(F.col("conv_id").alias("paper"), F.col("turn").alias("page"), text.alias("text"))


PAGES = """pages_ AS (SELECT conv_id AS paper, turn AS page, CASE role WHEN 'assistant' THEN (turn % 9)::VARCHAR || '． ' || coalesce(text, '') || ' （多选）3、(2分)' WHEN 'user' THEN coalesce(text, '')
  ELSE CASE WHEN conv_id % 2 = 0 THEN '参考答案' ELSE '���' END || coalesce(text, '') END AS text FROM conversations),
inspected AS (SELECT paper, page, length(text) AS chars, length(text) - length(replace(text, '�', '')) AS replaced,
  regexp_extract_all(text, '(?:[（(]\\s*多选\\s*[）)])?\\s*(\\d{1,2})\\s*[.．、]\\s*(?:[（(]\\s*\\d+\\s*分\\s*[）)])?', 1) AS numbers,
  contains(text, '参考答案') OR contains(text, '答案与解析') OR contains(text, '试题解析') AS is_answer, length(trim(text, ' ' || chr(10) || chr(9))) AS stripped FROM pages_)"""


@query("page_inspection", f"WITH {PAGES} SELECT paper, page, chars::INT AS chars, replaced::INT AS replaced, array_to_string(list_transform(numbers, lambda n: n::INT), ',') AS numbers, is_answer, stripped < 20 OR replaced >= 3 AS needs_ocr FROM inspected")
def page_inspection(spark: SparkSession, d: str) -> DataFrame:
    out = I.page_inspections(_pages(spark, d), "paper", "page", "text", I.ANSWER_MARKERS)
    return out.withColumn("numbers", F.array_join("numbers", ","))


@query("answer_boundaries", f"WITH {PAGES}, b AS (SELECT paper, min(page) FILTER (WHERE is_answer) AS answer_start FROM inspected GROUP BY 1) SELECT i.paper, count(*) AS pages, b.answer_start, count(*) FILTER (WHERE b.answer_start IS NULL OR i.page < b.answer_start) AS question_pages FROM inspected i JOIN b ON b.paper = i.paper GROUP BY i.paper, b.answer_start")
def answer_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return I.answer_boundaries(I.page_inspections(_pages(spark, d), "paper", "page", "text", I.ANSWER_MARKERS), "paper", "page")


LINES = r"""lines AS (SELECT doc_id AS paper, unnest(list_transform(range(len(ls)), lambda i: {'y': (i // 2)::DOUBLE, 'text': CASE i % 4 WHEN 0 THEN (i % 120)::VARCHAR || '．' WHEN 1 THEN ' （多选） ' || (i - 1)::VARCHAR || '. ' WHEN 2 THEN '第 ' || i || ' 页 1、' ELSE '' END || ls[i + 1]}), recursive := true)
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = T.table(spark, d, "documents").select(F.col("doc_id").alias("paper"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    i = F.col("i")
    mark = F.when(i % 4 == 0, F.concat((i % 120).cast("string"), F.lit("．"))).when(i % 4 == 1, F.concat(F.lit(" （多选） "), (i - 1).cast("string"), F.lit(". "))).when(i % 4 == 2, F.concat(F.lit("第 "), i.cast("string"), F.lit(" 页 1、"))).otherwise("")
    return lines.select("paper", F.floor(i / 2).cast("double").alias("y"), F.concat(mark, "t").alias("text"))


@query("candidate_anchors", rf"""WITH {LINES}, m AS (
  SELECT paper, y, regexp_extract(text, '^\s*(?:[（(]\s*多选\s*[）)])?\s*(\d{{1,2}})\s*(?:[．、：，,]|\.(?:\D|$))', 1) AS n FROM lines WHERE NOT regexp_matches(text, '^\s*第\s*\d+\s*页'))
SELECT DISTINCT paper, n::INT AS number, round(y, 2) AS y FROM m WHERE n <> '' AND n::INT BETWEEN 1 AND 99""")
def candidate_anchors(spark: SparkSession, d: str) -> DataFrame:
    return E.candidate_anchors(_lines(spark, d), ["paper"], "y", "text").select("paper", "number", "y")


@query("answers_matched", r"""
WITH q AS (SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey AS question FROM lineitem),
a AS (SELECT l_orderkey AS paper, l_linenumber + 1 AS number, min({'answer': l_returnflag, 'analysis': l_linestatus}) AS f FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL)
SELECT q.paper, q.number, q.question, a.f.answer AS answer, a.f.analysis AS analysis FROM q LEFT JOIN a ON a.paper = q.paper AND a.number = q.number""")
def answers_matched(spark: SparkSession, d: str) -> DataFrame:
    items = T.table(spark, d, "lineitem")
    questions = items.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("question"))
    answers = items.where("l_linenumber % 3 != 0").select(F.col("l_orderkey").alias("paper"), (F.col("l_linenumber") + 1).alias("number"), F.col("l_returnflag").alias("answer"), F.col("l_linestatus").alias("analysis"))
    return E.with_answers(questions, answers, ["paper", "number"])


@query("review_counts", "SELECT source_id, count(*) AS questions, count(*) FILTER (WHERE review_status = 'pending') AS review_count FROM questions GROUP BY 1", bank=True)
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.questions(spark, d).groupBy("source_id").agg(F.count("*").alias("questions"), F.count_if(F.col("review_status") == "pending").alias("review_count"))


FUSED = r"""WITH r AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next, coalesce(text, '') || ' 长 ' || (doc_id % 3) || ' cm，' || (doc_id % 2) || ' kg/m3' AS a FROM documents),
p AS (SELECT r.doc_id, r.a, coalesce(d.text || ' 长 ' || (r.doc_id % 4) || ' cm', '') AS b, CASE WHEN r.doc_id % 4 <> 0 THEN (r.doc_id % 7) / 6.0::DOUBLE END AS confidence FROM r LEFT JOIN documents d ON d.doc_id = r.next),
t AS (SELECT doc_id, 1 AS side, unnest(regexp_extract_all(a, '([0-9]+(?:[.．][0-9]+)?)\s*([A-Za-z0-9Ω℃³²/%]{0,8})')) AS m FROM p WHERE b <> '' AND confidence IS NOT NULL
  UNION ALL SELECT doc_id, 2, unnest(regexp_extract_all(b, '([0-9]+(?:[.．][0-9]+)?)\s*([A-Za-z0-9Ω℃³²/%]{0,8})')) FROM p WHERE b <> '' AND confidence IS NOT NULL),
u AS (SELECT doc_id, side, replace(regexp_extract(m, '^([0-9]+(?:[.．][0-9]+)?)', 1), '．', '.') AS number, regexp_extract(m, '^[0-9]+(?:[.．][0-9]+)?\s*([A-Za-z0-9Ω℃³²/%]{0,8})', 1) AS raw FROM t),
v AS (SELECT doc_id, side, number, CASE raw WHEN 'kg/m3' THEN 'kg/m³' WHEN 'g/cm3' THEN 'g/cm³' WHEN 'm3' THEN 'm³' WHEN 'cm3' THEN 'cm³' WHEN 'm2' THEN 'm²' WHEN 'cm2' THEN 'cm²' WHEN 'm/s2' THEN 'm/s²' ELSE raw END AS unit FROM u),
w AS (SELECT * FROM v WHERE list_contains(['V','A','Ω','W','J','N','Pa','Hz','kg','g','mg','m','cm','mm','km','mL','L','s','h','min','m²','cm²','m³','cm³','m/s','m/s²','km/h','kg/m³','g/cm³','℃','%'], unit)),
n AS (SELECT doc_id, number, unit, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM w GROUP BY ALL),
g AS (SELECT doc_id, round(sum(least(x, y)) / sum(greatest(x, y)), 4)::DOUBLE AS agreement FROM n GROUP BY 1),
c AS (SELECT doc_id, count(*)::INT AS conflicts FROM (SELECT doc_id, unit FROM n GROUP BY 1, 2 HAVING count(*) FILTER (x > 0 AND y = 0) > 0 AND count(*) FILTER (y > 0 AND x = 0) > 0 AND sum(x) > 0 AND sum(y) > 0) GROUP BY 1),
s AS (SELECT doc_id, len(list_filter(['kg/m3', 'g/cm3', 'm3', 'cm3', 'm2', 'cm2', 'm/s2'], lambda q: regexp_matches(a, '(^|[^A-Za-z/])' || q || '($|[^A-Za-z0-9])')))
  + len(list_filter(regexp_extract_all(a, '\d+(?:[.．]\d+)?\s*[A-Za-zΩ]+'), lambda m: length(regexp_extract(m, '[A-Za-zΩ]+$')) IN (2, 4, 6) AND left(regexp_extract(m, '[A-Za-zΩ]+$'), length(regexp_extract(m, '[A-Za-zΩ]+$')) // 2) = right(m, length(regexp_extract(m, '[A-Za-zΩ]+$')) // 2)))
  + len(regexp_extract_all(a, '\d\.[A-Za-z]')) AS warnings, len(list_filter(string_split(a, chr(10)), lambda l: regexp_matches(l, '[□�]'))) AS formula_lines,
  round(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(0.45::DOUBLE, (length(a) - length(replace(replace(a, '□', ''), '�', ''))) * 0.08::DOUBLE) - CASE WHEN regexp_matches(a, '^\s*' || (doc_id % 30 + 1) || '\s*[.．、]') THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END - CASE WHEN length(a) < 12 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END), 4) AS native FROM p),
z AS (SELECT p.doc_id, coalesce(conflicts, 0) AS conflicts, warnings::INT AS warnings, formula_lines::INT AS formula_lines, CASE WHEN b <> '' AND confidence IS NOT NULL THEN coalesce(agreement, 1.0) END AS agreement,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN confidence IS NULL THEN native ELSE 0.6::DOUBLE * native + 0.4::DOUBLE * confidence END - (CASE WHEN c.doc_id IS NOT NULL THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + 0.03::DOUBLE * least(warnings, 3)))), 4) AS review_score
  FROM p JOIN s ON s.doc_id = p.doc_id LEFT JOIN c ON c.doc_id = p.doc_id LEFT JOIN g ON g.doc_id = p.doc_id)
SELECT *, review_score < 0.85 OR conflicts > 0 AS needs_review FROM z"""


@query("fused_readings", FUSED)
def fused_readings(spark: SparkSession, d: str) -> DataFrame:
    """Each document beside the next one of its source, both with a measured length added."""
    i = F.col("doc_id")
    docs = paired(spark, d).withColumnRenamed("key", "doc_id").withColumn("native", F.concat(F.coalesce("native", F.lit("")), F.lit(" 长 "), (i % 3).cast("string"), F.lit(" cm，"), (i % 2).cast("string"), F.lit(" kg/m3"))).withColumn("other", F.concat("other", F.lit(" 长 "), (i % 4).cast("string"), F.lit(" cm")))
    return E.fused(docs, "doc_id", "native", "other", X.native_quality(F.col("native"), (i % 30 + 1)), F.when(i % 4 != 0, (i % 7) / 6.0))


@query("native_warnings", r"""
SELECT doc_id AS id, CASE WHEN t = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN k > 0 THEN 'replaced:' || k END, CASE WHEN NOT regexp_matches(t, '^\s*' || (doc_id % 30 + 1) || '\s*[.．、]') THEN 'start' END, CASE WHEN length(t) < 12 THEN 'short' END], lambda x: x IS NOT NULL), ',') END AS warnings
FROM (SELECT doc_id, t, length(t) - length(replace(replace(t, '%', ''), '$', '')) AS k FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN (doc_id % 30 + 1) || '. ' ELSE '' END || text END AS t FROM documents))""")
def native_warnings(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d)
    lead = F.when(F.col("id") % 2 == 0, F.concat(F.col("question_number").cast("string"), F.lit(". "))).otherwise("")
    t = F.when(F.col("id") % 9 == 0, "").otherwise(F.concat(lead, "content"))
    return q.select("id", F.array_join(X.native_warnings(F.translate(t, "%$", "□□"), F.col("question_number")), ",").alias("warnings"))


@query("options_normal", """
WITH o AS (SELECT doc_id AS id, n_chars % 3 AS k, coalesce(source, '') AS s FROM documents)
SELECT id, CASE k WHEN 0 THEN 'A=' || s || ';B=two' WHEN 1 THEN 'X=' || s || ';B=;C=three' ELSE NULL END AS options FROM o""")
def options_normal(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.coalesce("source", F.lit("")), F.col("n_chars") % 3
    raw = F.when(k == 0, F.to_json(F.array(s, F.lit("two")))).when(k == 1, F.concat(F.lit("["), F.to_json(F.struct(F.lit("X").alias("label"), s.alias("content"))), F.lit(', {"text": 1}, "three", 7]'))).otherwise('{"A": "x"}')
    out = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.normal_options(raw).alias("o"))
    return out.select("id", F.array_join(F.transform("o", lambda o: F.concat(o["label"], F.lit("="), o["content"])), ";").alias("options"))


_SPANS = r"""regexp_replace(regexp_replace({}, '(?s)\$\$(.+?)\$\$|\\\[(.+?)\\\]', '<span class="math block">\1\2</span>', 'g'), '\$([^$\n]+?)\$|(?s:\\\((.+?)\\\))', '<span class="math">\1\2</span>', 'g')"""
_SHOWN = r"""regexp_replace({}, '!\[([^\]]*)\]\(([^)]+)\)', '<img src="\2" alt="\1" style="{}" loading="lazy" />', 'g')"""
#: Bold parts, then italic ones: asterisks beside asterisks are chr(3) while the latter are looked for.
_BOLD = r"""regexp_replace(regexp_replace(regexp_replace({}, '\*\*(.+?)\*\*', '{}', 'g'), '\*\*', chr(3) || chr(3), 'g'), chr(3) || '\*', chr(3) || chr(3), 'g')"""


@query("rendered_texts", rf"""
WITH t AS (SELECT doc_id AS id, '# T' || chr(10) || '**b** $x$ ![p](u)' || chr(10) || coalesce(text, '') AS c FROM documents),
f AS (SELECT id, {_SPANS.format("c")} AS spans, regexp_replace(regexp_replace(regexp_replace(c, '!\[([^\]]*)\]\(([^)]+)\)', '', 'g'), '(?s)\$\$\s*(.+?)\s*\$\$', '[\1]', 'g'), '\$[ \t]*([^$\n]+?)[ \t]*\$', '\1', 'g') AS plain FROM t),
b AS (SELECT id, {_SHOWN.format("spans", X.OPTION_STYLE)} AS option, {_BOLD.format(_SHOWN.format("spans", X.FULL_STYLE), r"<b>\1</b>")} AS html, {_BOLD.format("plain", r"\1")} AS plain FROM f),
i AS (SELECT id, option, replace(regexp_replace(html, '\*(.+?)\*', '<i>\1</i>', 'g'), chr(3), '*') AS html, regexp_replace(replace(regexp_replace(plain, '\*(.+?)\*', '\1', 'g'), chr(3), '*'), '(?m)^#{{1,4}}\s+', '', 'g') AS plain FROM b),
h AS (SELECT id, option, plain, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?m)^#### (.+)$', '<h5>\1</h5>', 'g'), '(?m)^### (.+)$', '<h4>\1</h4>', 'g'), '(?m)^## (.+)$', '<h3>\1</h3>', 'g'), '(?m)^# (.+)$', '<h2>\1</h2>', 'g') AS html FROM i)
SELECT id, replace(regexp_replace(regexp_replace(html, '(?m)^- (.+)$', '<li>\1</li>', 'g'), '(?m)^\d+\. (.+)$', '<li>\1</li>', 'g'), chr(10), '<br>') AS "full",
  CASE WHEN length(plain) > 150 THEN left(plain, 150) || '...' ELSE plain END || '<div style="margin-top:4px;">' || {_SHOWN.format("'![p](u)'", X.PREVIEW_STYLE)} || '</div>' AS preview, option FROM h""")
def rendered_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text as the client shows it: in full, as a preview, as an option."""
    c = F.concat(F.lit("# T\n**b** $x$ ![p](u)\n"), F.coalesce("text", F.lit("")))
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.rendered_full(c).alias("full"), X.rendered_preview(c).alias("preview"), X.rendered_option(c).alias("option"))


@query("picture_widths", """
WITH p AS (SELECT p_partkey AS id, (p_size * 37)::BIGINT AS w, (p_partkey % 1900 + 1)::BIGINT AS h FROM part),
u AS (SELECT id, w * 914400 // 96 AS w, h * 914400 // 96 AS h FROM p),
l AS (SELECT id, w, h, CASE WHEN h > 2880000 THEN w * 2880000 // h ELSE w END AS a FROM u),
m AS (SELECT id, w, CASE WHEN h > 8640000 THEN least(a, a * 8640000 // h) ELSE a END AS a FROM l)
SELECT id, w AS natural_width, CASE WHEN a >= 3150000 THEN 3150000 WHEN a <> w THEN a END AS fitted FROM m""")
def picture_widths(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 37, F.col("p_partkey") % 1900 + 1
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.page_units(w.cast("long")).alias("natural_width"), X.fitted_width(w.cast("long"), h.cast("long"), 6_300_000).alias("fitted"))


@query("dates_shown", "SELECT o_orderkey AS practice, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def dates_shown(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("practice"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
