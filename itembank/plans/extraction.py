"""Queries of extraction, reconciled readings, text checks, documents and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itembank.functions import rich
from itembank.functions import text as X
from itembank.operators import dml as D
from itembank.operators import extract as E
from itembank.plans.registry import query
from itembank.sources import tables as T


def _events(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events")


@query("asof_heading", """
WITH h AS (SELECT user_id, ts, event_id AS heading FROM events WHERE event_type = 'signup')
SELECT p.event_id, p.user_id, h.heading FROM events p ASOF LEFT JOIN h ON p.user_id = h.user_id AND p.ts > h.ts WHERE p.event_type <> 'signup'""")
def asof_heading(spark: SparkSession, d: str) -> DataFrame:
    return E.with_heading(_events(spark, d), "user_id", ["ts"], F.col("event_type") == "signup", "event_id").select("event_id", "user_id", "heading")


@query("next_anchor_break", """
WITH a AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_anchor FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, ts AS bt FROM events WHERE event_type = 'error')
SELECT a.event_id, e.event_id AS end_event FROM (
  SELECT a.user_id, a.event_id, coalesce(min(b.bt), a.next_anchor) AS end_at
  FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.bt > a.ts AND (a.next_anchor IS NULL OR b.bt < a.next_anchor) GROUP BY a.user_id, a.event_id, a.next_anchor) a
LEFT JOIN events e ON e.user_id = a.user_id AND e.ts = a.end_at""")
def next_anchor_break(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    ranges = E.anchor_ranges(rows, "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "error")
    ends = rows.select(F.col("user_id").alias("u"), F.col("ts").alias("t"), F.col("event_id").alias("end_event"))
    return ranges.join(ends, F.expr("user_id = u AND end_at = t"), "left").select("event_id", "end_event")


@query("page_expand", """
SELECT event_id, page, CASE WHEN page = p0 THEN y0 ELSE 44 END AS from_y, CASE WHEN page = p1 THEN y1 ELSE 760 END AS to_y
FROM (SELECT event_id, p0, p1, y0, y1, unnest(range(p0, p1 + 1)) AS page FROM (
  SELECT event_id, (event_id % 9)::BIGINT AS p0, (event_id % 9 + user_id % 4)::BIGINT AS p1, 50 + (event_id % 100)::DOUBLE AS y0, 200 + (user_id % 500)::DOUBLE AS y1 FROM events))""")
def page_expand(spark: SparkSession, d: str) -> DataFrame:
    r = _events(spark, d).select("event_id", (F.col("event_id") % 9).alias("p0"), (F.col("event_id") % 9 + F.col("user_id") % 4).alias("p1"), (50 + F.col("event_id") % 100).cast("double").alias("y0"), (200 + F.col("user_id") % 500).cast("double").alias("y1"))
    return E.pages_covered(r, "p0", "p1", "y0", "y1", 44.0, 760.0).select("event_id", "page", "from_y", "to_y")


@query("overlap_join", """
WITH i AS (SELECT event_id, user_id, event_type, value AS x0, value + 4 AS x1 FROM events)
SELECT a.event_id AS l_id, b.event_id AS r_id FROM i a JOIN i b ON a.user_id = b.user_id AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.5
WHERE a.event_type = 'purchase' AND b.event_type = 'view'""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    side = lambda kind, p: rows.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("value").alias(f"{p}0"), (F.col("value") + 4).alias(f"{p}1"))
    return E.overlaps(side("purchase", "l"), side("view", "r"), ["user_id"], 8.0, 0.5).select("l_id", "r_id")


@query("fragments_joined", """
SELECT user_id, event_id // 50 AS line, string_agg(event_type, ' ' ORDER BY value, event_id) AS text FROM events GROUP BY ALL""")
def fragments_joined(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("value", "event_id", "event_type")))
    return _events(spark, d).groupBy("user_id", F.floor(F.col("event_id") / 50).alias("line")).agg(F.array_join(F.transform(parts, lambda p: p["event_type"]), " ").alias("text"))


def paired(spark: SparkSession, d: str) -> DataFrame:
    """key, native, other: every document beside the next one of its source. Ids are put in order without the texts, which then come by id."""
    docs = T.table(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("key"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next"))
    pairs = pairs.join(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("native")), "key")
    return pairs.join(docs.select(F.col("doc_id").alias("next"), F.col("text").alias("other")), "next", "left").select("key", "native", "other")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).where("other IS NOT NULL")


READINGS = "readings AS (SELECT * FROM (SELECT doc_id AS key, text AS native, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents) WHERE other IS NOT NULL)"


@query("token_jaccard", f"""WITH {READINGS},
a AS (SELECT key, token, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(native, '[0-9]+')) AS token FROM readings) GROUP BY ALL),
b AS (SELECT key, token, count(*) AS n FROM (SELECT key, unnest(regexp_extract_all(other, '[0-9]+')) AS token FROM readings) GROUP BY ALL),
j AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.key = b.key AND a.token = b.token)
SELECT r.key, coalesce(sum(least(x, y)), 0)::BIGINT AS shared, coalesce(sum(greatest(x, y)), 0)::BIGINT AS "all", coalesce(round(sum(least(x, y)) / sum(greatest(x, y)), 4), 1.0)::DOUBLE AS agreement
FROM readings r LEFT JOIN j ON j.key = r.key GROUP BY r.key""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    r = _readings(spark, d)
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1))
    return E.token_agreement(r.select("key", "native"), r.select("key", "other"), "key", tokens("native"), tokens("other"))


MEASURED = "SELECT key, native || ' 长 ' || (key % 3) || ' cm，' || (key % 2) || '.5 kg/m3' AS native, other || ' 长 ' || (key % 4) || 'cm ' || (key % 5) || ' N' AS other FROM readings"


@query("unit_conflicts", f"""WITH {READINGS}, measured AS ({MEASURED}),
t AS (SELECT key, 1 AS side, unnest(regexp_extract_all(native, '([0-9]+(?:[.．][0-9]+)?)\\s*([A-Za-z0-9Ω℃³²/%]{{0,8}})')) AS m FROM measured
      UNION ALL SELECT key, 2, unnest(regexp_extract_all(other, '([0-9]+(?:[.．][0-9]+)?)\\s*([A-Za-z0-9Ω℃³²/%]{{0,8}})')) FROM measured),
u AS (SELECT key, side, replace(regexp_extract(m, '^([0-9]+(?:[.．][0-9]+)?)', 1), '．', '.') AS number,
  regexp_extract(m, '^[0-9]+(?:[.．][0-9]+)?\\s*([A-Za-z0-9Ω℃³²/%]{{0,8}})', 1) AS raw FROM t),
v AS (SELECT key, side, number, CASE raw WHEN 'kg/m3' THEN 'kg/m³' WHEN 'g/cm3' THEN 'g/cm³' WHEN 'm3' THEN 'm³' WHEN 'cm3' THEN 'cm³' WHEN 'm2' THEN 'm²' WHEN 'cm2' THEN 'cm²' WHEN 'm/s2' THEN 'm/s²' ELSE raw END AS unit FROM u),
s AS (SELECT key, unit, list(DISTINCT number ORDER BY number) FILTER (WHERE side = 1) AS a, list(DISTINCT number ORDER BY number) FILTER (WHERE side = 2) AS b
  FROM v WHERE list_contains(['V','A','Ω','W','J','N','Pa','Hz','kg','g','mg','m','cm','mm','km','mL','L','s','h','min','m²','cm²','m³','cm³','m/s','m/s²','km/h','kg/m³','g/cm³','℃','%'], unit) GROUP BY ALL)
SELECT key, unit, array_to_string(a, ',') AS native_numbers, array_to_string(b, ',') AS other_numbers,
  len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 AND len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 AS conflict
FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def unit_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = lambda n: (F.col("key") % n).cast("string")
    r = _readings(spark, d).withColumn("native", F.concat("native", F.lit(" 长 "), k(3), F.lit(" cm，"), k(2), F.lit(".5 kg/m3"))).withColumn("other", F.concat("other", F.lit(" 长 "), k(4), F.lit("cm "), k(5), F.lit(" N")))
    out = E.unit_conflicts(r, "key", "native", "other")
    return out.select("key", "unit", F.array_join("native_numbers", ",").alias("native_numbers"), F.array_join("other_numbers", ",").alias("other_numbers"), "conflict")


@query("fusion_verdict", """
WITH s AS (SELECT doc_id AS id, (doc_id % 11) / 10.0::DOUBLE AS native, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 7) / 6.0::DOUBLE END AS ocr, doc_id % 3 = 0 AS conflict, (doc_id % 6)::INT AS warnings FROM documents),
r AS (SELECT id, conflict, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN ocr IS NULL THEN native ELSE 0.6::DOUBLE * native + 0.4::DOUBLE * ocr END - (CASE WHEN conflict THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + 0.03::DOUBLE * least(warnings, 3)))), 4) AS review_score FROM s)
SELECT id, review_score, review_score < 0.85 OR conflict AS needs_review FROM r""")
def fusion_verdict(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    score = X.review_score((i % 11) / 10.0, F.when(i % 4 != 0, (i % 7) / 6.0), i % 3 == 0, (i % 6).cast("int"))
    out = T.table(spark, d, "documents").select(i.alias("id"), (i % 3 == 0).alias("conflict"), score.alias("review_score"))
    return out.select("id", "review_score", ((F.col("review_score") < 0.85) | F.col("conflict")).alias("needs_review"))


@query("native_quality", r"""
SELECT doc_id AS id, CASE WHEN t = '' THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(0.45::DOUBLE, (length(t) - length(replace(replace(t, '%', ''), '$', ''))) * 0.08::DOUBLE)
  - CASE WHEN regexp_matches(t, '^\s*' || (doc_id % 30 + 1) || '\s*[.．、]') THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END - CASE WHEN length(t) < 12 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END), 4) END AS quality
FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN (doc_id % 30 + 1) || '. ' ELSE '' END || text END AS t FROM documents)""")
def native_quality(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d)
    lead = F.when(F.col("id") % 2 == 0, F.concat(F.col("question_number").cast("string"), F.lit(". "))).otherwise("")
    t = F.when(F.col("id") % 9 == 0, "").otherwise(F.concat(lead, "content"))
    return q.select("id", X.native_quality(F.translate(t, "%$", "□□"), F.col("question_number")).alias("quality"))


@query("cleanup_text", r"""
SELECT doc_id AS id, md5(trim(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '. ' || chr(9) || chr(10)) || '□ 2﹣1＝1 第 3 页', '第\s*\d+\s*页', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '�', ''), '□', ''), '﹣', '-'), '＝', '='), ' ' || chr(10) || chr(9))) AS cleaned
FROM documents""")
def cleanup_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.replace("text", F.lit(". "), F.lit(". \t\n")), F.lit("□ 2﹣1＝1 第 3 页"))
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(X.clean_up(text)).alias("cleaned"))


@query("problem_severity", r"""
WITH p AS (SELECT doc_id AS id, text AS t, doc_id % 3 = 0 AS bare, doc_id % 3 = 1 AS hollow, string_split(text, chr(10)) AS lines FROM documents),
f AS (SELECT id, [CASE WHEN length(trim(t)) < 10 THEN 'too_short' END, CASE WHEN contains(t, chr(65533)) THEN 'garbled' END, CASE WHEN NOT bare AND hollow THEN 'empty_options' END,
  CASE WHEN bare AND len(regexp_extract_all(t, '(?m)(?:^|\s)[A-D]\s*[.．、]')) >= 2 THEN 'unparsed_options' END] AS hard,
  [CASE WHEN regexp_matches(t, '\d+[xXyYzZ]\s*[-+=]') THEN 'bare_formula' END,
   CASE WHEN len(list_filter(lines, lambda x: length(trim(x)) BETWEEN 1 AND 4)) > len(lines) * 0.3 THEN 'split_lines' END] AS soft FROM p),
g AS (SELECT id, list_filter(hard, lambda x: x IS NOT NULL) AS hard, list_filter(soft, lambda x: x IS NOT NULL) AS soft FROM f)
SELECT id, CASE WHEN len(hard) > 0 THEN 'needs_ai' WHEN len(soft) > 0 THEN 'needs_fix' ELSE 'good' END AS severity, array_to_string(list_concat(hard, soft), ',') AS problems FROM g""")
def problem_severity(spark: SparkSession, d: str) -> DataFrame:
    option = lambda text: F.struct(F.lit("A").alias("label"), F.lit(text).alias("content"))
    options = F.when(F.col("doc_id") % 3 == 1, F.array(option("x"), option(" "))).when(F.col("doc_id") % 3 == 2, F.array(option("x"), option("y")))
    out = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.problems(F.col("text"), options).alias("p"))
    return out.select("id", "p.severity", F.array_join("p.problems", ",").alias("problems"))


@query("type_correction", r"""
WITH t AS (SELECT doc_id AS id, text AS content, CASE doc_id % 5 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'fill_blank' WHEN 2 THEN NULL WHEN 3 THEN 'unknown' ELSE 'multiple_choice' END AS kind, doc_id % 2 = 0 AS choice,
  CASE doc_id % 4 WHEN 0 THEN '一、单项选择题' WHEN 1 THEN '二、填空' WHEN 2 THEN '三、解答题' ELSE '实验' END AS title FROM documents)
SELECT id, CASE WHEN choice THEN CASE WHEN kind = 'fill_blank' OR kind IS NULL THEN 'single_choice' ELSE kind END
  WHEN kind IN ('single_choice', 'multiple_choice') THEN CASE WHEN contains(content, '___') OR contains(content, '()') OR contains(content, '(  )') THEN 'fill_blank' WHEN contains(content, '(1)') OR length(content) > 150 THEN 'comprehensive' ELSE 'fill_blank' END
  ELSE coalesce(kind, 'unknown') END AS corrected,
  CASE WHEN contains(title, '选择题') THEN 'single_choice' WHEN contains(title, '填空') THEN 'fill_blank' WHEN contains(title, '解答') THEN 'comprehensive' ELSE 'experiment' END AS announced
FROM t""")
def type_correction(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "single_choice").when(i % 5 == 1, "fill_blank").when(i % 5 == 3, "unknown").when(i % 5 == 4, "multiple_choice")
    option = F.struct(F.lit("A").alias("label"), F.lit("x").alias("content"))
    title = F.when(i % 4 == 0, "一、单项选择题").when(i % 4 == 1, "二、填空").when(i % 4 == 2, "三、解答题").otherwise("实验")
    options = F.when(i % 2 == 0, F.array(option, option)).otherwise(F.array(option))
    return T.table(spark, d, "documents").select(i.alias("id"), X.corrected_type(kind, F.col("text"), options).alias("corrected"), X.section_type(title).alias("announced"))


@query("source_selection", """
WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN '���' || text ELSE text END AS native, CASE WHEN doc_id % 7 <> 0 THEN 'read: ' || text END AS ocr, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents)
SELECT id, CASE WHEN length(native) - length(replace(native, '�', '')) >= 3 AND coalesce(ocr, '') <> '' THEN ocr WHEN native <> '' AND score >= 0.7 THEN native WHEN coalesce(ocr, '') <> '' THEN ocr ELSE native END AS selected FROM s""")
def source_selection(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("doc_id"), F.col("text")
    native = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit(X.GARBLED * 3), t)).otherwise(t)
    return T.table(spark, d, "documents").select(i.alias("id"), X.selected_text(native, F.when(i % 7 != 0, F.concat(F.lit("read: "), t)), (i % 10) / 10.0).alias("selected"))


GONE = "|".join(rf"<\s*{tag}\b[^>]*>.*?</\s*{tag}\s*>" for tag in ("script", "style", "iframe", "object", "embed"))


@query("sanitize_html", rf"""
WITH s AS (SELECT page_id, coalesce(html, '') || '<IMG src="/p/' || page_id || '.png" onload=go() style="Color: red; position: fixed; margin-top: ' || (page_id % 9) || 'px; color: url(x)"><p class="x" style="text-align:center">end</p><a href="javascript:x()">' AS t FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is){GONE}', '', 'g'), '(?i)\s+on[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g'), '(?i)javascript:', '', 'g') AS t FROM s),
m AS (SELECT page_id, string_split(regexp_replace(t, '<(/)?([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z_:][-\w:.]*=(?:"[^"]*"|''[^'']*''|[^\s>]+))*)\s*/?>', chr(1) || chr(2) || '\1' || chr(2) || '\2' || chr(2) || '\3' || chr(1), 'g'), chr(1)) AS parts FROM c),
p AS (SELECT page_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS t FROM m),
q AS (SELECT page_id, i, t, starts_with(t, chr(2)) AS tag, string_split(t, chr(2))[2] AS slash, lower(string_split(t, chr(2))[3]) AS name, string_split(t, chr(2))[4] AS attrs FROM p),
k AS (SELECT *, list_contains({sorted(rich.TAGS)}, name) AS known, list_transform(list_filter(string_split(regexp_extract(attrs, '(?i)style="([^"]*)"', 1), ';'), lambda x: contains(x, ':')),
  lambda x: {{'p': lower(trim(left(x, strpos(x, ':') - 1))), 'v': trim(substr(x, strpos(x, ':') + 1))}}) AS css FROM q),
r AS (SELECT *, array_to_string(list_transform(list_filter(css, lambda x: list_contains({sorted(rich.STYLES)}, x.p) AND x.v <> '' AND NOT regexp_matches(x.v, '(?i)url\(|expression\(|javascript')), lambda x: x.p || ': ' || x.v), '; ') AS style FROM k)
SELECT page_id, coalesce(string_agg(CASE WHEN NOT tag THEN t WHEN slash = '/' THEN '</' || CASE WHEN known THEN name ELSE 'span' END || '>'
  ELSE '<' || CASE WHEN known THEN name ELSE 'span' END || CASE WHEN name = 'img' THEN array_to_string(list_transform(regexp_extract_all(attrs, '(?i)src=("[^"]*"|''[^'']*'')', 1), lambda x: ' src=' || x), '') ELSE '' END
    || CASE WHEN known AND style <> '' THEN ' style="' || style || '"' ELSE '' END || '>' END, '' ORDER BY i), '') AS clean FROM r GROUP BY 1""")
def sanitize_html(spark: SparkSession, d: str) -> DataFrame:
    """Every page without what could run or disturb, with a picture, a style and an address added that hold something of each."""
    i = F.col("page_id").cast("string")
    more = F.concat(F.lit('<IMG src="/p/'), i, F.lit('.png" onload=go() style="Color: red; position: fixed; margin-top: '), (F.col("page_id") % 9).cast("string"), F.lit('px; color: url(x)"><p class="x" style="text-align:center">end</p><a href="javascript:x()">'))
    return T.table(spark, d, "pages").select("page_id", rich.sanitized(F.concat(F.coalesce("html", F.lit("")), more)).alias("clean"))


@query("parse_options", r"""
WITH t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text || chr(10) || 'A. 1' || chr(10) || 'B. 2' || chr(10) || 'C. ' || left(text, 10), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g') AS body FROM documents),
m AS (SELECT id, string_split(regexp_replace(trim(body, ' ' || chr(9) || chr(10) || chr(13)), '(?m)(?:^|\s)([A-D])\s*[.．、]\s*', chr(1) || '\1', 'g'), chr(1)) AS parts FROM t),
o AS (SELECT id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM m),
g AS (SELECT id, left(part, 1) AS label, min(i) AS place, arg_max(regexp_replace(trim(substr(part, 2), ' ' || chr(9) || chr(10) || chr(13)), '\s*\n\s*', ' ', 'g'), i) AS content FROM o WHERE i > 1 GROUP BY ALL),
l AS (SELECT id, string_agg(label || '=' || content, ';' ORDER BY place) AS options FROM g GROUP BY 1)
SELECT m.id, CASE WHEN parts IS NOT NULL THEN 3 END AS score, trim(coalesce(parts[1], ''), ' ' || chr(9) || chr(10) || chr(13)) AS stem, coalesce(options, '') AS options FROM m LEFT JOIN l ON l.id = m.id""")
def parse_options(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat((F.col("doc_id") % 30 + 1).cast("string"), F.lit(". (3 分) "), "text", F.lit("\nA. 1\nB. 2\nC. "), F.substring("text", 1, 10))
    p = rich.parsed_question(F.regexp_replace(text, r"\(3 分\)", "（3 分）"))
    out = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), p.alias("p"))
    return out.select("id", "p.score", "p.stem", F.array_join(F.transform("p.options", lambda o: F.concat(o["label"], F.lit("="), F.coalesce(o["content"], F.lit("")))), ";").alias("options"))


@query("strip_options", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || 'A. 1' || chr(10) || chr(10) || 'B．2' || chr(10) || 'end', chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || 'A. 1' || chr(10) || chr(10) || 'B．2' || chr(10) || 'end', chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
o AS (SELECT *, t = '选项' OR starts_with(t, 'A.') OR starts_with(t, 'A ') OR starts_with(t, 'A．') OR starts_with(t, 'B.') OR starts_with(t, 'B ') OR starts_with(t, 'B．') AS option FROM k),
s AS (SELECT *, last_value(CASE WHEN option THEN 1 WHEN t <> '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM o)
SELECT doc_id AS id, md5(regexp_replace(trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10) || chr(9)), '\n{3,}', chr(10) || chr(10), 'g')) AS body
FROM s WHERE NOT option AND (t <> '' OR coalesce(inside, 0) = 0) GROUP BY 1""")
def strip_options(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit("\nA. 1\n\nB．2\nend"))
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(rich.body_without_options(text, F.lit('[{"label":"A"},{"label":"B"}]'))).alias("body"))


#: Texts in parts: lines, display formulas (behind chr(2)) and what is between them, and inside that inline formulas (behind chr(2)). Dollars beside
#: dollars open and close nothing: they are chr(3) while inline formulas are looked for. good: has text and balanced braces, so that it is a formula.
FORMULAS = r"""
l AS (SELECT id, generate_subscripts(ls, 1) AS line, unnest(ls) AS t FROM (SELECT id, string_split(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS ls FROM source)),
p AS (SELECT id, line, generate_subscripts(ps, 1) AS part, unnest(ps) AS t FROM (SELECT id, line, string_split(regexp_replace(t, '\$\$([^$]+)\$\$|\\\[(.+?)\\\]', chr(1) || chr(2) || '\1\2' || chr(1), 'g'), chr(1)) AS ps FROM l)),
d AS (SELECT id, line, part, starts_with(t, chr(2)) AS display, trim(ltrim(t, chr(2)), ' ' || chr(9) || chr(13)) AS latex, t FROM p),
g AS (SELECT *, latex <> '' AND length(replace(latex, '{', '')) = length(replace(latex, '}', '')) AS good FROM d),
x AS (SELECT id, line, part, regexp_replace(regexp_replace(t, '\$\$', chr(3) || chr(3), 'g'), chr(3) || '\$', chr(3) || chr(3), 'g') AS t FROM g WHERE NOT display),
i AS (SELECT id, line, part, generate_subscripts(ps, 1) AS piece, unnest(ps) AS t FROM (SELECT id, line, part, string_split(regexp_replace(t, '(^|[^\d$\x03])(?:\$([^$\x03]+)\$|\\\((.+?)\\\))', '\1' || chr(1) || chr(2) || '\2\3' || chr(1), 'g'), chr(1)) AS ps FROM x)),
n AS (SELECT id, line, part, piece, t, starts_with(t, chr(2)) AS inline, trim(ltrim(t, chr(2)), ' ' || chr(9) || chr(13)) AS latex FROM i),
f AS (SELECT *, latex <> '' AND length(replace(latex, '{', '')) = length(replace(latex, '}', '')) AS good FROM n)"""


@query("math_segments", f"""WITH source AS (SELECT doc_id AS id, text AS content FROM documents), {FORMULAS},
a AS (SELECT id, line, part, 0 AS piece, 'display' AS kind, latex, good FROM g WHERE display UNION ALL SELECT id, line, part, piece, 'inline', latex, good FROM f WHERE inline),
c AS (SELECT id, count(*) FILTER (good AND kind = 'inline') AS inline, count(*) FILTER (good AND kind = 'display') AS display, count(*) FILTER (NOT good) AS warnings,
  string_agg(kind || ': ' || latex, chr(10) ORDER BY line, part, piece) FILTER (good) AS formulas FROM a GROUP BY 1)
SELECT s.id, coalesce(inline, 0)::INT AS inline, coalesce(display, 0)::INT AS display, coalesce(warnings, 0)::INT AS warnings, coalesce(formulas, '') AS formulas FROM source s LEFT JOIN c ON c.id = s.id""")
def math_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every text's formulas in reading order, how many there are of each kind, and how many spellings stayed text."""
    made = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), rich.to_document("text", F.lit(None).cast("string"), F.lit("essay")).alias("m"))
    node = "type: string, attrs: struct<latex: string>"
    nodes = F.from_json("m.doc", f"struct<content: array<struct<{node}, content: array<struct<{node}>>>>>")["content"]
    segment = lambda n: F.struct(F.regexp_extract(n["type"], "^(inline|display)Formula$", 1).alias("kind"), n["attrs"]["latex"].alias("latex"))
    inner = lambda n: F.transform(F.coalesce(n["content"], F.array()), segment)
    segments = F.filter(F.flatten(F.transform(nodes, lambda n: F.concat(F.array(segment(n)), inner(n)))), lambda x: x["kind"] != "")
    found = made.select("id", segments.alias("found"), F.size("m.warnings").alias("warnings"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind))
    formulas = F.array_join(F.transform("found", lambda x: F.concat(x["kind"], F.lit(": "), x["latex"])), "\n")
    return found.select("id", count("inline").alias("inline"), count("display").alias("display"), "warnings", formulas.alias("formulas"))


@query("unit_lint", r"""
WITH d AS (SELECT doc_id AS id, text || ' 长 5 cm' || (2 + doc_id % 3) || '，3.5mm，1' || CASE WHEN doc_id % 2 = 0 THEN '.x' ELSE 'kgkg' END AS t FROM documents),
v AS (SELECT unnest(['kg/m3', 'g/cm3', 'm3', 'cm3', 'm2', 'cm2', 'm/s2']) AS v),
r AS (SELECT id, unnest(regexp_extract_all(t, '\d+(?:[.．]\d+)?\s*[A-Za-zΩ]+')) AS m FROM d),
u AS (SELECT id, m, regexp_extract(m, '[A-Za-zΩ]+$') AS unit FROM r)
SELECT id, 'superscript:' || v AS warning FROM d, v WHERE regexp_matches(t, '(^|[^A-Za-z/])' || v || '($|[^A-Za-z0-9])')
UNION ALL SELECT id, 'doubled:' || m FROM u WHERE length(unit) IN (2, 4, 6) AND left(unit, length(unit) // 2) = right(unit, length(unit) // 2)
UNION ALL SELECT id, 'decimal:' || unnest(regexp_extract_all(t, '\d\.[A-Za-z]')) FROM d""")
def unit_lint(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat("text", F.lit(" 长 5 cm"), (2 + i % 3).cast("string"), F.lit("，3.5mm，1"), F.when(i % 2 == 0, ".x").otherwise("kgkg"))
    return T.table(spark, d, "documents").select(i.alias("id"), F.explode_outer(X.unit_warnings(text)).alias("warning")).where("warning IS NOT NULL")  # not explode: its inferred size filter would match all patterns again


@query("block_tokenize", r"""
, b AS (SELECT id, question_type, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM questions),
l AS (SELECT id, list_filter([{'type': 'text', 'content': t, 'style': NULL}, {'type': 'image', 'content': 'asset://p/1.png', 'style': '{"align": "center", "width": "fit"}'}, {'type': 'text', 'content': 'tail', 'style': NULL},
  {'type': 'options', 'content': '[{"label": "A", "content": "x"}]', 'style': NULL},
  {'type': 'answer_space', 'content': NULL, 'style': '{"rows": ' || CASE question_type WHEN 'single_choice' THEN 0 WHEN 'fill_blank' THEN 2 WHEN 'calculation' THEN 8 WHEN 'essay' THEN 6 ELSE 4 END || '}'}], lambda x: x.type <> 'text' OR x.content <> '') AS bs FROM b),
n AS (SELECT id, (generate_subscripts(bs, 1) - 1)::INT AS position, unnest(bs) AS x FROM l)
SELECT id, position, x.type AS type, x.content AS content, x.style AS style FROM n""", bank=True)
def block_tokenize(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d)
    content = F.concat("content", F.lit("![图](asset://p/1.png) tail"))
    return q.select("id", F.posexplode(rich.block_tokens(content, F.lit('[{"label":"A","content":"x"}]'), "question_type")).alias("position", "b")).select("id", "position", "b.*")


@query("doc_roundtrip", r"""
, c AS (SELECT id, question_type, array_to_string(list_transform(string_split(translate(content, '$' || chr(92), ''), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), chr(10)) AS lines FROM questions),
l AS (SELECT id, list_filter([{'type': 'text', 'content': trim(lines || chr(10) || 'see$x^2$here' || chr(10) || '$$y$$', ' ' || chr(10)), 'style': NULL}, {'type': 'image', 'content': 'asset://p/1.png', 'style': '{"align": "center", "width": "fit"}'},
  {'type': 'text', 'content': 'tail', 'style': NULL}, {'type': 'options', 'content': '[{"label": "A", "content": "x$z$"}, {"label": "?", "content": ""}]', 'style': NULL},
  {'type': 'answer_space', 'content': NULL, 'style': '{"rows": ' || CASE question_type WHEN 'single_choice' THEN 0 WHEN 'fill_blank' THEN 2 WHEN 'calculation' THEN 8 WHEN 'essay' THEN 6 ELSE 4 END || '}'}], lambda x: true) AS bs FROM c),
n AS (SELECT id, (generate_subscripts(bs, 1) - 1)::INT AS position, unnest(bs) AS x FROM l)
SELECT id, true AS same, 0 AS errors, position, x.type AS type, x.content AS content, x.style AS style FROM n""", bank=True)
def doc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that a document made of a question gives back, one a row. Texts lose dollars and backslashes here and get formulas, a picture and options of their own."""
    content = F.concat(F.translate("content", "$\\", ""), F.lit("\nsee $ x^2 $ here\n $$y$$ \n![图](asset://p/1.png) tail"))
    trip = rich.there_and_back(content, F.lit('[{"label":"A","content":"x $z$"},{}]'), "question_type")
    q = T.questions(spark, d).select("id", trip.alias("t"))
    return q.select("id", "t.same", "t.errors", F.posexplode("t.blocks").alias("position", "b")).select("id", "same", "errors", "position", "b.*")


@query("doc_validate", """
SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'version 2' END, CASE WHEN contains(text, ' the ') THEN '1: inline link' END, CASE WHEN lang <> 'en' THEN '1: mark ' || lang END,
    CASE doc_id % 3 WHEN 0 THEN '2: block video' WHEN 1 THEN '2: width 500' END], lambda x: x IS NOT NULL), '; ') AS errors, (doc_id % 3 = 1)::INT AS patched
FROM documents""")
def doc_validate(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with texts as documents that carry an unknown inline node, mark or block, a bad width or a bad version."""
    inline = F.struct(F.when(F.contains("text", F.lit(" the ")), "link").otherwise("text").alias("type"), "text", F.array(F.struct(F.when(F.col("lang") != "en", F.col("lang")).otherwise("bold").alias("type"))).alias("marks"))
    said = F.to_json(F.struct(F.lit("paragraph").alias("type"), F.array(inline).alias("content")))
    bad = F.when(F.col("doc_id") % 3 == 0, '{"type": "video"}').when(F.col("doc_id") % 3 == 1, '{"type": "image", "attrs": {"src": "a", "width": 500}}').otherwise('{"type": "paragraph", "content": []}')
    doc = F.concat(F.lit('{"type": "doc", "schema_version": '), F.when(F.col("doc_id") % 5 == 0, "2").otherwise("1"), F.lit(', "content": ['), said, F.lit(", "), bad, F.lit("]}"))
    rows = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), rich.checked(doc).alias("found"))
    return rows.select("id", F.array_join("found.errors", "; ").alias("errors"), "found.patched")


@query("doc_html", f""", source AS (SELECT id, content FROM questions), {FORMULAS},
e AS (SELECT id, line, part, replace(string_agg(CASE WHEN inline THEN '$' || CASE WHEN good THEN latex ELSE ltrim(t, chr(2)) END || '$' ELSE latex END, '' ORDER BY piece), chr(3), '$') AS said FROM f GROUP BY ALL),
b AS (SELECT g.id, g.line, g.part, g.display AND g.good AS alone, CASE WHEN g.display AND NOT g.good THEN '$$' || ltrim(g.t, chr(2)) || '$$' WHEN g.display THEN g.latex ELSE e.said END AS said,
  g.display OR g.latex <> '' AS filled FROM g LEFT JOIN e ON e.id = g.id AND e.line = g.line AND e.part = g.part),
h AS (SELECT *, replace(replace(replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS safe
  FROM (SELECT *, bool_or(filled) OVER (PARTITION BY id, line) AS any_filled FROM b) WHERE filled OR NOT any_filled),
r AS (SELECT *, sum(alone::INT) OVER (PARTITION BY id ORDER BY line, part) AS run FROM h),
m AS (SELECT id, run, alone, string_agg(safe, '<br>' ORDER BY line, part) AS said FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY id, alone ORDER BY run) AS k FROM m),
t AS (SELECT o.id, bool_or(NOT alone) AS used, string_agg(CASE WHEN alone THEN '<div class="q-formula">$$' || said || '$$</div>'
    ELSE '<div class="q-text">' || CASE WHEN k = 1 THEN '<b>' || question_number || '. </b>' ELSE '' END || said || '</div>' END, '' ORDER BY run, alone DESC) AS said
  FROM o JOIN questions q ON q.id = o.id WHERE trim(q.content, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1)
SELECT q.id, CASE WHEN t.used THEN '' ELSE '<div class="q-text"><b>' || question_number || '. </b></div>' END || coalesce(said, '') || '<div class="answer-space">' ||
  repeat('<div class="space-line"></div>', CASE question_type WHEN 'single_choice' THEN 0 WHEN 'fill_blank' THEN 2 WHEN 'calculation' THEN 8 WHEN 'essay' THEN 6 ELSE 4 END) || '</div>' AS html
FROM questions q LEFT JOIN t ON t.id = q.id""", bank=True)
def doc_html(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d).select("id", "question_number", rich.to_document("content", F.lit(None).cast("string"), "question_type")["doc"].alias("doc"))
    return q.select("id", rich.rendered("doc", F.concat(F.col("question_number").cast("string"), F.lit(". "))).alias("html"))


@query("anchor_sequence", """
WITH RECURSIVE c AS (SELECT l_orderkey AS paper, l_partkey % 5 AS page, l_extendedprice AS y, l_linenumber::BIGINT AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 5, l_extendedprice, l_linenumber) AS place FROM lineitem),
r AS (SELECT paper, number, [place] AS run, 10 AS score, 0 AS skipped FROM c WHERE number = 1
  UNION ALL SELECT c.paper, c.number, list_prepend(c.place, r.run), r.score + 11 + r.number - c.number, r.skipped + c.number - r.number - 1 FROM r JOIN c ON c.paper = r.paper AND c.number > r.number AND c.place > r.run[1]),
b AS (SELECT paper, run FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, len(run) DESC, skipped, number DESC, run) AS k FROM r) WHERE k = 1)
SELECT c.paper, c.page, c.y, c.number FROM c JOIN b ON b.paper = c.paper AND list_contains(b.run, c.place)""")
def anchor_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), (F.col("l_partkey") % 5).alias("page"), F.col("l_extendedprice").alias("y"), F.col("l_linenumber").cast("long").alias("number"))
    return E.chosen_anchors(rows, "paper", "page", "y", "number")


@query("answer_blocks", r"""
WITH l AS (SELECT conv_id AS paper, turn, CASE WHEN role = 'user' THEN (turn % 3 + 1) || '. ' || CASE WHEN turn % 2 = 0 THEN '【答案】' ELSE '故选：' END || 'AB' ELSE 'x' || turn END AS t FROM conversations),
n AS (SELECT *, nullif(regexp_extract(t, '^\s*(\d{1,2})\s*[.．、]', 1), '')::INT AS number FROM l),
b AS (SELECT *, sum((number IS NOT NULL)::INT) OVER (PARTITION BY paper ORDER BY turn) AS block FROM n),
g AS (SELECT paper, block, max(number) AS number, string_agg(trim(CASE WHEN number IS NOT NULL THEN regexp_replace(t, '^\s*\d{1,2}\s*[.．、]', '') ELSE t END), chr(10) ORDER BY turn) AS body FROM b WHERE block > 0 GROUP BY ALL)
SELECT paper, number, body, coalesce(nullif(trim(regexp_extract(body, '【答案】([^\n]*)', 1)), ''), nullif(regexp_extract(body, '故选[：:]\s*([A-D]{1,4})', 1), '')) AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY paper, number ORDER BY block) AS rn FROM g) WHERE rn = 1""")
def answer_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat((F.col("turn") % 3 + 1).cast("string"), F.lit(". "), F.when(F.col("turn") % 2 == 0, "【答案】").otherwise("故选："), F.lit("AB"))
    lines = T.table(spark, d, "conversations").select(F.col("conv_id").alias("paper"), "turn", F.when(F.col("role") == "user", said).otherwise(F.concat(F.lit("x"), F.col("turn").cast("string"))).alias("t"))
    return E.answer_blocks(lines, "paper", "turn", "t")


@query("dml_soft_delete", "SELECT id, is_deleted OR id % 4 = 0 AS is_deleted, id % 4 = 0 AND NOT is_deleted AS changed FROM questions", bank=True)
def dml_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return D.soft_deleted(T.questions(spark, d), F.col("id") % 4 == 0).select("id", "is_deleted", "changed")


@query("dml_tag_batch", "SELECT question_id, tag_id FROM links WHERE NOT (question_id % 3 = 0 AND tag_id = 'toxic') UNION SELECT id, 'hard' FROM questions WHERE difficulty = 5", bank=True)
def dml_tag_batch(spark: SparkSession, d: str) -> DataFrame:
    q, links = T.questions(spark, d), T.question_tags(spark, d)
    return D.not_tagged(D.tagged(links, q.where("difficulty = 5"), ["hard"]), q.where("id % 3 = 0"), ["toxic"])


@query("dml_cascade", "SELECT c_custkey % 7 = 3 AS gone, count(*) AS customers, (SELECT count(*) FROM orders WHERE o_custkey % 7 <> 3) AS orders_left, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 7 <> 3) AS items_left FROM customer WHERE c_custkey % 7 <> 3 GROUP BY 1")
def dml_cascade(spark: SparkSession, d: str) -> DataFrame:
    customers = T.table(spark, d, "customer")
    c, o, li = D.cascade(customers, [(T.table(spark, d, "orders"), "o_custkey", "o_orderkey"), (T.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")], F.col("c_custkey") % 7 == 3, "c_custkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    long = count(c, "customers").unionByName(count(o, "orders_left")).unionByName(count(li, "items_left"))
    wide = long.groupBy(F.lit(False).alias("gone")).pivot("name", ["customers", "orders_left", "items_left"]).agg(F.first("n"))
    return wide.select("gone", "customers", "orders_left", "items_left")


@query("job_transitions", """
SELECT event_id, before, before IS NULL OR (before, event_type) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('click', 'error')) AS allowed
FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    allowed = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "error")]
    return D.transitions(_events(spark, d), "user_id", "event_type", "ts", "event_id", allowed=allowed).select("event_id", "before", "allowed")


@query("job_current_state", "SELECT user_id, arg_max(event_type, ts) AS status, count(*) AS events FROM events GROUP BY 1")
def job_current_state(spark: SparkSession, d: str) -> DataFrame:
    return D.current_state(_events(spark, d), "user_id", "event_type", "ts").select("user_id", "status", "events")


@query("dml_patch_review", """
SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE difficulty END AS difficulty, CASE WHEN id % 10 = 0 THEN 'rejected' ELSE review_status END AS review_status FROM questions""", bank=True)
def dml_patch_review(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d)
    patch = q.where("id % 6 = 0").select("id", F.lit(None).cast("int").alias("difficulty"), F.lit(True).alias("difficulty_set"))
    return D.reviewed(D.patched(q, patch, "id"), F.col("id") % 10 == 0, approve=False).select("id", "difficulty", "review_status")


@query("dml_accept_suggestions", """
SELECT question_id, tag_id FROM links UNION SELECT doc_id, t FROM (SELECT doc_id, unnest(['quality', 'toxic', 'new']) AS t FROM documents WHERE doc_id % 5 >= 3) WHERE t IN (SELECT tag_id FROM links)""", bank=True)
def dml_accept_suggestions(spark: SparkSession, d: str) -> DataFrame:
    q, links = T.questions(spark, d), T.question_tags(spark, d)
    suggested = q.select("id", F.lit(3).alias("difficulty"), F.lit("essay").alias("question_type"), F.array(F.lit("quality"), F.lit("toxic"), F.lit("new")).alias("tag_ids"), (F.col("id") % 5 / 6).alias("confidence"))
    return D.suggestions_accepted(q, links, suggested, links.select("tag_id").distinct())[1]


@query("asset_urls", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'see /api/ocr-assets/' || source || '/f.png' ELSE 'see asset://practice/p/f.png' END AS content FROM documents")
def asset_urls(spark: SparkSession, d: str) -> DataFrame:
    ref = F.when(F.col("id") % 2 == 0, "see asset://f.png").otherwise("see asset://practice/p/f.png")
    return T.questions(spark, d).select("id", X.asset_urls(ref, F.col("source_id")).alias("content"))


@query("positional_zip", """
SELECT c.conv_id, c.turn AS at, c.role AS item, CASE WHEN c.turn < n - 1 THEN 'r' || c.turn END AS result
FROM conversations c JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) k ON k.conv_id = c.conv_id""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    turns = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    inputs = turns.select("conv_id", F.transform("t", lambda x: x["role"]).alias("items"))
    results = turns.select("conv_id", F.transform(F.slice("t", 1, F.size("t") - 1), lambda x: F.concat(F.lit("r"), x["turn"].cast("string"))).alias("found"))
    return E.zipped(inputs, results, "conv_id", "items", "found").select("conv_id", F.col("at").cast("long").alias("at"), "item", "result")


@query("mean_confidence", """
SELECT user_id, coalesce(string_agg(CASE WHEN event_type <> 'error' THEN event_type END, chr(10) ORDER BY event_id), '') AS text, coalesce(round(avg(value) FILTER (WHERE event_type <> 'error'), 4), 0)::DOUBLE AS confidence
FROM events GROUP BY 1""")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    lines = _events(spark, d).withColumn("t", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" "))
    return E.mean_confidence(lines, "user_id", "t", "value", "event_id")


@query("suggestions_or_default", """
SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 2 = 0 THEN 'toxic,quality' ELSE 'quality' END AS tags, CASE WHEN id % 3 = 0 THEN 0 ELSE (id % 10) / 10 END::DOUBLE AS confidence FROM questions""", bank=True)
def suggestions_or_default(spark: SparkSession, d: str) -> DataFrame:
    q = T.questions(spark, d)
    tags = F.when(F.col("id") % 2 == 0, F.array(F.lit("toxic"), F.lit("new"), F.lit("quality"))).otherwise(F.array(F.lit("new"), F.lit("quality")))
    suggested = q.where("id % 3 <> 0").select("id", tags.alias("tag_ids"), (F.col("id") % 10 / 10).alias("confidence"))
    known = T.question_tags(spark, d).select("tag_id").distinct()
    return D.suggestions_or_default(q, suggested, known).select("id", F.array_join("tags", ",").alias("tags"), "confidence")


@query("migration_report", """
WITH p AS (SELECT conv_id, bool_or(turn = 5 AND role <> 'system') AS broken, count(*) FILTER (WHERE role = 'system') AS images FROM conversations GROUP BY 1)
SELECT NOT broken AS ok, CASE WHEN broken THEN 'JSONDecodeError' END AS error, count(*) AS practices, sum(CASE WHEN broken THEN 0 ELSE images END)::BIGINT AS images FROM p GROUP BY 1, 2""")
def migration_report(spark: SparkSession, d: str) -> DataFrame:
    """How many practices' blocks become valid documents, how many don't, and how many pictures got a layout."""
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    block = F.when(F.col("role") == "system", '{"type": "image", "content": "asset://a.png"}').when(F.col("turn") == 5, '{"type"').otherwise(F.concat(F.lit('{"type": "text", "content": '), said.substr(F.lit(6), F.length(said) - 6), F.lit("}")))
    parts = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    rows = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["b"]), ","), F.lit("]")).alias("blocks"))
    m = rows.select("conv_id", rich.migrated("blocks").alias("m"))
    return m.groupBy("m.ok", F.col("m.error").alias("error")).agg(F.count("*").alias("practices"), F.sum("m.images").alias("images"))
