"""Rectangles, answers inside lines, mixed JSON, batches and reports, changes of blocks, layouts and groups written back."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from itembank.operators import extract as E
from itembank.operators import workbook as W
from itembank.sources import files


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_pictures_meet_questions_in_both_axes(spark):
    rng = random.Random(8)
    pictures = [(rng.randrange(3), rng.randrange(6), i, *(x := (rng.uniform(-300, 900), rng.uniform(-300, 900))), x[0] + rng.uniform(10, 500), x[1] + rng.uniform(10, 500)) for i in range(150)]
    segments = [(q, s, (q + s) % 3, *(x := (rng.uniform(-200, 800), rng.uniform(-200, 800))), x[0] + rng.uniform(0, 700), x[1] + rng.uniform(0, 700)) for q in range(25) for s in range(2)]
    expected = []
    for q in range(25):
        seen, number = set(), 0
        for _, s, page, x0, y0, x1, y1 in sorted(r for r in segments if r[0] == q):
            here = []
            for p, xref, place, a0, b0, a1, b1 in sorted((r for r in pictures if r[0] == page), key=lambda r: r[2]):
                part = (max(a0, x0), max(b0, y0), min(a1, x1), min(b1, y1))
                if xref not in seen and a1 - a0 >= 40 and b1 - b0 >= 40 and part[2] > part[0] and part[3] > part[1]:
                    number += 1
                    here.append(xref)
                    expected.append((q, number, xref, page, *part))
            seen.update(here)
    a = spark.createDataFrame(pictures, "page int, xref int, place int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(segments, "question int, segment int, page int, x0 double, y0 double, x1 double, y1 double")
    for cell in (50.0, 200.0, 5000.0):
        assert rows(E.figures(a, b, cell), "question", "figure", "xref", "page", "x0", "y0", "x1", "y1") == sorted(expected, key=lambda r: tuple((False, str(x)) for x in r))


def test_rectangles_that_only_touch_share_nothing(spark):
    box = "page int, xref int, place int, x0 double, y0 double, x1 double, y1 double"
    pictures = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 2, 50.0, 50.0, 89.0, 500.0), (2, 1, 1, 0.0, 0.0, 100.0, 100.0)], box)
    segment = spark.createDataFrame([(7, 0, 1, 100.0, 0.0, 300.0, 300.0), (8, 0, 1, 60.0, 60.0, 61.0, 61.0), (9, 0, 1, 5.0, 5.0, 5.0, 50.0)], "question int, segment int, page int, x0 double, y0 double, x1 double, y1 double")
    assert rows(E.figures(pictures, segment), "question", "xref", "x0", "x1") == [(8, 1, 60.0, 61.0)]


def test_rows_dealt_to_cells_are_never_broadcast(spark):
    """However small the planner takes them to be."""
    box = lambda low, high, more: spark.range(1, 2).selectExpr("id AS page", *[f"{low}D AS {c}0" for c in "xy"], *[f"{high}D AS {c}1" for c in "xy"], *more)
    pictures, segments = box(0, 100, ["1 AS xref", "1 AS place"]), box(50, 300, ["7 AS question", "0 AS segment"])
    lines = E.overlaps(pictures.selectExpr("page", "1 AS l_id", "x0 AS l0", "x1 AS l1"), segments.selectExpr("page", "7 AS r_id", "x0 AS r0", "x1 AS r1"), ["page"], 8.0)
    for found in (E.figures(pictures, segments), lines):
        assert found.count() == 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_text_before_an_anchor_belongs_to_the_answer_before(spark):
    pages = [(1, 1, "intro\n 1.（4分）【答案】A \n more\n\n一、选择\nend of one （多选） 2、 ( 3 分 ) 解"), (1, 2, "第 2 页（共 3 页）\nover the page\n3．【答案】\n故选：BD"), (1, 3, "4. no bracket\n1．（2分）again"), (2, 1, "nothing\n"), (3, 1, None), (4, 1, "5.（1分）")]
    found = E.split_answers(spark.createDataFrame(pages, "paper int, page int, t string"), "paper", "page", "t")
    assert rows(found, "paper", "number", "page", "blocks", "answer", "analysis") == [
        (1, 1, 1, 2, "A", "【答案】A\nmore\nend of one"), (1, 2, 1, 1, None, "解\nover the page"), (1, 3, 2, 1, "故选：BD", "【答案】\n故选：BD\n4. no bracket"), (4, 5, 1, 1, None, None)]


def test_agreement_counts_numbers_with_their_units(spark):
    pairs = spark.createDataFrame([(1, "3 cm 3 cm 5 kg 7", "3 cm 5 g 8", 1.0), (2, "7", "8", 1.0), (3, "2 m3", "2 m³", 1.0), (4, "1 m", "", 1.0)], "k int, a string, b string, c double")
    assert rows(E.fused(pairs, "k", "a", "b", F.lit(1.0), F.col("c")), "k", "agreement") == [(1, 0.25), (2, 1.0), (3, 1.0), (4, None)]


def test_json_of_any_form(spark):
    one = {"id": 5, "number": 2, "type": "single_choice", "content": {"stem": "s", "options": {"B": "y", "A": "x"}}, "text": {"native": "n"}, "answer": {"content": "A"}, "quality": {"confidence": 0.5}}
    texts = [json.dumps({"questions": [one, 3, None, [1]]}), json.dumps([{"text": "t", "content": [1], "answer": False, "options": {"A": "x"}, "quality": None}]), "{oops", "", None, "null", "7", json.dumps({"a": 1}), json.dumps([]), json.dumps([{"text": None, "content": {"stem": 5}, "assets": {"figures": ["f", None]}, "score": "2.5", "number": "4"}])]
    found = files.mixed_extraction(spark.createDataFrame(list(enumerate(texts)), "file int, value string"), "value").where("file <> 99")
    got = {(r.file, r.position): r for r in found.collect()}
    assert sorted(got, key=str) == sorted([(0, 0), (1, 0), (2, None), (3, None), (9, 0)], key=str)
    a, b, broken, last = got[0, 0], got[1, 0], got[2, None], got[9, 0]
    assert (a.source_question_id, a.question_number, a.raw_ocr_content, a.content, [tuple(o) for o in a.options], a.answer, a.ocr_confidence, a.needs_review) == ("5", 2, "n", "s", [("A", "x"), ("B", "y")], "A", 0.5, True)
    assert (b.content, b.raw_ocr_content, b.options, b.answer, b.ocr_confidence, b.needs_review, b.question_type) == ("t", "t", None, None, None, True, "unknown")
    assert (broken.form, broken.content, broken.needs_review, broken.review_status, broken.options) == ("broken", "{oops", True, "pending", None)
    assert (last.content, last.score, last.question_number) == ("5\n\n![figure](asset://f)", 2.5, 4)


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "questions")
    first, second = spark.createDataFrame([(1, "a"), (2, "b")], "id int, content string"), spark.createDataFrame([(3, "c")], "id int, content string")
    for batch, df in (("one", first), ("two", second), ("one", first), ("two", second.limit(0).unionByName(second))):
        files.append_batch(df, path, batch)
    assert rows(spark.read.parquet(path), "batch", "id", "content") == [("one", 1, "a"), ("one", 2, "b"), ("two", 3, "c")]


def test_five_reports(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, 500, False), (1, 2, 3, True)], "paper int, page int, chars int, needs_ocr boolean")
    questions = spark.createDataFrame([(1, 1, 1, 2, 0.9, False, "a"), (1, 2, 2, 0, 0.4, True, "b"), (1, 4, 1, 1, None, True, "c"), (2, 1, 1, 0, 1.0, False, "d")], "paper int, number int, pages int, figures int, confidence double, needs_review boolean, content string")
    answers = spark.createDataFrame([(1, 1, 9, 2, "A", "why"), (1, 4, 9, 1, None, "x"), (1, 8, 9, 1, "B", "y")], "paper int, number int, page int, blocks long, answer string, analysis string")
    files.write_reports(files.reports(pages, questions, answers), str(tmp_path))
    read = {n: {r.paper: r for r in spark.read.json(str(tmp_path / n)).collect()} for n in ("inspection", "manifest", "qa", "questions", "answers")}
    m = read["manifest"][1]
    assert (m.question_count, m.question_numbers, m.cross_page_questions, m.figure_count, m.answer_matched_count, m.warnings) == (3, [1, 2, 4], [2], 3, 2, ["missing: 3", "without an answer: 2"])
    assert read["manifest"][2].warnings == ["without an answer: 1"]
    assert (read["inspection"][1].page_count, read["inspection"][1].pages_to_read, [p.page for p in read["inspection"][1].pages]) == (2, 1, [1, 2])
    assert (read["qa"][1].review_count, read["qa"][1].mean_confidence) == (2, 0.65)
    assert [q.content for q in read["questions"][1].questions] == ["a", "b", "c"]
    assert (read["answers"][1].duplicates, read["answers"][1].matched_count, read["answers"][1].missing_numbers, [q.number for q in read["answers"][1].questions]) == ([1], 2, [2], [1, 4, 8])


CHANGE = "question int, seq int, op string, block string, type string, content string, content_set boolean, style string, style_set boolean, to int"


def test_a_set_of_changes_to_blocks(spark):
    blocks = spark.createDataFrame([(1, "a", 0, "text", "A", None), (1, "b", 1, "text", "B", "s"), (1, "c", 5, "image", "u", None), (1, "d", 6, "text", "D", None), (2, "a", 3, "text", "Z", None)], "question int, block string, position int, type string, content string, style string")
    changes = spark.createDataFrame([
        (1, 1, "update", "b", None, "one", True, None, False, None), (1, 2, "update", "b", None, None, False, None, True, None), (1, 3, "update", "b", None, None, True, None, False, None),
        (1, 4, "delete", "a", None, None, False, None, False, None), (1, 5, "update", "a", None, "late", True, None, False, None), (1, 6, "move", "d", None, None, False, None, False, 1),
        (1, 7, "add", "n", "text", "N", False, None, False, None), (1, 8, "add", "m", "text", "M", False, None, False, None), (2, 9, "delete", "unknown", None, None, False, None, False, None)], CHANGE)
    now = W.blocks_changed(blocks, changes)
    assert rows(now, "question", "position", "block", "content", "style", "is_modified") == [(1, 0, "d", "D", None, True), (1, 1, "b", None, None, True), (1, 2, "c", "u", None, True), (1, 3, "n", "N", None, True), (1, 4, "m", "M", None, True), (2, 0, "a", "Z", None, False)]
    assert rows(W.content_of(now, "question", "position"), "question", "content") == [(1, "D\n\n![图](u)\n\nN\n\nM"), (2, "Z")]


SECTIONS = "practice int, section string, position int, title string, show_title boolean, new_page boolean, kind string"
LAYOUT = "practice int, at int, type string, section string, title string, show_title boolean, new_page boolean, kind string, question string"


def test_a_layout_is_written_back(spark):
    sections = spark.createDataFrame([(1, "s1", 1, "One", True, False, "choice"), (1, "s0", 0, "Zero", True, False, "custom")], SECTIONS)
    questions = spark.createDataFrame([(1, "a", "s1", 1, 1), (1, "b", "s1", 2, 2), (1, "c", "s0", 1, 3), (1, "d", "s1", 3, 4)], "practice int, question string, section string, position int, number int")
    layout = spark.createDataFrame([(1, 0, "question_ref", None, None, None, None, None, "b"), (1, 1, "subtitle", "s1", "", False, None, None, None), (1, 2, "question_ref", None, None, None, None, None, "d"), (1, 3, "spacer", None, None, None, None, None, None), (1, 4, "subtitle", "gone", None, None, True, "fill", None), (1, 5, "question_ref", None, None, None, None, None, "c"), (1, 6, "question_ref", None, None, None, None, None, "x")], LAYOUT)
    s, q = W.layout_synced(sections, questions, layout)
    found = {r.section: (r.position, r.title, r.show_title, r.new_page, r.kind) for r in s.collect()}
    new = next(k for k in found if k.startswith("new-"))
    assert found == {"s0": (0, "Zero", True, False, "custom"), "s1": (1, "One", False, False, "choice"), new: (2, "小节", True, True, "fill")}
    assert rows(q, "question", "section", "position", "number") == [("a", "s1", 1, 1), ("b", "s0", 1, 1), ("c", new, 1, 3), ("d", "s1", 2, 2)]


def test_questions_before_any_section_get_one(spark):
    questions = spark.createDataFrame([(1, "a", None, None, None)], "practice int, question string, section string, position int, number int")
    layout = spark.createDataFrame([(1, 0, "question_ref", None, None, None, None, None, "a"), (1, 1, "subtitle", None, "T", None, None, None, None)], LAYOUT)
    s, q = W.layout_synced(spark.createDataFrame([], SECTIONS), questions, layout)
    assert [(r.position, r.title) for r in s.orderBy("position").collect()] == [(0, "未分组"), (1, "T")]
    assert [(r.position, r.number) for r in q.collect()] == [(1, 1)]


def test_grouping_again_changes_nothing(spark):
    sections = spark.createDataFrame([(1, "x", 0, "填空题", "填空题"), (1, "y", 1, "我的", "custom"), (1, "z", 2, "选择题", "选择题"), (2, "w", 0, "选择题", "选择题")], "practice int, section string, position int, title string, kind string")
    questions = spark.createDataFrame([(1, 1, "x", 0, 1, "填空题"), (1, 2, "y", 0, 2, "选择题"), (1, 3, "z", 0, 3, "选择题"), (1, 4, "y", 1, 4, "其他"), (2, 5, "w", 0, 1, "选择题")], "practice int, question int, section string, position int, number int, label string")
    assert rows(W.regroup_changes(sections, questions), "practice", "change", "detail") == [(1, "merge", "选择题"), (1, "move", "2:我的:选择题"), (1, "move", "4:我的:其他"), (1, "order", "选择题、填空题、其他")]
    s, q = W.regrouped(sections, questions)
    assert rows(s, "practice", "position", "title") == [(1, 0, "选择题"), (1, 1, "填空题"), (1, 2, "其他"), (1, 3, "我的"), (2, 0, "选择题")]
    assert rows(q, "practice", "number", "question", "position") == [(1, 1, 2, 0), (1, 2, 3, 1), (1, 3, 1, 0), (1, 4, 4, 0), (2, 1, 5, 0)]
    assert W.regroup_changes(s, q).collect() == []
    s2, q2 = W.regrouped(s, q)
    assert rows(q2, *q.columns) == rows(q, *q.columns) and rows(s2, *s.columns) == rows(s, *s.columns)
