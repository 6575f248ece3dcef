"""Scenarios with exact expectations, and nulls, blanks, ties and empty inputs."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from itembank.functions import text as X
from itembank.functions.dictionaries import has_type, ordinal, type_label
from itembank.operators import dml as D
from itembank.operators import extract as E
from itembank.operators import inventory as I
from itembank.operators import library as L
from itembank.operators import recommend as R
from itembank.operators import workbook as W

BANK = "id long, question_number int, content string, subject string, source_id string, filename string, difficulty int, question_type string, answer string, explanation string, grade string, is_deleted boolean, review_status string"


def bank(spark, *rows):
    base = {"question_number": 1, "content": "c", "subject": "physics", "source_id": "s", "filename": "Paper.PDF", "difficulty": 3, "question_type": "single_choice", "answer": None, "explanation": None, "grade": None, "is_deleted": False, "review_status": "approved"}
    names = [c.split()[0] for c in BANK.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i} | r)[n] for n in names) for i, r in enumerate(rows, 1)], BANK)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_presence_puts_null_and_blank_on_the_false_side(spark):
    q = bank(spark, {"answer": "A"}, {"answer": ""}, {"answer": None})
    assert ids(L.found(q, L.Filter(has_answer=True))) == [1]
    assert sorted(ids(L.found(q, L.Filter(has_answer=False)))) == [2, 3]
    assert L.found(q, L.Filter()).count() == 3


def test_empty_text_parameters_are_off_and_zero_is_a_level(spark):
    q = bank(spark, {}, {"difficulty": 0})
    assert L.found(q, L.Filter(subject="", search="")).count() == 2
    assert ids(L.found(q, L.Filter(difficulty=0))) == [2]


def test_search_is_literal_and_without_case(spark):
    q = bank(spark, {"content": r"\frac{1}{2} 50%"}, {"content": "x"}, {"content": None, "answer": "FRAC"})
    assert sorted(ids(L.found(q, L.Filter(search="frac")))) == [1, 3]
    assert ids(L.found(q, L.Filter(search="50%"))) == [1]
    assert ids(L.found(q, L.Filter(search=r"\FRAC"))) == [1]


def test_labels_match_all_their_codes(spark):
    q = bank(spark, {"question_type": "single_choice"}, {"question_type": "选择题"}, {"question_type": None}, {"question_type": "odd"})
    assert sorted(ids(q.where(has_type(F.col("question_type"), "选择题")))) == [1, 2]
    assert ids(q.where(has_type(F.col("question_type"), "odd"))) == [4]
    assert [r[0] for r in q.select(type_label(F.col("question_type"))).collect()] == ["选择题", "选择题", "未知题型", "odd"]


def test_tags_any_none_and_empty(spark):
    q = bank(spark, {}, {}, {})
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "question_id long, tag_id string")
    assert sorted(ids(L.with_any_tag(q, links, L.tag_ids(" b ,,")))) == [1, 2]
    assert ids(L.with_any_tag(q, links, ["none"])) == [3]
    assert {r["id"]: r["tags"] for r in L.with_tags(q, links).collect()} == {1: ["a", "b"], 2: ["b"], 3: []}


def test_ids_in_the_order_asked(spark):
    q = bank(spark, {}, {"is_deleted": True}, {})
    assert ids(L.by_ids(q, [3, 2, 9, 1])) == [3, 1]


def test_page_bounds(spark):
    with pytest.raises(AssertionError):
        L.page(spark.range(3), 1, 201, "id")
    assert ids(L.page(spark.range(5), 2, 2, "id")) == [2, 3]


def test_recommend_splits_bands_evenly_and_fills_up(spark):
    q = bank(spark, *[{"difficulty": 1}] * 6, *[{"difficulty": 5}] * 6)
    links = spark.createDataFrame([], "question_id long, tag_id string")
    rows = R.scored(q, links, condition=L.Filter(subject="physics", bands=("easy", "hard")))
    got = R.quota(rows, ("easy", "hard", "easy"), 5).collect()
    assert len(got) == 10 and sorted(r["difficulty"] for r in got) == [1] * 5 + [5] * 5
    one_sided = R.quota(rows.where("difficulty = 1 OR id = 7"), ("easy", "hard"), 4).collect()
    assert len(one_sided) == 7


def test_recommend_excludes_used_even_with_missing_ids(spark):
    q = bank(spark, {}, {}, {})
    used = spark.createDataFrame([(1,), (2,), (None,)], "question_id long")
    assert ids(R.without_used(q, used)) == [3]


def test_recommend_reason_names_hit_tags(spark):
    q = bank(spark, {}, {})
    links = spark.createDataFrame([(1, "optics"), (1, "arc")], "question_id long, tag_id string")
    rows = R.scored(q, links, tags=["optics", "arc"], types=["选择题"])
    got = R.reasons(rows).collect()
    assert len(got) == 1 and got[0]["reason"] == "命中2个考点：arc、optics · 难度：中等 · 来自《Paper》"
    assert rows.first()["score"] == 9.0


def test_append_counts_each_new_row_once_and_goes_on_from_zero(spark):
    there = spark.createDataFrame([("b", 1, 0)], "basket string, question long, position int")
    new = spark.createDataFrame([("b", 1, 1), ("b", 2, 2), ("b", 3, 3), ("b", 2, 4)], "basket string, question long, asked int")
    assert [tuple(r) for r in W.next_positions(there, new, "basket", "question", "asked").select("question", "position").orderBy("position").collect()] == [(2, 1), (3, 2)]


def test_grouping_puts_types_in_order_and_unknown_ones_as_they_come(spark):
    rows = spark.createDataFrame([("p", 0, "填空题"), ("p", 1, "zeta"), ("p", 2, "选择题"), ("p", 3, "alpha"), ("p", 4, "zeta")], "practice string, position int, label string")
    got = W.grouped_by_type(rows, "practice", "label", "position").orderBy("number").collect()
    assert [(r["label"], r["section"], r["number"]) for r in got] == [("选择题", 0, 1), ("填空题", 1, 2), ("zeta", 2, 3), ("zeta", 2, 4), ("alpha", 3, 5)]


def test_types_are_grouped_in_parts_of_bounded_rows(spark, monkeypatch):
    """One shuffle and two sorts; with more rows there are more parts, and the same numbers."""
    rows = spark.range(3000).selectExpr("id % 500 AS practice", "id AS position", "element_at(array('填空题', 'x', '选择题', 'y'), int(id * 7 % 4) + 1) AS label")
    made = lambda: W.grouped_by_type(rows, "practice", "label", "position")
    plan = made()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
    usual = sorted(map(tuple, made().collect()))
    monkeypatch.setattr(W, "PART_ROWS", 100)
    assert made().rdd.getNumPartitions() == 30 and sorted(map(tuple, made().collect())) == usual


def test_segments_carry_forward_and_titles_without_content_go(spark):
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate("qtqqttq")] + [("e", 0, "t")], "practice string, at int, type string")
    got = W.segments(rows, "practice", "at", F.col("type") == "t").where("practice = 'p'").orderBy("at").collect()
    assert [r["segment"] for r in got] == [0, 1, 1, 1, 2, 3, 3]
    assert [r["question_number"] for r in got] == [1, None, 2, 3, None, None, 4]
    left = W.without_empty_titles(rows, "practice", "at", F.col("type") == "t").orderBy("practice", "at").collect()
    assert "".join(r["type"] for r in left) == "qtqqtq"


def test_valid_blocks_keep_order_and_known_kinds(spark):
    raw = spark.createDataFrame([(1, [("subtitle", "a", None, None), ("video", None, None, None), ("spacer", None, None, 30), ("spacer", None, None, None)])], "practice int, blocks array<struct<type:string,title:string,show_title:boolean,height:int>>")
    assert [(r["position"], r["type"], r["title"], r["show_title"], r["height"]) for r in W.valid_blocks(raw).collect()] == [(0, "subtitle", "a", True, None), (1, "spacer", "", True, 30), (2, "spacer", "", True, 20)]


def test_content_is_joined_in_order(spark):
    rows = spark.createDataFrame([(1, 2, "text", " b "), (1, 0, "text", "a"), (1, 1, "image", "asset://x"), (1, 3, "text", "  "), (2, 0, "options", "[]")], "q int, at int, type string, content string")
    assert {r["q"]: r["content"] for r in W.content_of(rows, "q", "at").collect()} == {1: "a\n\n![图](asset://x)\n\nb", 2: ""}


def test_gaps(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 1), ("c", 2_000_000_000), ("c", 7)], "p string, n int")
    got = {r["p"]: (r["missing"], r["contiguous"]) for r in I.gaps(rows, "p", "n").collect()}
    assert got == {"a": ("2", False), "b": ("", True), "c": ("1-6,8-1999999999", False)}


def test_heading_is_strictly_before(spark):
    rows = spark.createDataFrame([("d", 1, "h", "A"), ("d", 1, "q", None), ("d", 2, "q", None), ("d", 3, "h", "B"), ("d", 4, "q", None), ("e", 1, "q", None)], "doc string, y int, kind string, title string")
    got = E.with_heading(rows, "doc", ["y"], F.col("kind") == "h", "title").orderBy("doc", "y").collect()
    assert [r["heading"] for r in got] == [None, "A", "B", None]


def test_anchor_ranges_end_at_the_first_break_inside(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("d", t(1), "a"), ("d", t(3), "b"), ("d", t(4), "b"), ("d", t(5), "a"), ("d", t(7), "a")], "doc string, ts timestamp_ntz, kind string")
    got = E.anchor_ranges(rows, "doc", "ts", F.col("kind") == "a", F.col("kind") == "b").orderBy("ts").collect()
    assert [r["end_at"] for r in got] == [t(3), t(7), None]


def test_overlaps_find_each_pair_once(spark):
    a = spark.createDataFrame([(1, "p", 0.0, 100.0), (2, "p", 5.0, 6.0), (3, "q", 0.0, 9.0)], "l_id int, page string, l0 double, l1 double")
    b = spark.createDataFrame([(7, "p", 5.5, 50.0), (8, "q", 9.0, 10.0)], "r_id int, page string, r0 double, r1 double")
    assert sorted((r["l_id"], r["r_id"]) for r in E.overlaps(a, b, ["page"], 2.0).collect()) == [(1, 7), (2, 7)]


def test_best_sequence_prefers_few_gaps():
    anchors = [(0, 1.0, 1), (0, 2.0, 9), (0, 3.0, 2), (0, 4.0, 3), (1, 1.0, 5)]
    assert E.best_sequence(anchors) == [0, 2, 3, 4]
    assert E.best_sequence([(0, 1.0, 2)]) == [] and E.best_sequence([]) == []


def test_best_sequence_equals_all_rising_runs():
    draw = random.Random(5)
    for _ in range(300):
        anchors = [(draw.randrange(3), float(draw.randrange(50)), draw.randrange(1, 7)) for _ in range(draw.randrange(9))]
        order = sorted(range(len(anchors)), key=lambda i: anchors[i][:2])

        def rank(run):
            numbers = [anchors[i][2] for i in run]
            skipped = sum(b - a - 1 for a, b in zip(numbers, numbers[1:]))
            return (10.0 * len(run) - skipped, len(run), -skipped, numbers[-1])

        runs = [r for n in range(1, len(order) + 1) for r in itertools.combinations(order, n) if anchors[r[0]][2] == 1 and all(anchors[a][2] < anchors[b][2] for a, b in zip(r, r[1:]))]
        found = E.best_sequence(anchors)
        assert (tuple(found) in runs and rank(found) == max(map(rank, runs))) if runs else found == []


def test_chosen_anchors_by_paper(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 0, 2.0, 7), ("a", 0, 3.0, 2), ("b", 0, 1.0, 4)], "paper string, page long, y double, number long")
    assert sorted(tuple(r) for r in E.chosen_anchors(rows, "paper", "page", "y", "number").collect()) == [("a", 0, 1.0, 1), ("a", 0, 3.0, 2)]


def test_agreement_is_one_without_tokens(spark):
    a = spark.createDataFrame([(1, ["x", "x", "y"]), (2, [])], "k int, t array<string>")
    b = spark.createDataFrame([(1, ["x", "z"]), (2, [])], "k int, t array<string>")
    assert {r["k"]: r["agreement"] for r in E.token_agreement(a, b, "k", F.col("t"), F.col("t")).collect()} == {1: 0.25, 2: 1.0}


def test_answers_first_block_counts(spark):
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(["intro", "1. 【答案】B", "why", "2、故选：AC", "1. again"])], "p string, at int, t string")
    got = {r["number"]: (r["body"], r["answer"]) for r in E.answer_blocks(lines, "p", "at", "t").collect()}
    assert got == {1: ("【答案】B\nwhy", "B"), 2: ("故选：AC", "AC")}


def test_soft_delete_is_idempotent(spark):
    q = bank(spark, {}, {"is_deleted": True})
    once = D.soft_deleted(q, F.col("id") > 0)
    assert once.where("changed").count() == 1
    assert D.soft_deleted(once, F.col("id") > 0).where("changed").count() == 0


def test_cascade_reaches_every_level(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    left = D.cascade(df([(1,), (2,)], "p int"), [(df([(1, 10), (2, 20)], "pf int, s int"), "pf", "s"), (df([(10, 100), (20, 200)], "sf int, q int"), "sf", "q")], F.col("p") == 1, "p")
    assert [[tuple(r) for r in x.collect()] for x in left] == [[(2,)], [(2, 20)], [(20, 200)]]


def test_patch_sets_null_only_where_sent(spark):
    q = bank(spark, {}, {})
    patch = spark.createDataFrame([(1, None, True), (2, 5, False)], "id long, difficulty int, difficulty_set boolean")
    assert {r["id"]: r["difficulty"] for r in D.patched(q, patch, "id").collect()} == {1: None, 2: 3}


def test_upsert_is_null_safe(spark):
    s = "name string, subject string"
    out = D.upserted(spark.createDataFrame([("a", None)], s), spark.createDataFrame([("a", None), ("a", "x")], s), ["name", "subject"])
    assert out.count() == 2


def test_texts(spark):
    row = spark.createDataFrame([(r"a \(x\) ![p](u) **b** [l](v)" + "\n c", "sk-1234567890abcdef", "short", "第 3 页 x□  \n\n\n\ny ﹣1")], "t string, k string, s string, c string")
    r = row.select(X.snippet(F.col("t")).alias("a"), X.mask_key(F.col("k")).alias("b"), X.mask_key(F.col("s")).alias("c"), X.clean_up(F.col("c")).alias("d"), ordinal(F.lit(3)).alias("e"), ordinal(F.lit(13)).alias("f"), X.clean_css(F.lit("color: red; position: fixed; font-size: url(x); margin-top:4px")).alias("g"), X.plain_number(F.lit(2.5)).alias("h"), X.unfenced(F.lit("```json\n{}\n```")).alias("i"), X.escape_html(F.lit("<a&'>")).alias("j")).first()
    assert tuple(r) == ("a x p b l c", "sk-1****cdef", None, "x\n\ny -1", "三", "13", "color: red; margin-top: 4px", "2.5", "{}\n", "&lt;a&amp;&#x27;&gt;")


def test_units(spark):
    r = spark.createDataFrame([("5 V 3.5 m3 7 apples 100VV 0.G",)], "t string").select(X.numbers_with_units(F.col("t")).alias("n"), X.unit_warnings(F.col("t")).alias("w")).first()
    assert [tuple(x) for x in r["n"]] == [("5", "V"), ("3.5", "m³")]
    assert r["w"] == ["superscript:m3", "doubled:100VV", "decimal:0.G"]


def test_empty_inputs(spark):
    q = bank(spark, {}).where("false")
    links = spark.createDataFrame([], "question_id long, tag_id string")
    assert L.page(L.found(q), 1, 20, "question_number", "id").count() == 0
    assert R.quota(R.scored(q, links), ("easy", "hard"), 5).count() == 0
    assert L.total(q).first()["total"] == 0
    assert I.issue_summary(I.issues(q, {"x": F.col("answer").isNull()})).count() == 0
