"""Pages, anchors, readings, options, renderings and changes on small tables with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from itembank.functions import text as X
from itembank.functions.dictionaries import SECTION_ORDER, section_rank
from itembank.operators import dml as D
from itembank.operators import extract as E
from itembank.operators import inventory as I
from itembank.operators import library as L


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_order_of_all_sections(spark):
    got = [one(spark, section_rank(F.col("t")), t=t) for t in ("选择题", "多选题", "填空题", "实验题", "计算题", "解答题", "简答题", "论述题", "综合题", "未知题型", "别的")]
    assert got == list(range(1, 12)) and len(SECTION_ORDER) == 10


def test_clean_up_keeps_signs_and_line_ends(spark):
    assert one(spark, X.clean_up(F.col("t")), t="a﹣b＝c \t\nd\r \n□\ufffdend 第 2 页（共 9 页）\u3000") == "a-b=c\nd\r\nend"


@pytest.mark.parametrize("raw, want", [('["x", {"label": "Q"}, {"content": "y"}, "{\\"a\\": 1}", 3, null]', [("A", "x"), ("Q", ""), ("C", "y"), ("D", '{"a": 1}')]), ("[]", []), ('{"A": 1}', None), ("nonsense", None), (None, None)])
def test_options_in_any_shape(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "o string").select(X.normal_options(F.col("o")).alias("x")).first()["x"]
    assert (None if got is None else [tuple(o) for o in got]) == want


def test_renderings(spark):
    t = "## Head\n**b** and *i* $x^2$\n![p](u1)![q](u2)\n- item\n3. third"
    full = one(spark, X.rendered_full(F.col("t"), 1), t=t)
    assert full == '<h3>Head</h3><br><b>b</b> and <i>i</i> <span class="math">x^2</span><br><img src="u1" alt="p" style="' + X.FULL_STYLE + '" loading="lazy" /><br><li>item</li><br><li>third</li>'
    assert "<img" not in one(spark, X.rendered_full(F.col("t"), None), t=t) and one(spark, X.rendered_full(F.col("t"), empty="-"), t="") == "-"
    preview = one(spark, X.rendered_preview(F.col("t"), 12), t="# T\n$$ y $$ $z$ **b**![p](u)")
    assert preview == 'T\n[y] z b<div style="margin-top:4px;"><img src="u" alt="p" style="' + X.PREVIEW_STYLE + '" loading="lazy" /></div>'
    assert one(spark, X.rendered_preview(F.col("t"), 3), t="abcdef") == "abc..."
    assert one(spark, X.rendered_option(F.col("t")), t=r"\(a\) ![p](u)") == '<span class="math">a</span> <img src="u" alt="p" style="' + X.OPTION_STYLE + '" loading="lazy" />'


def test_readings_are_fused(spark):
    rows = [(1, "3 cm 与 5 kg", "4 cm", 0.9, 1.0), (2, "3 cm", "3 cm 4 cm", 0.9, 1.0), (3, "3 cm", "4 cm", 0.9, None), (4, "", "2 kg/m3 □\nx", 0.5, 0.5), (5, None, None, 0.0, None)]
    df = spark.createDataFrame(rows, "k int, a string, b string, s double, c double")
    got = {r["k"]: tuple(r)[1:] for r in E.fused(df, "k", "a", "b", F.col("s"), F.col("c")).collect()}
    assert got == {1: (1, 0, 0, 0.79, True, 0.0), 2: (0, 0, 0, 0.94, False, 0.5), 3: (0, 0, 0, 0.9, False, None), 4: (0, 1, 1, 0.47, True, None), 5: (0, 0, 0, 0.0, True, None)}


def test_anchors_from_lines(spark):
    lines = [(1, 5.0, "1. one"), (1, 5.001, " 1．twice"), (1, 6.0, "（多选）12、（3分）x"), (1, 7.0, "3.5 metres"), (1, 8.0, "第 4 页 4. x"), (1, 9.0, "0. zero"), (1, 9.5, "100. far"), (2, 1.0, "7:x"), (2, 2.0, "7：x"), (2, 3.0, None)]
    got = E.candidate_anchors(spark.createDataFrame(lines, "page int, y double, t string"), ["page"], "y", "t").collect()
    assert sorted((r["page"], r["number"], r["y"]) for r in got) == [(1, 1, 5.0), (1, 12, 6.0), (2, 7, 2.0)]


def test_questions_keep_missing_answers(spark):
    q, a = spark.createDataFrame([(1, 1), (1, 2)], "p int, n int"), spark.createDataFrame([(1, 2, "B")], "p int, n int, answer string")
    assert sorted(tuple(r) for r in E.with_answers(q, a, ["p", "n"]).collect()) == [(1, 1, None), (1, 2, "B")]
    twice = a.unionByName(spark.createDataFrame([(1, 2, "A")], a.schema))
    assert sorted(tuple(r) for r in E.with_answers(q, twice, ["p", "n"]).collect()) == [(1, 1, None), (1, 2, "A")]


def test_pages_before_the_answers(spark):
    pages = spark.createDataFrame([("a", 0, "1. 多 2、x"), ("a", 1, "参考答案"), ("a", 2, "3. y"), ("b", 0, None)], "d string, p int, t string")
    found = I.page_inspections(pages, "d", "p", "t", I.ANSWER_MARKERS)
    assert found.where("d = 'a' AND p = 0").first()["numbers"] == [1, 2]
    assert {r["d"]: (r["pages"], r["answer_start"], r["question_pages"]) for r in I.answer_boundaries(found, "d", "p").collect()} == {"a": (3, 1, 1), "b": (1, None, 1)}


def test_deep_and_circular_tags(spark):
    chain = [(i, i - 1 if i else None) for i in range(14)] + [(50, 51), (51, 50), (60, None)]
    tags = spark.createDataFrame(chain, "id int, parent_id int")
    left = lambda root: {r["id"] for r in D.without_subtree(tags, root).select("id").collect()}
    assert left(0) == {50, 51, 60} and left(50) == {*range(14), 60} and left(999) == {*range(14), 50, 51, 60}


def test_made_counted_and_evolved(spark):
    t = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    new = spark.createDataFrame([(9, "new")], "id int, name string")
    assert D.get_or_create(t, new, "id").first()["id"] == 1 and D.get_or_create(t.where("false"), new, "id").first()["id"] == 9
    left, count = D.deleted(t, F.when(F.col("id") == 1, True))
    assert [r["id"] for r in left.collect()] == [2] and count.first()["deleted"] == 1
    assert D.evolved(t, {"name": F.lit("x"), "extra": F.lit(1)}).columns == ["id", "name", "extra"]
    assert L.only(t, name=None, id=["1"]).count() == 1 and I.has_repeats is not None
    assert [r["id"] for r in L.shuffled(t, 1).collect()] == [r["id"] for r in L.shuffled(t.repartition(2), 1).collect()]
    assert L.choices(["z"], t, "name").first()["choices"] == ["z", "a", "b"]


def test_picture_sizes(spark):
    assert one(spark, X.fitted_width(F.col("w"), F.col("h"), 6_300_000), w=5000, h=10) == 3_150_000
    assert one(spark, X.fitted_width(F.col("w"), F.col("h"), 6_300_000), w=100, h=100) is None
    assert one(spark, X.fitted_width(F.col("w"), F.col("h"), 6_300_000), w=100, h=604) == 952500 * 2880000 // 5753100


def test_small_renderings_and_settings(spark):
    assert one(spark, X.bold(F.col("t")), t="a **b**") == "a <b>b</b>"
    assert one(spark, X.safe_file_name(F.col("t")), t='a/b:c*"d"') == "a_b_c__d_"
    assert one(spark, X.fill_template(F.lit("{a}-{b}"), {"a": F.lit(1), "b": F.lit(None).cast("string")})) == "1-"
    assert one(spark, X.like_any_case(F.col("t"), "A_c"), t="xabcx") and not one(spark, X.like_any_case(F.col("t"), "a_c"), t="ac")
    assert one(spark, X.set_attributes(F.create_map(F.lit("textAlign"), F.lit("left"), F.lit("indent"), F.lit("2"), F.lit("bold"), F.lit("false")))) == {"indent": "2"}
    s = spark.createDataFrame([("k", "v")], "api_key string, name string")
    assert tuple(D.settings_updated(s, {"api_key": "", "name": "n"}).first()) == ("k", "n")
    assert tuple(D.settings_updated(s, {"api_key": None, "name": ""}).first()) == ("k", "")
    assert tuple(D.settings_updated(s, {"api_key": "new", "name": None}).first()) == ("new", None)
