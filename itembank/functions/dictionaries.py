"""Coded values and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stored code -> display label. Labels are also stored as codes.
TYPE_LABELS = {
    "single_choice": "选择题",
    "multiple_choice": "多选题",
    "fill_blank": "填空题",
    "comprehensive": "综合题",
    "experiment": "实验题",
    "calculation": "计算题",
    "short_answer": "简答题",
    "essay": "论述题",
    "unknown": "未知题型",
    "解答题": "解答题",
}
#: Order of sections when a practice is made; other types follow as they come.
SECTION_ORDER = ["选择题", "多选题", "填空题", "实验题", "计算题", "解答题", "简答题", "论述题", "综合题", "未知题型"]
#: Difficulty bands and the names of the five levels.
BANDS = {"easy": [1, 2], "medium": [3], "hard": [4, 5]}
LEVELS = {1: "易", 2: "较易", 3: "中等", 4: "较难", 5: "难"}
#: Answer lines by question type; other types get 4.
ANSWER_LINES = {"single_choice": 0, "multiple_choice": 0, "fill_blank": 2, "experiment": 4, "calculation": 8, "short_answer": 6, "essay": 6, "comprehensive": 6, "unknown": 4}
#: Numbers of sections; later ones are decimal.
ORDINALS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]


def lookup(code: Column, known: dict, default: Column | None = None) -> Column:
    """The label of a code; the default, or the code itself, where it has none."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), default if default is not None else code)


def type_label(code: Column) -> Column:
    code = F.nullif(code, F.lit(""))
    return F.coalesce(lookup(code, TYPE_LABELS), F.lit("未知题型"))


def has_type(code: Column, wanted: str) -> Column:
    """Whether a stored code is meant by a code or label: all codes of a label, or the very code."""
    if wanted in TYPE_LABELS.values():
        return type_label(code) == wanted
    return code == wanted


def ordinal(n: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in ORDINALS]), n.cast("int")), n.cast("string"))


def section_rank(label: Column) -> Column:
    """Place in SECTION_ORDER from 1; unknown labels come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in SECTION_ORDER]), label)
    return F.when(at > 0, at).otherwise(len(SECTION_ORDER) + 1)
