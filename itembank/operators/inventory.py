"""Inventories: counts, coverage of features, issues, gaps in numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.functions.rich import document_errors
from itembank.functions.text import has_formula, options_have_picture, picture_count

#: A question number in a page's text; words that open the answers.
NUMBERED = r"(?:[（(]\s*多选\s*[）)])?\s*(\d{1,2})\s*[.．、]\s*(?:[（(]\s*\d+\s*分\s*[）)])?"
ANSWER_MARKERS = ("参考答案与试题解析", "参考答案", "答案与解析", "试题解析")


def counts_by(df: DataFrame, column: str, missing: str = "(无)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, by: str, features: Mapping[str, Column], length: Column) -> DataFrame:
    """Per group: rows, rows with each feature, and total length, in one pass."""
    return df.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(cond).alias(name) for name, cond in features.items()], F.sum(length).alias("total_chars"))


def buckets(df: DataFrame, by: str, rules: Sequence[tuple[str, Column]], exclusive: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """group, bucket, n, least id: a row is in each bucket whose rule it meets, and in the first exclusive one."""
    one = F.lit(None).cast("string")
    for name, cond in reversed(exclusive):
        one = F.when(cond, name).otherwise(one)
    found = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules], one))
    return df.select(by, "id", F.explode(found).alias("bucket")).groupBy(by, "bucket").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def bucket_members(df: DataFrame, by: str, rules: Sequence[tuple[str, Column]], exclusive: Sequence[tuple[str, Column]] = (), keep: Sequence[str] = ("id",)) -> DataFrame:
    """group, bucket and the kept columns: a row for each bucket that a row is in. Ids of a bucket are rows, not an array, however many they are."""
    one = F.lit(None).cast("string")
    for name, cond in reversed(exclusive):
        one = F.when(cond, name).otherwise(one)
    found = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules], one))
    return df.select(by, *keep, F.explode(found).alias("bucket"))


def practice_features(questions: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """Per practice: its questions, those with a formula, a picture, a picture in an option, its blocks of answer lines, and its characters.

    questions: by, question, content, options (array of label, content); blocks: question, type. Blocks are counted by question before they are joined.
    """
    spaces = blocks.where(F.col("type") == "answer_space").groupBy("question").agg(F.count("*").alias("spaces"))
    content = F.coalesce("content", F.lit(""))
    rows = questions.select(by, "question", has_formula(content).alias("formula"), (picture_count(content) > 0).alias("image"), options_have_picture(F.col("options")).alias("option_image"), F.length(content).alias("chars")).join(spaces, "question", "left")
    return rows.groupBy(by).agg(F.count("*").alias("questions"), F.count_if("formula").alias("formula_questions"), F.count_if("image").alias("image_questions"), F.count_if("option_image").alias("option_image_questions"), F.coalesce(F.sum("spaces"), F.lit(0)).alias("answer_space_blocks"), F.sum("chars").alias("total_chars"))


def document_totals(documents: DataFrame, doc: str) -> DataFrame:
    """One row: how many documents there are, are missing, are broken or have errors, and are valid."""
    there = F.coalesce(F.col(doc), F.lit("")) != ""
    good = there & (F.size(document_errors(F.col(doc))) == 0)
    return documents.select(there.alias("there"), good.alias("good")).agg(F.count("*").alias("total"), F.count_if(~F.col("there")).alias("missing"), F.count_if(F.col("there") & ~F.col("good")).alias("bad"), F.count_if("good").alias("valid"))


def issues(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """id, issue: one row for every check that a row fails."""
    return df.select("id", F.explode(F.array_compact(F.array(*[F.when(cond, name) for name, cond in checks.items()]))).alias("issue"))


def issue_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("id").alias("rows"))


def picked(df: DataFrame, by: Sequence[str], quota: int, *order: Column | str, taken: DataFrame | None = None) -> DataFrame:
    """The best rows of each group up to a quota, without those already taken."""
    rows = df if taken is None else df.join(taken.select("id"), "id", "left_anti")
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pick") <= quota)


def gaps(rows: DataFrame, parent: str, number: str) -> DataFrame:
    """Per parent: the largest number, how many there are, which are missing from 1 on (3 or 5-9), and whether none is. An outlier makes one range, not an array of its size."""
    found = rows.select(parent, number).where(F.col(number).isNotNull()).repartition(parent).distinct()  # one exchange for what follows, too
    before = F.coalesce(F.lag(number).over(Window.partitionBy(parent).orderBy(number)), F.lit(0))
    lo, hi = before + 1, F.col(number) - 1
    gap = F.when(hi == lo, lo.cast("string")).when(hi > lo, F.concat_ws("-", lo.cast("string"), hi.cast("string")))
    gaps = found.withColumn("gap", F.when(gap.isNotNull(), F.struct(F.col(number).alias("at"), gap.alias("text"))))
    missing = F.array_join(F.transform(F.array_sort(F.collect_list("gap")), lambda g: g["text"]), ",")
    out = gaps.groupBy(parent).agg(F.max(number).alias("expected"), F.count("*").cast("int").alias("n_found"), missing.alias("missing"))
    return out.withColumn("contiguous", F.col("missing") == "")


def has_repeats(values: Column) -> Column:
    """Whether an array holds a value twice."""
    return F.size(values) != F.size(F.array_distinct(values))


def page_inspections(pages: DataFrame, by: str, page: str, text: str, markers: Sequence[str]) -> DataFrame:
    """Per page: its characters, replacement marks, the question numbers it names, whether it holds answers, and whether it needs another reading."""
    t = F.coalesce(F.col(text), F.lit(""))
    marks = F.length(t) - F.length(F.replace(t, F.lit("\ufffd"), F.lit("")))
    answers = F.lit(False)
    for m in markers:
        answers = answers | F.contains(t, F.lit(m))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(NUMBERED), F.lit(1)), lambda n: n.cast("int"))
    return pages.select(by, page, F.length(t).alias("chars"), marks.alias("replaced"), numbers.alias("numbers"), answers.alias("is_answer"), ((F.length(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")) < 20) | (marks >= 3)).alias("needs_ocr"))


def answer_boundaries(inspected: DataFrame, by: str, page: str) -> DataFrame:
    """Per document: its pages, the first page with answers, and the pages of questions before it (all where there is none)."""
    first = F.min(F.when(F.col("is_answer"), F.col(page)))
    out = inspected.groupBy(by).agg(F.count("*").alias("pages"), first.alias("answer_start"))
    before = inspected.join(out, by).groupBy(by).agg(F.count_if(F.col("answer_start").isNull() | (F.col(page) < F.col("answer_start"))).alias("question_pages"))
    return out.join(before, by)


def broken_links(texts: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """id, ref: references in texts that no file answers."""
    refs = texts.select("id", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("ref")).distinct()
    return refs.join(files.select("ref"), "ref", "left_anti")
