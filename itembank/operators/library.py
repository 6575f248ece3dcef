"""The question library: filters, search, pages, tags, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.functions.dictionaries import BANDS, has_type, type_label
from itembank.functions.text import contains_any_case, present


@dataclass(frozen=True)
class Filter:
    """Optional conditions on questions. Empty texts are off; difficulty is off only as None."""

    source_id: str | None = None
    review_status: str | None = None
    subject: str | None = None
    grade: str | None = None
    difficulty: int | None = None
    bands: Sequence[str] = field(default_factory=tuple)
    question_types: Sequence[str] = field(default_factory=tuple)
    has_answer: bool | None = None
    has_explanation: bool | None = None
    search: str | None = None

    def condition(self, search_in: Sequence[str] = ("content", "answer", "explanation")) -> Column:
        parts = [~F.col("is_deleted")]
        for name in ("source_id", "review_status", "subject", "grade"):
            if value := getattr(self, name):
                parts.append(F.col(name) == value)
        if self.difficulty is not None:
            parts.append(F.col("difficulty") == self.difficulty)
        if levels := sorted({v for b in self.bands for v in BANDS.get(b, [])}):
            parts.append(F.col("difficulty").isin(levels))
        if self.question_types:
            parts.append(reduce(lambda a, b: a | b, [has_type(F.col("question_type"), t) for t in self.question_types]))
        for name, wanted in (("answer", self.has_answer), ("explanation", self.has_explanation)):
            if wanted is not None:
                parts.append(present(F.col(name)) if wanted else ~present(F.col(name)))
        if self.search:
            parts.append(reduce(lambda a, b: a | b, [F.coalesce(contains_any_case(F.col(c), self.search), F.lit(False)) for c in search_in]))
        return reduce(lambda a, b: a & b, parts)


def only(df: DataFrame, **wanted: str | Sequence[str] | None) -> DataFrame:
    """Rows whose columns have the wanted value, or one of several; empty conditions are off."""
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value if isinstance(value, str) else F.col(name).isin(list(value)))
    return df


def shuffled(df: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """The rows in a random order that the seed fixes, whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)


def choices(fixed: Sequence[str], found: DataFrame, column: str) -> DataFrame:
    """One row, `choices`: fixed values in their order, then those found beside them, by name. A column of few distinct values."""
    own = found.where(present(F.col(column))).agg(F.array_sort(F.collect_set(column)).alias("found"))
    known = F.array(*[F.lit(x) for x in fixed]).cast("array<string>")
    return own.select(F.array_union(known, "found").alias("choices"), F.array_except("found", known).alias("added"))


def live(questions: DataFrame) -> DataFrame:
    return questions.where(~F.col("is_deleted"))


#: Columns that a search looks into, where a table has them.
SEARCHED = ("content", "answer", "explanation", "raw_ocr_content")


def found(questions: DataFrame, condition: Filter = Filter()) -> DataFrame:
    return questions.where(condition.condition([c for c in SEARCHED if c in questions.columns]))


#: Sources are broadcast up to so many rows.
BROADCAST_SOURCES = 100_000


def with_sources(questions: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """Every question with these columns of its source, null where the source is unknown. Few sources are broadcast, many are joined by a shuffle."""
    known = sources.select("source_id", *columns)
    few = known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return questions.drop(*columns).join(F.broadcast(known) if few else known, "source_id", "left")


def basket_items(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Items of baskets (basket, question, position) with the label of their question's type; items whose question is deleted or unknown are skipped."""
    known = live(questions).select(F.col("id").alias("question"), type_label(F.col("question_type")).alias("label"))
    return items.join(known, "question").select("basket", "position", "question", "label")


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """One page of a total order; Spark keeps only the rows up to the page's end."""
    assert number >= 1 and 1 <= size <= 200, "pages start at 1 and have 1 to 200 rows"
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def tag_ids(text: str) -> list[str]:
    """A comma-separated list of tags, trimmed, without empty ones."""
    return [t for t in (x.strip() for x in text.split(",")) if t]


def with_any_tag(questions: DataFrame, links: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Questions with at least one of the tags; the list ["none"] means those without any."""
    if list(tags) == ["none"]:
        return untagged(questions, links)
    return questions.join(links.where(F.col("tag_id").isin(list(tags))).select(F.col("question_id").alias("id")), "id", "left_semi")


def untagged(questions: DataFrame, links: DataFrame) -> DataFrame:
    return questions.join(links.select(F.col("question_id").alias("id")), "id", "left_anti")


def with_tags(questions: DataFrame, links: DataFrame) -> DataFrame:
    """Every question with the sorted array of its tags, empty if it has none."""
    tags = links.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    return questions.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def by_ids(questions: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Live questions in the order of the ids asked for; unknown ones are left out."""
    asked = questions.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, id long")
    return live(questions).join(F.broadcast(asked), "id").orderBy("position")


def subjects(questions: DataFrame) -> DataFrame:
    return questions.where(present(F.col("subject"))).select("subject").distinct()


def presence(questions: DataFrame) -> DataFrame:
    """Per subject, how many questions have an answer or an explanation, and how many don't."""
    has = lambda c: present(F.col(c))
    return live(questions).groupBy("subject").agg(F.count_if(has("answer")).alias("with_answer"), F.count_if(~has("answer")).alias("without_answer"), F.count_if(has("explanation")).alias("with_explanation"), F.count_if(~has("explanation")).alias("without_explanation"))


def latest(jobs: DataFrame, sources: DataFrame, n: int = 50) -> DataFrame:
    """The last jobs, with what is known of their sources."""
    last = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return last.join(sources, "source_id", "left")


def tag_tree(tags: DataFrame) -> DataFrame:
    """id, name, subject, parent_id, is_root, children: a tag whose parent is missing is a root; children in order of their names."""
    children = tags.groupBy(F.col("parent_id").alias("p")).agg(F.array_sort(F.collect_list("name")).alias("children"))
    known = tags.select(F.col("id").alias("k"))
    t = tags.join(known, F.expr("parent_id = k"), "left").join(children, F.expr("id = p"), "left")
    return t.select("id", "name", "subject", "parent_id", F.col("k").isNull().alias("is_root"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def first_of_each(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key, and how many others it stands for."""
    w = Window.partitionBy(*keys)
    return df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("duplicates", F.count("*").over(w) - 1).where("rn = 1").drop("rn")
