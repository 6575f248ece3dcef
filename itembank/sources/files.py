"""File sources and sinks of the ingest path: discovery, naming, JSON in both shapes, reports, seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itembank.functions.text import corrected_type

#: Extensions that an upload may have.
EXTENSIONS = ("pdf", "docx", "pptx", "txt")

ANSWER = T.StructType([T.StructField("answer", T.StringType()), T.StructField("analysis", T.StringType())])
QUESTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("content", T.StructType([T.StructField("stem", T.StringType()), T.StructField("options", T.MapType(T.StringType(), T.StringType()))])), T.StructField("answer", ANSWER), T.StructField("text", T.StructType([T.StructField(n, T.StringType()) for n in ("selected", "native", "local_ocr")])), T.StructField("quality", T.StructType([T.StructField("ocr_confidence", T.DoubleType()), T.StructField("needs_review", T.BooleanType())]))])


def discover(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length of matching files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")


def accepted(files: DataFrame, known: DataFrame, path_col: str = "path") -> DataFrame:
    """Files with an allowed extension whose name isn't known yet; only pdf files start a job."""
    name = F.element_at(F.split(path_col, "/"), -1)
    ext = F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]+)$", 1))
    new = files.withColumn("filename", name).withColumn("file_type", ext).where(F.col("file_type").isin(*EXTENSIONS))
    return new.join(known.select("filename").distinct(), "filename", "left_anti").withColumn("starts_job", F.col("file_type") == "pdf")


def output_names(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Stem of each file; where stems collide without regard to case, with eight digits of the path's SHA-256."""
    stem = F.regexp_replace(F.element_at(F.split(path_col, "/"), -1), r"\.[^.]*$", "")
    n = F.count("*").over(Window.partitionBy(F.lower(F.col("stem"))))
    return files.withColumn("stem", stem).withColumn("output", F.when(n > 1, F.concat_ws("-", "stem", F.substring(F.sha2(path_col, 256), 1, 8))).otherwise(F.col("stem")))


def read_extraction(spark: SparkSession, path: str) -> DataFrame:
    """Extracted questions from JSON files that hold an object with "questions" or a bare list."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    listed = F.from_json("value", T.ArrayType(QUESTION))
    inside = F.from_json("value", T.StructType([T.StructField("questions", T.ArrayType(QUESTION))]))["questions"]
    found = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), listed).otherwise(inside)
    return whole.select("file", F.posexplode(found).alias("position", "q")).select("file", "position", "q.*")


def bank_rows(extracted: DataFrame) -> DataFrame:
    """Extraction records as bank rows; answers, analyses and confidences are carried over, doubtful ones wait for review."""
    review = F.coalesce(F.col("quality.needs_review"), F.lit(False))
    return extracted.select("id", F.col("number").alias("question_number"), F.col("type").alias("question_type"), "score", F.coalesce(F.nullif(F.col("content.stem"), F.lit("")), F.nullif(F.col("text.selected"), F.lit("")), F.nullif(F.col("text.native"), F.lit("")), F.col("text.local_ocr")).alias("content"), F.array_sort(F.map_entries("content.options")).alias("options"), F.col("answer.answer").alias("answer"), F.col("answer.analysis").alias("explanation"), F.col("quality.ocr_confidence").alias("ocr_confidence"), review.alias("needs_review"), F.when(review, "pending").otherwise("approved").alias("review_status"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file; df has a bounded number of rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_versioned(df: DataFrame, path: str, version: str) -> str:
    """A table under its own version folder, so that older ones stay as backups."""
    at = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(at)
    return at


def seed_tags(spark: SparkSession, seed: Mapping[str, Mapping[str, Sequence[str]]], existing: DataFrame | None = None) -> DataFrame:
    """id, name, subject, category, parent_id of a nested seed {subject: {parent: [children]}}; nothing if tags exist."""
    rows = [(subject, parent, list(children)) for subject, parents in seed.items() for parent, children in parents.items()]
    nested = spark.createDataFrame(rows, "subject string, parent string, children array<string>")
    key = lambda *c: F.substring(F.sha2(F.concat_ws("/", *c), 256), 1, 36)
    parents = nested.select(key("subject", "parent").alias("id"), F.col("parent").alias("name"), "subject", F.lit("chapter").alias("category"), F.lit(None).cast("string").alias("parent_id"))
    children = nested.select("subject", "parent", F.explode("children").alias("name")).select(key("subject", "parent", "name").alias("id"), "name", "subject", F.lit("topic").alias("category"), key("subject", "parent").alias("parent_id"))
    tags = parents.unionByName(children)
    return tags if existing is None or existing.isEmpty() else tags.limit(0)


def _kind(v: Column) -> Column:
    """object, list, string, number, boolean, null or missing: the form of a VARIANT."""
    said = F.schema_of_variant(v)
    return F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null").when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "list").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").otherwise("number")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _first_text(v: Column) -> Column:
    """The first reading of an object of readings that isn't empty."""
    return F.coalesce(*[_some(_at(v, f"$.{n}", "string")) for n in ("selected", "native", "local_ocr")], F.lit(""))


def _truthy_text(v: Column) -> Column:
    """What stands for an answer that is no object: its text, null where it is empty, zero or false."""
    text = _at(v, "$", "string")
    return F.when(_kind(v).isin("string", "number", "boolean") & ~text.isin("", "0", "0.0", "false"), text)


def _options_of(v: Column) -> Column:
    """Options as (label, content), from an object by label or from a list; null for anything else and for none."""
    by_label = F.transform(F.array_sort(F.map_entries(_at(v, "$", "map<string,string>"))), lambda e: F.struct(e["key"].alias("label"), F.coalesce(e["value"], F.lit("")).alias("content")))
    listed = F.transform(_at(v, "$", "array<variant>"), lambda o: F.struct(_at(o, "$.label", "string").alias("label"), _at(o, "$.content", "string").alias("content")))
    found = F.when(_kind(v) == "object", by_label).when(_kind(v) == "list", listed)
    return F.when(F.size(found) > 0, found)


def mixed_extraction(files: DataFrame, text: str) -> DataFrame:
    """The bank's rows of JSON texts of any form: an object with "questions", a bare list, something else, or broken text.

    The other columns of files, then form, position, source_question_id, question_number, question_type, raw_ocr_content, content, options, answer, explanation,
    score, ocr_confidence, needs_review, review_status. Texts are parsed once, as VARIANT; every field has its own guard, so that a field of
    another type is as if it were missing and stops nothing. Members of a list that are no objects are left out. A broken text is one row to be reviewed
    whose content is the text as it stands; a null one is left out. Figures are appended to the content.
    """
    rest = [c for c in files.columns if c != text]
    # each step is an inline() of one struct, so that the optimiser doesn't copy a step's expressions into the next one's
    parsed = files.where(F.col(text).isNotNull()).select(*rest, text, F.inline(F.array(F.struct(F.try_parse_json(text).alias("_v")))))
    whole = F.col("_v")
    form = F.when(whole.isNull(), "broken").when(_kind(whole).isin("object", "list"), _kind(whole)).otherwise("other")
    listed = F.when(_kind(whole) == "list", _at(whole, "$", "array<variant>")).when(_kind(whole) == "object", _at(whole, "$.questions", "array<variant>"))
    forms = parsed.select(*rest, F.col(text).alias("_raw"), F.inline(F.array(F.struct(form.alias("form"), listed.alias("_listed")))))
    q, keep = F.col("_q"), [*rest, "form", "position"]
    listed_rows = forms.where("form <> 'broken'").select(*rest, "form", F.posexplode("_listed").alias("position", "_q")).where(_kind(q) == "object")
    fields = {n: _at(q, f"$.{n}") for n in ("text", "content", "options", "quality", "answer")}
    plain = {"source_question_id": F.coalesce(_at(q, "$.id", "string"), F.lit("")), "question_number": F.coalesce(_at(q, "$.number", "int"), F.lit(0)), "_type": _at(q, "$.type", "string"), "explanation": _at(q, "$.explanation", "string"), "score": _at(q, "$.score", "double"), "_figures": _at(q, "$.assets.figures", "array<string>")}
    guarded = listed_rows.select(*keep, F.inline(F.array(F.struct(*[v.alias(f"_{n}") for n, v in fields.items()], *[_kind(v).alias(f"_{n}_is") for n, v in fields.items()], *[v.alias(n) for n, v in plain.items()]))))

    is_a = lambda name, *kinds: F.col(f"_{name}_is").isin(*kinds)
    spoken = F.when(is_a("text", "object", "missing"), _first_text(F.col("_text"))).when(is_a("text", "string"), _at(F.col("_text"), "$", "string"))
    stem = F.when(is_a("content", "object"), _some(_at(F.col("_content"), "$.stem", "string")))
    inner = F.when(is_a("content", "object"), _options_of(_at(F.col("_content"), "$.options")))
    answer = F.when(is_a("answer", "object"), _at(F.col("_answer"), "$.content", "string")).otherwise(_truthy_text(F.col("_answer")))
    review = F.when(is_a("quality", "object"), F.coalesce(_at(F.col("_quality"), "$.needs_review", "boolean"), F.lit(True))).otherwise(True)
    confidence = F.when(is_a("quality", "object"), _at(F.col("_quality"), "$.confidence", "double"))
    read = {"_spoken": spoken, "_stem": stem, "options": F.coalesce(inner, F.when(is_a("options", "list"), _options_of(F.col("_options")))), "answer": answer, "ocr_confidence": confidence, "needs_review": review}
    rows = guarded.select(*keep, *plain, F.inline(F.array(F.struct(*[v.alias(n) for n, v in read.items()]))))

    figures = F.transform(F.filter("_figures", lambda f: f.isNotNull()), lambda f: F.concat(F.lit("![figure](asset://"), f, F.lit(")")))
    content = F.trim(F.concat_ws("\n\n", _some(F.coalesce("_stem", "_spoken", F.lit(""))), _some(F.array_join(figures, "\n\n"))), F.lit(" \t\r\n\f\x0b"))
    rows = rows.select("*", F.inline(F.array(F.struct(content.alias("content")))))
    found = rows.select(*keep, "source_question_id", "question_number", corrected_type(F.col("_type"), F.col("content"), F.col("options")).alias("question_type"), F.coalesce("_spoken", "content").alias("raw_ocr_content"), "content", "options", "answer", "explanation", "score", "ocr_confidence", "needs_review")
    broken = forms.where("form = 'broken'").select(*rest, "form", F.col("_raw").alias("raw_ocr_content"), F.col("_raw").alias("content"), F.lit(True).alias("needs_review"))
    return found.unionByName(broken, allowMissingColumns=True).withColumn("review_status", F.when(F.col("needs_review"), "pending").otherwise("approved"))


def append_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Appends rows as one batch of a table. A batch that is written again, by a rerun or a retry, takes the place of its former rows; other batches stay."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def reports(pages: DataFrame, questions: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """The five reports of extracted papers, a row a paper: inspection, manifest, qa, questions, answers.

    pages: paper, page, chars, needs_ocr. questions: paper, number, pages, figures (counts), confidence, needs_review, content.
    answers: paper, number, page, blocks, answer, analysis (operators.extract.split_answers). Pages, questions and answers of one paper are bounded.
    """
    sorted_rows = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    inspection = pages.groupBy("paper").agg(F.count("*").alias("page_count"), F.count_if("needs_ocr").alias("pages_to_read"), sorted_rows("page", "chars", "needs_ocr").alias("pages"))
    matched = questions.select("paper", "number").join(answers.select("paper", "number", F.lit(True).alias("matched")), ["paper", "number"], "left")
    matching = matched.groupBy("paper").agg(F.count_if("matched").alias("matched_count"), F.array_sort(F.collect_list(F.when(F.col("matched").isNull(), F.col("number")))).alias("missing_numbers"))
    numbers = F.array_sort(F.collect_list("number"))
    counts = questions.groupBy("paper").agg(F.count("*").alias("question_count"), numbers.alias("question_numbers"), F.array_sort(F.collect_list(F.when(F.col("pages") > 1, F.col("number")))).alias("cross_page_questions"), F.sum("figures").alias("figure_count"))
    expected = F.when(F.size("question_numbers") > 0, F.sequence(F.lit(1), F.array_max("question_numbers"))).otherwise(F.array().cast("array<int>"))
    absent = F.array_except(expected, "question_numbers")
    warnings = F.array_compact(F.array(F.when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent.cast("array<string>"), ","))), F.when(F.size("missing_numbers") > 0, F.concat(F.lit("without an answer: "), F.array_join(F.col("missing_numbers").cast("array<string>"), ",")))))
    manifest = counts.join(matching, "paper").select("paper", F.lit(2).alias("schema_version"), "question_count", "question_numbers", "cross_page_questions", "figure_count", F.col("matched_count").alias("answer_matched_count"), warnings.alias("warnings"))
    qa = questions.groupBy("paper").agg(F.count_if("needs_review").alias("review_count"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), sorted_rows("number", "confidence", "needs_review").alias("questions"))
    listed = questions.groupBy("paper").agg(sorted_rows("number", "content", "pages", "figures").alias("questions"))
    replies = answers.groupBy("paper").agg(sorted_rows("number", "answer", "analysis", "page").alias("questions"), F.array_sort(F.collect_list(F.when(F.col("blocks") > 1, F.col("number")))).alias("duplicates")).join(matching, "paper", "left")
    return {"inspection": inspection, "manifest": manifest, "qa": qa, "questions": listed, "answers": replies}


def write_reports(found: dict[str, DataFrame], path: str) -> None:
    """Each report as JSON lines in a folder of its name."""
    for name, rows in found.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
