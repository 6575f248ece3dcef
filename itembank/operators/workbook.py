"""Practices and worksheets: order, numbers, sections, layout, runs, content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.functions.dictionaries import ordinal, section_rank


def renumbered(rows: DataFrame, parent: str, *order: str | Column, name: str = "number", start: int = 1) -> DataFrame:
    """Contiguous numbers within each parent. The one place where positions are made: adding, moving and deleting all end here."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1 + start)


def next_positions(existing: DataFrame, new: DataFrame, parent: str, key: str, order: str, position: str = "position") -> DataFrame:
    """Rows to append: new keys that the parent doesn't have yet, each once, positions after its last one (from 0)."""
    first = new.withColumn("rn", F.row_number().over(Window.partitionBy(parent, key).orderBy(order))).where("rn = 1").drop("rn")
    fresh = first.join(existing.select(parent, key), [parent, key], "left_anti")
    last = existing.groupBy(parent).agg(F.max(position).alias("last"))
    at = F.row_number().over(Window.partitionBy(parent).orderBy(order)) + F.coalesce(F.col("last"), F.lit(-1))
    return fresh.join(last, parent, "left").withColumn(position, at).drop("last")


def reordered(rows: DataFrame, wanted: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Positions from a list of (key, new_position); rows that the list doesn't name keep theirs."""
    return rows.join(wanted, key, "left").withColumn(position, F.coalesce("new_position", position)).drop("new_position")


def subset_reordered(rows: DataFrame, wanted: DataFrame, key: str, parent: str, position: str = "position") -> DataFrame:
    """The visible rows in the order of (key, new_position), in the places that visible rows had; the others stay."""
    seen = rows.join(wanted, key)
    places = seen.withColumn("k", F.row_number().over(Window.partitionBy(parent).orderBy(position))).select(parent, "k", F.col(position).alias("place"))
    turns = seen.withColumn("k", F.row_number().over(Window.partitionBy(parent).orderBy("new_position"))).select(parent, "k", key)
    moved = turns.join(places, [parent, "k"]).select(key, "place")
    return rows.join(moved, key, "left").withColumn(position, F.coalesce("place", position)).drop("place")


#: Rows that one task sorts, about.
PART_ROWS = 1_000_000


def _in_parts(rows: DataFrame, parent: str) -> DataFrame:
    """Dealt by parent once for all windows, to as many parts as keep a task's rows about the same, however many there are; no fewer than the session's."""
    parts = -(-rows.count() // PART_ROWS)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, parent) if parts > usual else rows.repartition(parent)


def grouped_by_type(rows: DataFrame, parent: str, label: str, order: str) -> DataFrame:
    """section (from 0) and number (from 1): labels in the fixed order, unknown ones after them as they first come."""
    first = F.min(order).over(Window.partitionBy(parent, label))
    ranked = _in_parts(rows, parent).withColumn("rank", section_rank(F.col(label))).withColumn("first", F.when(F.col("rank") > 10, first))
    w = Window.partitionBy(parent)
    unknown_last = [F.col("rank"), F.col("first")]
    ranked = ranked.withColumn("number", F.row_number().over(w.orderBy(*unknown_last, order)))  # before the section, whose order is a prefix: one sort serves both
    return ranked.withColumn("section", F.dense_rank().over(w.orderBy(*unknown_last)) - 1).drop("rank", "first")


def moved(rows: DataFrame, parent: str, section: str, position: str, chosen: Column, to: Column) -> DataFrame:
    """Chosen rows at the end of another section; then positions within sections (from 0) and numbers anew. Empty sections vanish."""
    there = rows.withColumn("moved", chosen).withColumn(section, F.when(F.col("moved"), to).otherwise(F.col(section)))
    there = there.withColumn("at", F.row_number().over(Window.partitionBy(parent, section).orderBy("moved", position)) - 1)
    return renumbered(there, parent, section, "at").drop(position, "moved").withColumnRenamed("at", position)


def segments(blocks: DataFrame, parent: str, order: str, opens: Column) -> DataFrame:
    """segment, segment_title ordinal and question ordinal: a block that opens a segment carries it forward to the next; leading blocks are in segment 0."""
    w = Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocks.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    out = out.withColumn("question_number", F.when(~opens, F.sum(F.when(opens, 0).otherwise(1)).over(w)))
    return out.withColumn("segment_label", F.when(opens, ordinal(F.col("segment"))))


def without_empty_titles(blocks: DataFrame, parent: str, order: str, is_title: Column) -> DataFrame:
    """Blocks without titles that another title or the end follows."""
    after = F.lead(F.when(is_title, 1).otherwise(0), 1, 1).over(Window.partitionBy(parent).orderBy(order))
    return blocks.withColumn("drop", is_title & (after == 1)).where("NOT drop").drop("drop")


def layout(sections: DataFrame, items: DataFrame) -> DataFrame:
    """One row per block: each section's title, then its questions. sections: practice, section, title; items: practice, section, position, question."""
    titles = sections.select("practice", "section", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("position"), F.lit("subtitle").alias("type"), F.col("title").cast("string").alias("ref"))
    refs = items.select("practice", "section", F.lit(1).alias("kind"), F.col("position").cast("long").alias("position"), F.lit("question_ref").alias("type"), F.col("question").cast("string").alias("ref"))
    return renumbered(titles.unionByName(refs), "practice", "section", "kind", "position", "ref", name="block", start=0).drop("kind")


#: Kinds of layout blocks.
BLOCKS = ("subtitle", "question_ref", "custom_text", "spacer", "page_break")


def valid_blocks(raw: DataFrame, column: str = "blocks") -> DataFrame:
    """posexploded known blocks of an array of structs, in order, with defaults filled in; unknown kinds go."""
    known = F.filter(column, lambda b: b["type"].isin(*BLOCKS))
    out = raw.withColumn("b", known).select(*[c for c in raw.columns if c != column], F.posexplode("b").alias("position", "b"))
    return out.select(*[c for c in raw.columns if c != column], "position", F.col("b.type").alias("type"), F.coalesce("b.title", F.lit("")).alias("title"), F.coalesce("b.show_title", F.lit(True)).alias("show_title"), F.when(F.col("b.type") == "spacer", F.coalesce("b.height", F.lit(20))).alias("height"))


def islands(rows: DataFrame, parent: str, kind: str, *order: str) -> DataFrame:
    """Runs of equal kind: parent, run, kind, n, first and last value of the order."""
    w = Window.partitionBy(parent).orderBy(*order)
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("new", new).withColumn("run", run).groupBy(parent, "run", kind).agg(F.count("*").alias("n"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))


def content_of(blocks: DataFrame, parent: str, order: str) -> DataFrame:
    """The text of ordered blocks (type, content): texts trimmed, pictures wrapped, joined by empty lines."""
    part = F.when((F.col("type") == "text") & (F.trim("content") != ""), F.trim("content")).when((F.col("type") == "image") & (F.col("content") != ""), F.concat(F.lit("![图]("), "content", F.lit(")")))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col(order).alias("at"), part.alias("text")))))
    return blocks.groupBy(parent).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("content"))


def unified(blocks: DataFrame, types: Sequence[str], default: str) -> DataFrame:
    """The default style where a block of these types has none; adjusted tells where."""
    bare = F.col("type").isin(*types) & (F.coalesce("style", F.lit("")) == "")
    return blocks.withColumn("adjusted", bare).withColumn("style", F.when(bare, default).otherwise(F.col("style")))


def briefs(headers: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Headers with the number of their children, 0 for none: one aggregate and one join."""
    n = children.groupBy(key).agg(F.count("*").alias("n_children"))
    return headers.join(n, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def nested(practices: DataFrame, sections: DataFrame, items: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """practice, sections: array of sections in order, each with its questions in order, these with their blocks in order if they are given.

    blocks: practice, question, and what a block has, the place first. Built from the inside out: each level is gathered by the key of the next, so that
    no join multiplies rows. Sections, questions and blocks of one practice are bounded.
    """
    question = ["position", "question"]
    if blocks is not None:
        own = [c for c in blocks.columns if c not in ("practice", "question")]
        gathered = blocks.groupBy("practice", "question").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("blocks"))
        items, question = items.join(gathered, ["practice", "question"], "left"), [*question, "blocks"]
    inner = items.groupBy("practice", "section").agg(F.array_sort(F.collect_list(F.struct(*question))).alias("questions"))
    outer = sections.join(inner, ["practice", "section"], "left").groupBy("practice").agg(F.array_sort(F.collect_list(F.struct("section", "title", "questions"))).alias("sections"))
    return practices.join(outer, "practice", "left")


def regroup_plan(rows: DataFrame, parent: str, label: str, order: str) -> DataFrame:
    """Rows whose number would change if the practice were grouped by type, with both numbers."""
    now = renumbered(rows, parent, order, name="old_number")
    return grouped_by_type(now, parent, label, order).where("old_number != number")


def inserted(blocks: DataFrame, new: DataFrame, parent: str, segment: str, order: str) -> DataFrame:
    """New blocks (parent, segment, and the rest) at the end of their segment, else in a segment of their own at the end; then positions anew, from 0."""
    both = blocks.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)), allowMissingColumns=True)
    known = F.max(F.when(F.col("new") == 0, 1)).over(Window.partitionBy(parent, segment)).isNotNull()
    start = F.when(known, F.min(F.when(F.col("new") == 0, F.col(order))).over(Window.partitionBy(parent, segment)))
    return renumbered(both.withColumn("start", start), parent, F.col("start").asc_nulls_last(), segment, "new", F.col(order).asc_nulls_last(), name="position", start=0).drop("start", "new")


def snapshots(questions: DataFrame, practice: Column, prefix: str) -> DataFrame:
    """Copies of questions for a practice: asset references point into it, and the copy knows its source and version."""
    body = F.regexp_replace("content", r"asset://(?!practice/)", f"asset://practice/{prefix}/")
    return questions.select(practice.alias("practice"), F.col("id").alias("source_question_id"), body.alias("content"), "question_type", "difficulty", F.lit(False).alias("is_modified"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("source_version"))


def restored(copies: DataFrame, questions: DataFrame, prefix: str) -> DataFrame:
    """Copies as their sources are now; copies whose source is gone stay as they are. changed tells which had another version."""
    now = snapshots(questions, F.lit(None), prefix).select(F.col("source_question_id").alias("q"), F.col("content").alias("q_content"), F.col("question_type").alias("q_type"), F.col("difficulty").alias("q_difficulty"), F.col("source_version").alias("q_version"))
    j = copies.join(now, F.expr("source_question_id = q"), "left").withColumn("found", F.col("q").isNotNull())
    pick = lambda new, old: F.when(F.col("found"), F.col(new)).otherwise(F.col(old)).alias(old)
    return j.select("practice", "source_question_id", pick("q_content", "content"), pick("q_type", "question_type"), pick("q_difficulty", "difficulty"), F.when(F.col("found"), F.lit(False)).otherwise(F.col("is_modified")).alias("is_modified"), pick("q_version", "source_version"), (F.col("found") & (F.col("q_version") != F.col("source_version"))).alias("changed"))


#: Page settings where none are stored, for practices made before and after layouts.
LEGACY, CURRENT = {"size": "A4", "columns": "1", "font_size": "12"}, {"size": "A4", "columns": "2", "font_size": "10.5"}


def page_settings(practices: DataFrame, stored: str = "page_config", has_layout: str = "has_layout") -> DataFrame:
    """Each setting as stored, or the default of the practice's kind where the key is missing; a stored null counts as stored."""
    config = F.from_json(stored, "map<string,string>")
    keys = F.coalesce(F.map_keys(config), F.array().cast("array<string>"))
    value = lambda k: F.when(F.array_contains(keys, k), F.try_element_at(config, F.lit(k))).otherwise(F.when(F.col(has_layout), CURRENT[k]).otherwise(LEGACY[k])).alias(k)
    return practices.select("practice", *[value(k) for k in LEGACY])


def numbered_blocks(blocks: DataFrame, questions: DataFrame, by: str, position: str, type_col: str, ref: str) -> DataFrame:
    """Layout blocks in order: titles with their place among titles, questions joined to their snapshot (columns other than by and ref) with their number; references that no snapshot answers are skipped."""
    snaps = questions.select(F.col(by).alias("q_by"), F.col(ref).alias("q_ref"), *[c for c in questions.columns if c not in (by, ref)])
    is_ref = F.col(type_col) == "question_ref"
    out = blocks.join(snaps, is_ref & (F.col(by) == F.col("q_by")) & (F.col(ref) == F.col("q_ref")), "left").where(~is_ref | F.col("q_ref").isNotNull())
    run = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda cond: F.when(cond, F.sum(F.when(cond, 1).otherwise(0)).over(run)).cast("int")
    return out.withColumn("number", count(is_ref)).withColumn("title_number", count(F.col(type_col) == "subtitle")).drop("q_by", "q_ref")


def blocks_changed(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """The blocks of questions after a set of changes, with dense positions from 0 and is_modified for all of a changed question's blocks.

    blocks: question, block, position, type, content, style. changes: question, seq, op, block, and of these what the op needs: add (type,
    content, style) puts a block at the end; update (content_set, content, style_set, style) gives values, the last of a field counts; move (to)
    puts a block before the one that has this position; delete takes it away, whatever else the set says about it. Changes of unknown blocks do nothing.
    """
    of = lambda op: changes.where(F.col("op") == op)
    last = lambda flag, value: F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(flag), F.col("seq")))
    news = of("update").groupBy("question", "block").agg(last("content_set", "content").alias("c"), last("style_set", "style").alias("s"))
    moves = of("move").groupBy("question", "block").agg(F.max_by("to", "seq").alias("to"))
    kept = blocks.join(of("delete").select("question", "block").distinct(), ["question", "block"], "left_anti")
    kept = kept.join(news, ["question", "block"], "left").join(moves, ["question", "block"], "left")
    kept = kept.select("question", "block", "type", F.when(F.col("c").isNotNull(), F.col("c.v")).otherwise(F.col("content")).alias("content"), F.when(F.col("s").isNotNull(), F.col("s.v")).otherwise(F.col("style")).alias("style"), F.coalesce("to", "position").cast("long").alias("at"), F.when(F.col("to").isNull(), 1).otherwise(0).alias("late"), F.col("position").cast("long").alias("then"))
    added = of("add").join(of("delete").select("question", "block"), ["question", "block"], "left_anti").select("question", "block", "type", "content", "style", F.lit(None).cast("long").alias("at"), F.lit(2).alias("late"), F.col("seq").cast("long").alias("then"))
    dense = renumbered(kept.unionByName(added), "question", F.asc_nulls_last("at"), "late", "then", "block", name="position", start=0)
    touched = changes.join(blocks.select("question", "block").unionByName(added.select("question", "block")).distinct(), ["question", "block"], "left_semi").select("question").distinct().withColumn("is_modified", F.lit(True))
    return dense.select("question", "block", "position", "type", "content", "style").join(touched, "question", "left").withColumn("is_modified", F.coalesce("is_modified", F.lit(False)))


#: Titles of sections that a layout names without a title, and of the one for questions before any.
UNTITLED, UNGROUPED = "小节", "未分组"


def layout_synced(sections: DataFrame, questions: DataFrame, layout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and questions as a saved layout has them.

    sections: practice, section, position, title, show_title, new_page, kind. questions: practice, question, section, position, number. layout:
    practice, at, type (subtitle, question_ref, others), section, title, show_title, new_page, kind, question.

    A subtitle stands for its section, or for a new one (its id is a digest of practice and place), and gives it its settings; of several for one
    section the last does. References belong to the last subtitle before them; those before any to the stored section that comes first, or to a
    new one if none is stored. Referenced questions get their section, place and number from the layout, of several references
    the last; the others keep theirs. Places in each section are made dense from 1; unknown references do nothing, nothing is deleted.
    """
    run = Window.partitionBy("practice").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = sections.select(F.col("practice").alias("k_practice"), F.col("section").alias("known"))
    own = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("/", F.col("practice").cast("string"), F.col("at").cast("string")), 256), 1, 12))
    blocks = layout.join(known, F.expr("practice = k_practice AND section = known"), "left").drop("k_practice")
    title = F.col("type") == "subtitle"
    blocks = blocks.withColumn("opened", F.when(title, F.coalesce("known", own))).drop("known", "section")
    blocks = blocks.withColumn("under", F.last("opened", ignorenulls=True).over(run))
    first = sections.groupBy("practice").agg(F.min_by("section", F.struct("position", "section")).alias("first"), F.count("*").alias("stored"))

    refs = blocks.where(F.col("type") == "question_ref").select("practice", "at", "under", "question").join(questions.select("practice", "question").distinct(), ["practice", "question"], "left_semi")
    refs = refs.join(first, "practice", "left").withColumn("target", F.coalesce("under", "first", F.concat(F.lit("new-"), F.substring(F.sha2(F.col("practice").cast("string"), 256), 1, 12))))
    refs = renumbered(refs, "practice", "at", name="q_number")
    refs = refs.withColumn("q_place", F.row_number().over(Window.partitionBy("practice", "target").orderBy("at")))
    placed = refs.groupBy("practice", "question").agg(F.max_by(F.struct("at", "target", "q_number", "q_place"), "at").alias("r"))
    moved_in = F.col("r").isNotNull() & ~F.col("r.target").eqNullSafe(F.col("section"))
    there = questions.join(placed, ["practice", "question"], "left").withColumn("late", moved_in.cast("int"))
    there = there.select("practice", "question", F.coalesce("r.target", "section").alias("section"), F.coalesce("r.q_place", "position").alias("place"), "late", F.when(moved_in, F.col("r.at")).otherwise(F.col("position")).alias("then"), F.coalesce("r.q_number", "number").alias("number"))
    at = F.row_number().over(Window.partitionBy("practice", "section").orderBy(F.asc_nulls_last("place"), "late", "then", "question"))
    questions_now = there.withColumn("position", at).select("practice", "question", "section", "position", "number")

    said = blocks.where(title).groupBy("practice", F.col("opened").alias("section")).agg(F.min("at").alias("first_at"), F.max_by(F.struct("title", "show_title", "new_page", "kind"), "at").alias("b"), F.max_by(F.col("kind"), F.when(F.col("kind").isNotNull(), F.col("at"))).alias("b_kind"), F.max_by(F.col("title"), F.when(F.coalesce("title", F.lit("")) != "", F.col("at"))).alias("b_title"))
    lone = refs.where("under IS NULL AND first IS NULL").select("practice", F.col("target").alias("section")).distinct().withColumn("lone", F.lit(True))
    all_now = sections.join(said, ["practice", "section"], "full_outer").join(lone, ["practice", "section"], "full_outer").withColumn("lone", F.coalesce("lone", F.lit(False)))
    order = Window.partitionBy("practice").orderBy(F.asc_nulls_last("position"), F.desc("lone"), "first_at", "section")
    new_place = F.coalesce(F.col("stored"), F.lit(0)) + F.count_if(F.col("position").isNull()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    all_now = all_now.join(first.select("practice", "stored"), "practice", "left").withColumn("place", F.coalesce("position", new_place))
    in_layout = F.col("b").isNotNull()
    name = F.coalesce("b_title", "title", F.when(F.col("lone"), UNGROUPED).otherwise(UNTITLED))
    shown = F.when(in_layout, F.coalesce("b.show_title", F.lit(True))).otherwise(F.coalesce("show_title", F.lit(True)))
    paged = F.when(in_layout, F.coalesce("b.new_page", F.lit(False))).otherwise(F.coalesce("new_page", F.lit(False)))
    sections_now = all_now.select("practice", "section", F.col("place").cast("int").alias("position"), name.alias("title"), shown.alias("show_title"), paged.alias("new_page"), F.coalesce("b_kind", "kind", F.lit("custom")).alias("kind"))
    return sections_now, questions_now


def regroup_changes(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """practice, change, detail: what grouping by type would change, before it is done.

    sections: practice, section, position, title, kind (custom: someone's own); questions: practice, question, section, position, number, label.
    order: the labels in their fixed order, where the titles of sections aren't that; merge: a label whose questions lie under several titles; move: a question
    that leaves a section of someone's own.
    """
    titled = sections.select("practice", "section", "title", "kind", F.col("position").alias("s_position"))
    rows = questions.join(titled, ["practice", "section"])
    listed = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(what)), lambda x: x["label"]), "、")
    labels = rows.groupBy("practice", "label").agg(F.min(F.struct("s_position", "position")).alias("first")).select("practice", F.struct(section_rank(F.col("label")).alias("rank"), F.when(section_rank(F.col("label")) > 10, F.col("first")).alias("first"), "label").alias("l"))
    wanted = labels.groupBy("practice").agg(listed(F.col("l")).alias("wanted"))
    titles = titled.where("kind <> 'custom'").groupBy("practice", "title").agg(F.min("s_position").alias("at"))
    found = titles.groupBy("practice").agg(listed(F.struct("at", F.col("title").alias("label"))).alias("found"))
    order = wanted.join(found, "practice", "full_outer").where(F.coalesce("wanted", F.lit("")) != F.coalesce("found", F.lit(""))).select("practice", F.lit("order").alias("change"), F.coalesce("wanted", F.lit("")).alias("detail"))
    merge = rows.groupBy("practice", "label").agg(F.count_distinct("title").alias("n")).where("n > 1").select("practice", F.lit("merge").alias("change"), F.col("label").alias("detail"))
    move = rows.where("kind = 'custom'").select("practice", F.lit("move").alias("change"), F.concat_ws(":", F.col("number").cast("string"), "title", "label").alias("detail"))
    return order.unionByName(merge).unionByName(move)


def regrouped(sections: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and questions grouped by type: a section for each label in the fixed order, unknown labels after them as they first come, then the sections of someone's own, now empty.

    Questions keep their order and are numbered anew. Doing it again changes nothing.
    """
    titled = sections.select("practice", "section", F.col("position").alias("s_position"))
    rows = renumbered(questions.join(titled, ["practice", "section"]).drop("number"), "practice", "s_position", "position", "question", name="place")
    grouped = grouped_by_type(rows.drop("section"), "practice", "label", "place")
    at = F.row_number().over(Window.partitionBy("practice", "section").orderBy("place")) - 1
    questions_now = grouped.select("practice", "question", F.concat(F.lit("type-"), "label").alias("section_id"), "section", "label", "place", "number").withColumn("position", at).select("practice", "question", F.col("section_id").alias("section"), "position", "number", "label", F.col("section").alias("s"))
    made = questions_now.select("practice", "section", F.col("s").alias("position"), F.col("label").alias("title"), F.col("label").alias("kind")).distinct()
    counts = made.groupBy("practice").agg(F.count("*").alias("n"))
    own = renumbered(sections.where("kind = 'custom'"), "practice", "position", "section", name="k", start=0).join(counts, "practice", "left")
    sections_now = made.unionByName(own.select("practice", "section", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("int").alias("position"), "title", "kind"))
    return sections_now, questions_now.drop("s")
