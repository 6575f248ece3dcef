"""From positioned text to questions: as-of, range and overlap joins, anchors, answers, reconciled readings."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itembank.functions.text import numbers_with_units, review_score, unit_warnings


def with_heading(rows: DataFrame, parent: str, at: Sequence[str], is_heading: Column, value: str) -> DataFrame:
    """Every row that isn't a heading, with the value of the last heading strictly before it: one sort in each parent, no join."""
    w = Window.partitionBy(parent).orderBy(*at, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("side", F.when(is_heading, 1).otherwise(0)).withColumn("heading", F.last(F.when(is_heading, F.col(value)), ignorenulls=True).over(w))
    return marked.where("side = 0").drop("side")


def anchor_ranges(rows: DataFrame, parent: str, at: str, is_anchor: Column, is_break: Column) -> DataFrame:
    """Each anchor with its natural end (the next anchor) and its end: the first break strictly inside, or the natural end."""
    after = Window.partitionBy(parent).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.where(is_anchor | is_break).withColumn("anchor", is_anchor)
    marked = marked.withColumn("next_anchor", F.last(F.when(is_anchor, F.col(at)), ignorenulls=True).over(after)).withColumn("next_break", F.last(F.when(is_break, F.col(at)), ignorenulls=True).over(after))
    ends = F.when(F.col("next_break") < F.coalesce("next_anchor", F.col("next_break") + F.expr("interval 1 second")), F.col("next_break")).otherwise(F.col("next_anchor"))
    return marked.where("anchor").withColumn("end_at", ends).drop("anchor")


def pages_covered(ranges: DataFrame, start: str, end: str, y0: str, y1: str, top: float, bottom: float) -> DataFrame:
    """One row for each page of a range, with the part of the page that it covers."""
    out = ranges.withColumn("page", F.explode(F.sequence(F.col(start), F.col(end))))
    return out.withColumn("from_y", F.when(F.col("page") == F.col(start), F.col(y0)).otherwise(F.lit(top))).withColumn("to_y", F.when(F.col("page") == F.col(end), F.col(y1)).otherwise(F.lit(bottom)))


def _on_cells(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows dealt to cells, joined by a shuffle: the planner guesses their size from the file before rows were multiplied, and would broadcast millions."""
    return left.join(right.hint("merge"), [*on])


def overlaps(left: DataFrame, right: DataFrame, on: Sequence[str], cell: float, least: float = 0.0) -> DataFrame:
    """Pairs whose intervals [x0, x1) share more than least. left: l_id, l0, l1; right: r_id, r0, r1; both with the columns on.

    Intervals are dealt to cells of a fixed width, so the join has an equality besides on; a pair counts in the first cell
    that both touch.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    a = left.withColumn("cell", F.explode(cells("l0", "l1")))
    b = right.withColumn("cell", F.explode(cells("r0", "r1")))
    shared = F.least("l1", "r1") - F.greatest("l0", "r0")
    first = F.col("cell") == F.greatest(F.floor(F.col("l0") / cell), F.floor(F.col("r0") / cell))
    return _on_cells(a, b, [*on, "cell"]).where(first & (shared > least)).withColumn("shared", shared).drop("cell")


#: Fixed value: pictures less wide or high than this, in points, are ornaments.
LEAST_SIDE = 40.0


def _gridded(df: DataFrame, cell: float) -> DataFrame:
    """The rectangles x0, y0, x1, y1 once for each cell of a grid that they touch: cx, cy."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return df.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))


def figures(pictures: DataFrame, segments: DataFrame, cell: float = 200.0, least: float = LEAST_SIDE) -> DataFrame:
    """Pictures that lie in questions: question, figure, xref, page, x0, y0, x1, y1 of what they share.

    pictures: page, xref, place (its order on the page), x0, y0, x1, y1; segments: question, segment, page, x0, y0, x1, y1. Both are dealt to
    the cells of a grid, so that a page with many of them is joined cell by cell; a pair counts in the first cell that both touch.
    Ornaments go by the size of the whole picture, not of the part inside. A picture counts once for a question: with all its
    places in the first segment where it has any. figure numbers them in the order of segments and places.
    """
    seen = pictures.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    a = _gridded(seen, cell).select("page", "cx", "cy", "xref", "place", F.struct("x0", "y0", "x1", "y1").alias("p"))
    b = _gridded(segments.where("x1 > x0 AND y1 > y0"), cell).select("page", "cx", "cy", "question", "segment", F.struct("x0", "y0", "x1", "y1").alias("q"))
    low, high = (lambda c: F.greatest(f"p.{c}", f"q.{c}")), (lambda c: F.least(f"p.{c}", f"q.{c}"))
    first = (F.col("cx") == F.floor(low("x0") / cell)) & (F.col("cy") == F.floor(low("y0") / cell))
    shared = _on_cells(a, b, ["page", "cx", "cy"]).where(first).select("question", "segment", "page", "xref", "place", low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1")).where("x1 > x0 AND y1 > y0")
    earliest = F.min("segment").over(Window.partitionBy("question", "xref"))
    kept = shared.withColumn("earliest", earliest).where("segment = earliest")
    number = F.row_number().over(Window.partitionBy("question").orderBy("segment", "place", "xref", "x0", "y0", "x1", "y1"))
    return kept.select("question", number.alias("figure"), "xref", "page", "x0", "y0", "x1", "y1")


def token_agreement(left: DataFrame, right: DataFrame, by: str, left_tokens: Column, right_tokens: Column) -> DataFrame:
    """Per key: the multiset Jaccard of two readings' tokens, 1 if neither has any. left, right: one row a key."""
    def counted(df: DataFrame, tokens: Column, name: str) -> DataFrame:
        return df.select(by, F.explode(tokens).alias("token")).groupBy(by, "token").agg(F.count("*").alias(name))

    both = counted(left, left_tokens, "a").join(counted(right, right_tokens, "b"), [by, "token"], "full_outer").na.fill(0, ["a", "b"])
    sums = both.groupBy(by).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum(F.greatest("a", "b")).alias("all"))
    keys = left.select(by).join(right.select(by), by)  # one row a key on both sides
    return keys.join(sums, by, "left").select(by, F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("all", F.lit(0)).alias("all"), F.coalesce(F.round(F.col("shared") / F.col("all"), 4), F.lit(1.0)).alias("agreement"))


def unit_conflicts(readings: DataFrame, by: str, native: str, other: str) -> DataFrame:
    """Per key and unit that both readings have: whether their sets of numbers differ with neither inside the other."""
    def sets(column: str, name: str) -> DataFrame:
        return readings.select(by, F.explode(numbers_with_units(F.col(column))).alias("t")).groupBy(by, F.col("t.unit").alias("unit")).agg(F.array_sort(F.collect_set("t.number")).alias(name))

    both = sets(native, "native_numbers").join(sets(other, "other_numbers"), [by, "unit"])
    differ = (F.size(F.array_except("native_numbers", "other_numbers")) > 0) & (F.size(F.array_except("other_numbers", "native_numbers")) > 0)
    return both.withColumn("conflict", differ)


def best_sequence(anchors: Sequence[tuple[int, float, int]]) -> list[int]:
    """Indices of the best rising run of numbers that starts at 1, in reading order.

    A step scores 10 less the numbers it skips; ties go to the longer run, then to fewer skips, then to the larger last number.
    """
    order = sorted(range(len(anchors)), key=lambda i: anchors[i][:2])
    state: dict[int, tuple[float, int, int, int | None]] = {}
    for place, i in enumerate(order):
        number = anchors[i][2]
        options = [(10.0, 1, 0, None)] if number == 1 else []
        for j in order[:place]:
            if j in state and anchors[j][2] < number:
                s, n, skipped, _ = state[j]
                gap = number - anchors[j][2] - 1
                options.append((s + 10.0 - gap, n + 1, skipped - gap, j))
        if options:
            state[i] = max(options, key=lambda o: o[:3])
    if not state:
        return []
    at: int | None = max(state, key=lambda i: (*state[i][:3], anchors[i][2]))
    run = []
    while at is not None:
        run.append(at)
        at = state[at][3]
    return run[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _best_places(pages: pd.Series, ys: pd.Series, numbers: pd.Series) -> pd.Series:
    return pd.Series([best_sequence(list(zip(p, y, n))) for p, y, n in zip(pages, ys, numbers)])


def chosen_anchors(candidates: DataFrame, parent: str, page: str, y: str, number: str) -> DataFrame:
    """parent, page, y, number of the candidates that make up each parent's best sequence. A paper has at most a few hundred candidates, so they fit one array."""
    found = F.array_sort(F.collect_list(F.struct(page, y, number)))
    each = lambda c: F.transform("found", lambda a: a[c])
    papers = candidates.groupBy(parent).agg(found.alias("found")).withColumn("best", _best_places(each(page), each(y), each(number)))
    chosen = F.explode(F.transform("best", lambda i: F.element_at("found", i + 1)))
    return papers.select(parent, chosen.alias("a")).select(parent, f"a.{page}", f"a.{y}", f"a.{number}")


def answer_blocks(lines: DataFrame, parent: str, order: str, text: str) -> DataFrame:
    """Numbered blocks of an answer text: a line "7." or "7、" opens one, later lines belong to it; lines before the first go.

    parent, number, body, answer: what follows an answer mark, else the letters after 故选; of repeated numbers the first counts.
    """
    opens = F.regexp_extract(text, r"^\s*(\d{1,2})\s*[.．、]", 1)
    w = Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("number", F.nullif(opens, F.lit("")).cast("int")).withColumn("block", F.sum(F.when(F.col("number").isNotNull(), 1).otherwise(0)).over(w)).where("block > 0")
    rest = F.trim(F.when(F.col("number").isNotNull(), F.regexp_replace(text, r"^\s*\d{1,2}\s*[.．、]", "")).otherwise(F.col(text)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rest != "", F.struct(F.col(order).alias("at"), rest.alias("t"))))), lambda x: x["t"]), "\n")
    blocks = marked.groupBy(parent, "block").agg(F.max("number").alias("number"), body.alias("body"))
    mark = F.nullif(F.trim(F.regexp_extract("body", r"【答案】([^\n]*)", 1)), F.lit(""))
    choice = F.nullif(F.regexp_extract("body", r"故选[：:]\s*([A-D]{1,4})", 1), F.lit(""))
    first = F.row_number().over(Window.partitionBy(parent, "number").orderBy("block"))
    return blocks.withColumn("answer", F.coalesce(mark, choice)).withColumn("rn", first).where("rn = 1").drop("rn", "block")


#: A number with points, anywhere in a line; a number before a bracket, at its start; titles of sections; page footers; marks of answers.
STRONG = r"(?:[（(]\s*多选\s*[）)])?\s*(\d{1,2})\s*[\.．、]\s*[（(]\s*\d+\s*分\s*[）)]?"
WEAK = r"^\s*(?:[（(]\s*多选\s*[）)])?\s*(\d{1,2})\s*[\.．、]\s*(?=[（(【])"
SECTION, FOOTER, ANSWER_MARK = r"^\s*[一二三四五六七八九十]+\s*、", r"第\s*\d+\s*页[（(]共\s*\d+\s*页[）)]", r"【\s*答案\s*】\s*([^\n]*)"


def answer_pieces(pages: DataFrame, parent: str, page: str, text: str) -> DataFrame:
    """The lines of pages in turn, cut in two at an anchor: parent, page, line, piece, number (of an anchor), said. Footers, blank lines and pieces go.

    What stands before an anchor in its line is a piece of its own, without a number; the anchor opens the piece after it.
    """
    lines = pages.select(parent, page, F.posexplode(F.split(F.regexp_replace(text, FOOTER, ""), "\n")).alias("line", "raw")).withColumn("said", F.trim(F.col("raw"), F.lit(" \t\r\f\x0b"))).where("said != ''")
    strong, weak = F.regexp_instr("said", F.lit(STRONG)), F.regexp_instr("said", F.lit(WEAK))
    cut = F.when(strong > 0, F.struct(strong.alias("at"), F.regexp_extract("said", STRONG, 0).alias("mark"), F.regexp_extract("said", STRONG, 1).alias("n"))).when(weak > 0, F.struct(weak.alias("at"), F.regexp_extract("said", WEAK, 0).alias("mark"), F.regexp_extract("said", WEAK, 1).alias("n")))
    lines = lines.withColumn("cut", cut)
    piece = lambda number, said: F.struct(number.cast("int").alias("number"), F.trim(said, F.lit(" \t\r\f\x0b")).alias("said"))
    at, mark = F.col("cut.at"), F.col("cut.mark")
    none = F.lit(None).cast("int")
    pieces = F.when(at.isNull(), F.when(F.regexp_like("said", F.lit(SECTION)), F.array(piece(none, F.lit("")))).otherwise(F.array(piece(none, F.col("said"))))).otherwise(F.array(piece(none, F.substring(F.col("said"), F.lit(1), at - 1)), piece(F.col("cut.n"), F.substring(F.col("said"), at + F.length(mark), F.length("said")))))
    return lines.select(parent, page, "line", F.posexplode(pieces).alias("piece", "p")).select(parent, page, "line", "piece", "p.number", "p.said").where("number IS NOT NULL OR said != ''")


def split_answers(pages: DataFrame, parent: str, page: str, text: str) -> DataFrame:
    """parent, number, page, blocks, answer, analysis: the answers of a paper by number, over lines and pages.

    A piece belongs to the last number before it, wherever that stood; pieces before the first go. Of repeated numbers the first counts, blocks
    tells how many there are. answer: what follows an answer mark, else the letters after 故选. analysis: the whole block, null if it is empty.
    """
    order = [F.col(page), F.col("line"), F.col("piece")]
    so_far = Window.partitionBy(parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = answer_pieces(pages, parent, page, text).withColumn("block", F.count("number").over(so_far)).where("block > 0")
    said = F.array_sort(F.collect_list(F.when(F.col("said") != "", F.struct(*order, F.col("said")))))
    blocks = pieces.groupBy(parent, "block").agg(F.max("number").alias("number"), F.min(F.when(F.col("number").isNotNull(), F.col(page))).alias(page), F.array_join(F.transform(said, lambda s: s["said"]), "\n").alias("body"))
    marked = F.nullif(F.trim(F.regexp_extract("body", ANSWER_MARK, 1)), F.lit(""))
    chosen = F.nullif(F.regexp_extract("body", r"故选[：:]\s*([A-D]{1,4})", 1), F.lit(""))
    first = F.min(F.struct("block", F.col(page), "body"))
    return blocks.groupBy(parent, "number").agg(first.alias("f"), F.count("*").alias("blocks")).select(parent, "number", f"f.{page}", "blocks", F.col("f.body").alias("body")).select(parent, "number", page, "blocks", F.coalesce(marked, chosen).alias("answer"), F.nullif("body", F.lit("")).alias("analysis"))


#: A line that opens a question, and one that is a page header.
ANCHOR = r"^\s*(?:[（(]\s*多选\s*[）)])?\s*(\d{1,2})\s*(?:[．、：，,]|\.(?!\d))\s*(?:[（(]\s*\d+\s*分\s*[）)])?"
HEADER = r"^\s*第\s*\d+\s*页"


def candidate_anchors(lines: DataFrame, by: Sequence[str], y: str, text: str) -> DataFrame:
    """Lines that may open a question: number 1 to 99, no page headers; of lines with one number at the same height (2 digits) one."""
    number = F.regexp_extract(text, ANCHOR, 1)
    found = lines.where(~F.regexp_like(text, F.lit(HEADER)) & (number != "")).withColumn("number", number.cast("int")).where("number BETWEEN 1 AND 99")
    place = [*by, "number", F.round(y, 2).alias("at")]
    return found.select(*place, F.col(y).alias("y"), F.trim(text).alias("line")).groupBy(*by, "number", "at").agg(F.min(F.struct("y", "line")).alias("f")).select(*by, "number", "f.y", "f.line")


def with_answers(questions: DataFrame, answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every question with the answer of its number, the least one if there are several; questions without one keep nulls."""
    own = [c for c in answers.columns if c not in (*by, *questions.columns)]
    first = answers.groupBy(*by).agg(F.min(F.struct(*own)).alias("_first")).select(*by, "_first.*")
    return questions.join(first, list(by), "left")


def fused(readings: DataFrame, by: str, native: str, other: str, native_score: Column, confidence: Column, least: float = 0.85) -> DataFrame:
    """by, conflicts, warnings, formula_lines, review_score, needs_review, agreement of two readings of each key.

    Numbers are compared only where both readings have text and the other one has a confidence; warnings and lines with marks of
    lost formulas are those of the native text, or of the other one where it is empty. agreement: the multiset Jaccard of measured
    numbers, null where they aren't compared.
    """
    base = readings.select(F.col(by), F.coalesce(F.col(native), F.lit("")).alias("a"), F.coalesce(F.col(other), F.lit("")).alias("b"), native_score.alias("score"), confidence.alias("confidence"))
    both = base.where("a != '' AND b != '' AND confidence IS NOT NULL")
    conflicts = unit_conflicts(both, by, "a", "b").where("conflict").groupBy(by).agg(F.count("*").cast("int").alias("conflicts"))
    agreed = token_agreement(both.select(by, "a"), both.select(by, "b"), by, numbers_with_units(F.col("a")), numbers_with_units(F.col("b"))).select(by, "agreement")
    text = F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b"))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[\ufffd□]"))))
    out = base.withColumn("warnings", F.size(unit_warnings(text))).withColumn("formula_lines", lines).drop("a", "b").join(conflicts, by, "left").join(agreed, by, "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    out = out.withColumn("review_score", review_score(F.col("score"), F.col("confidence"), F.col("conflicts") > 0, F.col("warnings")))
    return out.select(by, "conflicts", "warnings", "formula_lines", "review_score", ((F.col("review_score") < least) | (F.col("conflicts") > 0)).alias("needs_review"), "agreement")


def zipped(inputs: DataFrame, results: DataFrame, by: str, items: str, found: str) -> DataFrame:
    """Array items beside the results at the same place; a short list of results leaves nulls."""
    a = inputs.select(by, F.posexplode(items).alias("at", "item"))
    b = results.select(by, F.posexplode(found).alias("at", "result"))
    return a.join(b, [by, "at"], "left")


def mean_confidence(lines: DataFrame, by: str, text: str, confidence: str, order: str) -> DataFrame:
    """Per key the lines' text in order and their mean confidence, 4 digits; no lines with text give an empty text and 0."""
    some = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    parts = F.array_sort(F.collect_list(F.when(some, F.struct(F.col(order).alias("at"), F.col(text).alias("t")))))
    return lines.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"), F.coalesce(F.round(F.avg(F.when(some, F.col(confidence))), 4), F.lit(0.0)).alias("confidence"))
