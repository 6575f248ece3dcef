"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.llm.common import BROADCAST_IDS, WORD, free_name, small_enough, written

#: Buckets to each unit of keys at first, and documents to a finer bucket at most, about. Only the fine bucket in which a source's budget ends is sorted.
COARSE, BUCKET_ROWS = 1000, 1000
#: Marks that rarely stand in running prose; their share lowers a document's weight.
NOISE = "!$%&*#|{}<>=_~^"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of the characters that aren't noise marks. Empty and null texts weigh 1."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(0.1) + F.lit(0.9) * F.length(F.translate(text, NOISE, "")) / n)


def exponential_key(id_col: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from the id's MD5: the same for every run, row order and partitioning. Small keys come first."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, budget_share: int = 100) -> DataFrame:
    """source, source_size, rows, target: shares of the budget by weight, none above max_epochs times the source.

    sizes: source, source_size, rows. Sources take the weights in the order of their names by code point, null last, again and
    again. What a source can't take is shared by weight among the others: sources are filled in the order of capacity over
    weight, and each is full if it couldn't take its part of what those before it left. Both windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", pick).withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("left", F.floor(F.sum("source_size").over(whole) * budget_share / 100) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(after))
    s = s.withColumn("full", F.col("cap") * F.col("ws") <= F.col("left") * F.col("w"))
    # The first source that isn't full sets the level for all that follow it.
    level = F.min(F.when(~F.col("full"), F.struct(F.row_number().over(fill).alias("at"), "left", "ws")))
    s = s.withColumn("at", F.row_number().over(fill)).withColumn("level", F.min(F.when(~F.col("full"), F.struct("at", "left", "ws"))).over(whole))
    reached = F.col("level").isNotNull() & (F.col("at") >= F.col("level.at"))
    target = F.when(reached, F.col("level.left").cast("double") * F.col("w") / F.col("level.ws")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "rows", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, boundary: str = "cut", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, epochs, part, taken.

    A source gives its complete epochs first (every document once for each), then documents in the order of their
    exponential keys until the rest of the target is used up. part is what the last, incomplete epoch takes of a document, in
    words. boundary="cut": the document at the end of the target gives its first words only, so the source's words meet the
    target but for less than one word; "whole": it is taken or left as a whole, whichever ends nearer.

    The order is never made as a whole. Sums over coarse buckets of keys show in which of them the target ends, sums over its fine
    buckets (at most about BUCKET_ROWS documents each, whatever the weights) in which of those, and only documents of that one are
    sorted. So a source with a third of all rows is spread over all tasks, and no table of sums grows with it but by its share.

    Nulls: null texts have size 0; null sources are one source, last in order; a null id has the key of the empty text. Ties of
    keys are broken by id, then size; rows that are equal in all three are interchangeable. Repeated rows count each.
    row_col: a column that names each row; it is handed on, and ties are then broken by the text's hash and by it.
    Documents of size 0 take nothing. Empty table: no rows. Other columns are not read.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), quality_weight(text).alias("weight"), *([F.xxhash64(text).alias("__hash"), F.col(row_col).alias("__row")] if row_col else []))
    sized = written(sized.withColumn("key", exponential_key(F.col("id"), F.col("weight"))).drop("weight"), "mix-sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(sources, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = written(targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets")

    t = targets.withColumnRenamed("source", "t_source")
    # No weight is above 1, so no stretch of keys holds more than its length's share of a source's documents.
    fine = F.floor(F.col("key") * F.greatest(F.lit(1.0), F.col("rows") / BUCKET_ROWS))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("coarse", F.floor(F.col("key") * COARSE)).withColumn("fine", fine)

    def edge(rows: DataFrame, bucket: str, start: Column, name: str) -> DataFrame:
        """The bucket of each source in which the rest of its target is used up, and the words before it."""
        sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(start).alias("start"))
        run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        ends = sums.where("before < rest AND before + words >= rest")
        return written(ends.select(F.col("source").alias(f"{bucket}_source"), F.col(bucket).alias(f"e_{bucket}"), F.col("before").alias(f"{bucket}_before")), name)

    for bucket, inside, start in (("coarse", "true", F.lit(0)), ("fine", "coarse = e_coarse", F.col("coarse_before"))):
        ends = edge(rows.where(inside), bucket, start, f"mix-{bucket}")
        rows = rows.join(ends, F.col("source").eqNullSafe(F.col(f"{bucket}_source")), "left").drop(f"{bucket}_source")

    order = Window.partitionBy("source").orderBy("key", "id", "size", *(["__hash", "__row"] if row_col else [])).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where("coarse = e_coarse AND fine = e_fine").withColumn("part", F.col("rest") - F.col("fine_before") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    if boundary == "cut":
        inside = inside.withColumn("part", F.greatest(F.lit(0), F.least("size", "part")))
    else:
        inside = inside.withColumn("part", F.when(F.col("part") * 2 >= F.col("size"), F.col("size")).otherwise(0))
    before = F.expr("coarse < e_coarse OR coarse = e_coarse AND fine < e_fine")
    outside = rows.where("NOT coalesce(coarse = e_coarse AND fine = e_fine, false)").withColumn("part", F.when(before, F.col("size")).otherwise(0))
    out = inside.unionByName(outside).withColumn("part", F.col("part").cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *([F.col("__row").alias(row_col)] if row_col else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """docs as the mix takes them, with all their columns: a row for each whole time that a document is taken; those never taken go.

    Documents without words are kept once if their source is taken at all; they change no sum. Each row counts for itself, by a
    key that is written with it: rows without id, and rows that share one, don't share their times.
    """
    columns = docs.columns
    row, often, time = (free_name(docs, n) for n in ("__row", "__times", "__time"))
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(docs, id_col, text_col, source_col, weights, max_epochs, boundary="whole", row_col=row)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("part") > 0).cast("long"))
    times = written(plan.select(row, times.alias(often)).where(F.col(often) > 0), "mix-times")
    taken = docs.join(small_enough(times, BROADCAST_IDS), row)
    return taken.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*columns)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0::DOUBLE
             ELSE 0.1::DOUBLE + 0.9::DOUBLE * length(translate(text, '!$%&*#|{}<>=_~^', '')) / length(text) END AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER o AS rk,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_over,
    (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
  FROM sources WINDOW o AS (ORDER BY source_size * 3 / w, source NULLS LAST)),
level AS (SELECT rk AS l_rk, left_over AS l_left, ws AS l_ws FROM filled WHERE cap * ws > left_over * w ORDER BY rk LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN rk >= l_rk THEN l_left::DOUBLE * w / l_ws ELSE cap::DOUBLE END AS target
  FROM filled LEFT JOIN level ON true),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets)
SELECT doc_id, size, r.source_size, r.target,
  r.epochs * size + greatest(0, least(size, floor(r.target - r.epochs * r.source_size)::BIGINT - coalesce(
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
"""
