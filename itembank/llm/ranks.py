"""Places of rows within their groups, by rank queries on bitmaps of ids instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.llm.common import written

#: A node of the directories sums 2**FAN_BITS nodes below it; the top one of a group may have TOP_ROWS.
FAN_BITS, TOP_ROWS = 8, 4096
#: Below the word of the least id: the word of rows without an id.
_NO_ID = -(1 << 57) - 1


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """The rows in this order, written out with their number from 0: sorted by ranges, counted by partition."""
    rows = written(df.orderBy(*order).withColumn("number", F.monotonically_increasing_id()), name)
    part = F.shiftright("number", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("start"))
    place = F.col("start") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), part == F.col("part")).withColumn("number", place).drop("part", "start")


def _before(count: str, within: list[str], *order: str) -> Column:
    """The sum of what comes earlier in the same partition."""
    return F.coalesce(F.sum(count).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _directory(words: DataFrame, name: str) -> DataFrame:
    """The words with start, the number of rows of their group in earlier words: sums of sums, each taken over a bounded run."""
    levels = [words]
    while True:
        widest = levels[-1].groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (widest or 0) <= TOP_ROWS:
            break
        above = levels[-1].groupBy("g", F.shiftright("w", FAN_BITS).alias("w")).agg(F.sum("n").alias("n"))
        levels.append(written(above, f"{name}-level"))
    found = levels[-1].withColumn("start", _before("n", ["g"], "w"))
    for level in reversed(levels[:-1]):
        up = found.select("g", F.col("w").alias("up"), F.col("start").alias("up_start"))
        inside = level.withColumn("up", F.shiftright("w", FAN_BITS)).withColumn("start", _before("n", ["g", "up"], "w"))
        found = inside.join(up, ["g", "up"]).withColumn("start", F.col("start") + F.col("up_start")).drop("up", "up_start")
    return found


def _tied(rows: DataFrame) -> DataFrame:
    """rank for rows of words in which an id occurs again: by id, tie and uid, in steps that no repeated id or row makes large.

    A word's rows are counted by id and the first digits of tie, these by tie, these by the partition that uid names.
    """
    rows = rows.withColumn("k", F.coalesce("id", F.lit(0))).withColumn("p", F.substring("tie", 1, 3)).withColumn("part", F.shiftright("uid", 33))
    equal = rows.groupBy("g", "w", "k", "p", "tie").agg(F.count("*").alias("n"))
    runs = equal.groupBy("g", "w", "k", "p").agg(F.sum("n").alias("n"))
    runs = runs.select("g", "w", "k", "p", _before("n", ["g", "w"], "k", "p").alias("a"))
    equal = equal.select("g", "w", "k", "p", "tie", _before("n", ["g", "w", "k", "p"], "tie").alias("b"))
    parts = rows.groupBy("g", "w", "k", "tie", "part").agg(F.count("*").alias("n"))
    parts = parts.select("g", "w", "k", "tie", "part", _before("n", ["g", "w", "k", "tie"], "part").alias("c"))
    own = F.row_number().over(Window.partitionBy("g", "w", "k", "tie", "part").orderBy("uid")) - 1
    placed = rows.withColumn("d", own).join(runs, ["g", "w", "k", "p"]).join(equal, ["g", "w", "k", "p", "tie"]).join(parts, ["g", "w", "k", "tie", "part"])
    return placed.withColumn("rank", F.col("start") + F.col("a") + F.col("b") + F.col("c") + F.col("d")).drop("k", "p", "part", "a", "b", "c", "d")


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """The rows with rank: their place, from 0 without gaps, in group g by ascending id.

    rows: written out before; g long, id long, tie a digest as hex text, uid from monotonically_increasing_id, and any more columns
    but w, n, bits, start. Each group's ids become a compressed bitmap: its 64-bit words that aren't empty, made by partial
    aggregates and merged by OR. A directory holds how many rows precede each word; the rank of an id is that number plus
    the set bits below its own. Nothing is sorted but runs of at most a few thousand sums.

    Rows without an id come first. Rows with one id ascend by tie, rows that tie again by uid.
    """
    rows = rows.withColumn("w", F.when(F.col("id").isNull(), F.lit(_NO_ID)).otherwise(F.shiftright("id", 6)))
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    one, ones = F.expr("1L"), F.expr("-1L")
    shifted = lambda x: F.call_function("shiftleft", x, bit)
    words = written(rows.groupBy("g", "w").agg(F.bit_or(shifted(one)).alias("bits"), F.count("*").alias("n")), f"{name}-words")
    placed = written(_directory(words, name), f"{name}-directory")
    again = F.col("n") != F.bit_count("bits")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(shifted(ones))))
    single = rows.join(placed.where(~again), ["g", "w"]).withColumn("rank", F.col("start") + below)
    if placed.where(again).isEmpty():
        return single.drop("w", "n", "bits", "start")
    return single.unionByName(_tied(rows.join(placed.where(again), ["g", "w"]))).drop("w", "n", "bits", "start")
