"""Exact deduplication: groups by a 128-bit content hash, compared byte by byte inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import among, fold_ascii, small_enough, without, written

#: At most so many hashes of groups are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = fold_ascii, content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of each group the smallest id stays (keep="largest": the largest).

    Only hashes of rows are shuffled, and the texts of rows whose hash occurs more than once: these are grouped by their
    whole text within the hash, so that two texts with one hash never share a group. Grouping and hashing run in the JVM;
    both aggregate before the shuffle, so a group with a third of all rows leaves one row per task.

    Nulls: a null text is an empty text. A null id counts in its group but is kept only where no id of the group is known.
    Ties and repeated rows: rows with one id are one document; each of them gets the same answer. Empty table: no rows.
    Columns besides id and text are not read, whatever their names.
    """
    best = F.max if keep == "largest" else F.min
    norm = normalise(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", content_hash(F.col("norm")))
    rows = written(texts.select("id", "h", F.sha2("norm", 256).alias("sha")), "exact-rows")
    shared = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact-shared")
    again = texts.join(small_enough(shared, BROADCAST_ROWS), "h", "left_semi")
    same = again.groupBy("h", "norm").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
    groups = written(same.groupBy("h").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("keep_id").alias("keep_id")), "exact-groups")

    def answer(df: DataFrame) -> DataFrame:
        keep_id = F.coalesce("keep_id", F.col("id"))
        return df.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep_id.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))

    mixed = groups.where("texts > 1").select("h")
    if mixed.isEmpty():
        return answer(rows.join(groups.select("h", "n", "keep_id"), "h", "left"))
    apart = again.join(mixed, "h", "left_semi").join(same.select(F.col("h").alias("g"), F.col("norm").alias("same_norm"), "n", "keep_id"), F.expr("h = g AND norm = same_norm"))
    apart = apart.select("id", "n", "keep_id", F.sha2("norm", 256).alias("sha"))
    alone = rows.join(mixed, "h", "left_anti").join(groups.select("h", "n", "keep_id"), "h", "left")
    return answer(alone).unionByName(answer(apart))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of repeated rows of the id that stays, one does; rows without an id, whose group has none, all stay."""
    verdict = written(exact_dedup(docs, id_col, text_col, keep).select(F.col(id_col).alias("__id"), "kept"), "exact-verdict")
    left = without(docs, verdict.where("NOT kept AND __id IS NOT NULL").select("__id").distinct(), id_col)
    gone = verdict.where("NOT kept AND __id IS NULL")
    if not gone.isEmpty():
        left = left.where(F.col(id_col).isNotNull())
    again = written(verdict.where("kept AND __id IS NOT NULL").groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"), "exact-again")
    if again.isEmpty():
        return left
    return without(left, again, id_col).unionByName(among(left, again, id_col, "left_semi").dropDuplicates([id_col]))


def query(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs, keep="largest")


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
