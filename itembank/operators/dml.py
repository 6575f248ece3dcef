"""Changes as functions from a table to its next version; tables are immutable Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.session import checkpointed

#: Which job states may follow which.
TRANSITIONS = [("queued", "running"), ("queued", "cancelled"), ("running", "success"), ("running", "failed"), ("running", "cancelled"), ("failed", "queued")]


def patched(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Fields that the patch sends: a struct-valued column <name>_set tells of each that it is meant, even if null."""
    fields = [c for c in patch.columns if c != key and not c.endswith("_set")]
    p = patch.select(F.col(key).alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in fields], *[F.col(f"{c}_set").alias(f"p_{c}_set") for c in fields])
    out = table.join(p, F.col(key) == F.col("p_key"), "left")
    return out.select(*[F.when(F.coalesce(F.col(f"p_{c}_set"), F.lit(False)), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def reviewed(table: DataFrame, chosen: Column, approve: bool) -> DataFrame:
    return table.withColumn("review_status", F.when(chosen, F.lit("approved" if approve else "rejected")).otherwise(F.col("review_status")))


def soft_deleted(table: DataFrame, chosen: Column) -> DataFrame:
    """is_deleted set on chosen live rows; changed tells which. Doing it again changes nothing."""
    return table.withColumn("changed", chosen & ~F.col("is_deleted")).withColumn("is_deleted", F.col("is_deleted") | F.coalesce(chosen, F.lit(False)))


def tagged(links: DataFrame, questions: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Links after giving every question all tags."""
    new = questions.select(F.col("id").alias("question_id"), F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag_id"))
    return links.select("question_id", "tag_id").unionByName(new).distinct()


def not_tagged(links: DataFrame, questions: DataFrame, tags: Sequence[str]) -> DataFrame:
    gone = questions.select(F.col("id").alias("question_id"), F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag_id"))
    return links.join(gone, ["question_id", "tag_id"], "left_anti")


def suggestions_accepted(questions: DataFrame, links: DataFrame, suggested: DataFrame, known: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Questions with empty fields filled, and links with at most three known tags of confident suggestions."""
    s = suggested.select(F.col("id"), F.col("difficulty").alias("s_difficulty"), F.col("question_type").alias("s_type"))
    filled = questions.join(s, "id", "left").withColumn("difficulty", F.coalesce("difficulty", "s_difficulty")).withColumn("question_type", F.coalesce("question_type", "s_type")).drop("s_difficulty", "s_type")
    each = suggested.where(F.col("confidence") >= least).select(F.col("id").alias("question_id"), F.posexplode("tag_ids").alias("at", "tag_id")).join(known.select("tag_id"), "tag_id", "left_semi")
    each = each.withColumn("rn", F.row_number().over(Window.partitionBy("question_id").orderBy("at"))).where("rn <= 3")
    return filled, links.select("question_id", "tag_id").unionByName(each.select("question_id", "tag_id")).distinct()


def cascade(parent: DataFrame, children: Sequence[tuple[DataFrame, str, str]], gone: Column, key: str) -> list[DataFrame]:
    """The parent without gone rows, then each child table (table, foreign key, own key) without rows of gone parents, level by level."""
    out, left = [parent.where(~gone)], parent.where(gone).select(F.col(key).alias("gone_key"))
    for table, foreign, own in children:
        out.append(table.join(left, F.col(foreign) == F.col("gone_key"), "left_anti"))
        left = table.join(left, F.col(foreign) == F.col("gone_key"), "left_semi").select(F.col(own).alias("gone_key"))
    return out


def without_subtree(tags: DataFrame, root: object) -> DataFrame:
    """Tags without one tag and all below it, level by level until a level is empty, each written out before the next; a tag that is its own ancestor ends its branch. The driver sees whether a level is empty, no more."""
    level = gone = checkpointed(tags.where(F.col("id") == root).select(F.col("id").alias("gone_key")))
    while not level.isEmpty():
        below = tags.join(level, F.col("parent_id") == F.col("gone_key")).select(F.col("id").alias("below_key")).distinct()
        level = checkpointed(below.join(gone, F.col("below_key") == F.col("gone_key"), "left_anti").withColumnRenamed("below_key", "gone_key"))
        gone = checkpointed(gone.unionByName(level))
    return tags.join(gone, F.col("id") == F.col("gone_key"), "left_anti")


def deleted(table: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """The table without chosen rows (a null choice keeps a row), and one row that counts the deleted ones."""
    gone = F.coalesce(chosen, F.lit(False))
    return table.where(~gone), table.agg(F.count_if(gone).alias("deleted"))


def get_or_create(table: DataFrame, default: DataFrame, *order: str) -> DataFrame:
    """The first row of the table in the given order, or the default row where the table has none."""
    both = table.withColumn("__made", F.lit(1)).unionByName(default.withColumn("__made", F.lit(2)))
    return both.orderBy("__made", *order).limit(1).drop("__made")


def evolved(table: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """The table with new columns and their defaults; columns that it has already stay as they are."""
    return table.select("*", *[value.alias(name) for name, value in columns.items() if name not in table.columns])


def transitions(log: DataFrame, job: str, status: str, *order: str, allowed: Sequence[tuple[str, str]] = tuple(TRANSITIONS)) -> DataFrame:
    """Every event with the state before it and whether it may follow."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(*order))
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("before") == a) & (F.col(status) == b))
    return log.withColumn("before", before).withColumn("allowed", F.when(F.col("before").isNull(), F.lit(True)).otherwise(ok))


def current_state(log: DataFrame, job: str, status: str, at: str) -> DataFrame:
    """The latest event of each job: aggregated, not sorted."""
    return log.groupBy(job).agg(F.max_by(status, at).alias("status"), F.max(at).alias("since"), F.count("*").alias("events"))


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys (null-safe) aren't there yet are added."""
    r, t = rows.alias("r"), table.select(*[F.col(k).alias(f"t_{k}") for k in keys]).distinct()
    fresh = r.join(t, [F.col(f"r.{k}").eqNullSafe(F.col(f"t_{k}")) for k in keys], "left_anti")
    return table.unionByName(fresh.select(*table.columns))


#: Settings that a blank value doesn't replace.
SECRETS = ("api_key", "ai_api_key")


def settings_updated(settings: DataFrame, new: Mapping[str, str | None], secrets: Sequence[str] = SECRETS) -> DataFrame:
    """Sent values replace old ones, blank ones too; a blank secret leaves the old one."""
    for name, value in new.items():
        if value or name not in secrets:
            settings = settings.withColumn(name, F.lit(value).cast(settings.schema[name].dataType))
    return settings


def suggestions_or_default(questions: DataFrame, suggested: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """Every question with its suggestion: known tags, at most three, in the order given; confidence 0 and no tags where there is none."""
    each = suggested.select(F.col("id"), F.posexplode("tag_ids").alias("at", "tag_id")).join(known.select("tag_id").distinct(), "tag_id", "left_semi")
    tags = each.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "tag_id"))), 1, most).alias("t")).select("id", F.transform("t", lambda x: x["tag_id"]).alias("tags"))
    out = questions.select("id").join(suggested.select("id", "confidence"), "id", "left").join(tags, "id", "left")
    return out.select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
