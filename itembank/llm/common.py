"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII capitals and what they become. Other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local runs and tests; a cluster without it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: a cut in the lineage that outlives lost executors, with a size that the planner knows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; null becomes the empty text."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows, else as it is, for a shuffled join. df: written out before, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= rows else df


#: At most so many ids are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes for df to have no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def among(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """The rows of docs whose id is (left_semi) or isn't (left_anti) among ids: one column, distinct, not null."""
    key = free_name(docs, "__id")
    return docs.join(small_enough(written(ids.toDF(key), "ids"), BROADCAST_IDS), docs[id_col] == F.col(key), how)


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return among(docs, ids, id_col, "left_anti")


def releasing(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's work that gives freed memory back to the system when it ends: Python workers live on, and executors count all they hold."""
    @wraps(work)
    def run(*args: object, **more: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(*args, **more)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """A worker's large object (an encoder, an automaton with its memories), made once; it goes when a task asks for another."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def by_block(batches: Iterator[pa.RecordBatch], key: str = "block") -> Iterator[pa.Table]:
    """The rows of each value of an integer column, for rows that come sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        part = pa.Table.from_batches([batch])
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[lo]:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


def dealt_in_blocks(members: DataFrame, group: list[str], id_col: str, rows: int) -> DataFrame:
    """Members of groups with a block number each; every two members of a group meet in a block, and no block has more than about 2 * rows of them.

    A group of more than rows members is cut by a hash of the id into parts, and each two parts are a block. within: whether the
    block is one part. members: written out before; without nulls in group.
    """
    large = members.groupBy(*group).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")).where("parts > 1")
    dealt = members.join(small_enough(written(large, "large-groups"), BROADCAST_IDS), group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(id_col), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    dealt = dealt.withColumn("side", side).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("within", F.col("side") == F.col("o")).withColumn("block", F.xxhash64(*group, F.least("side", "o"), F.greatest("side", "o"))).drop("parts", "o")
