"""Shards by jump consistent hashing: ids keep their shard when shards are appended, but for those the new ones take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import written
from itembank.llm.ranks import ranked

SHARDS = 40
#: Fixed value: the multiplier of the published generator, 2862933555777941757, as high * 2**32 + low with a negative low, so that no product leaves 64 bits.
_MUL_HIGH, _MUL_LOW = 666578663, -2018463491
_MASK = (1 << 32) - 1
#: Most keys need no more jumps than this for a few dozen shards; the rest go on from there.
FIRST_JUMPS = 8


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _moved(high: Column, low: Column, shard: Column) -> Column:
    """The generator's next number, as two halves of 32 bits, with the shard reached."""
    product = low * F.lit(_MUL_LOW) + F.lit(1)
    carried = F.shiftright(product, 32) + _low32(high * F.lit(_MUL_LOW)) + _low32(low * F.lit(_MUL_HIGH))
    return F.struct(_low32(carried).alias("high"), _low32(product).alias("low"), shard.alias("shard"))


def _next_shard(state: Column) -> Column:
    """Where the next jump goes: its 31 highest bits are the random number."""
    return ((state["shard"] + 1) * (F.lit(2147483648.0) / (F.shiftright(state["high"], 1) + 1))).cast("long")


def _jumped(state: Column, shards: int, times: int) -> Column:
    """The state after so many jumps, or fewer where one would leave the shards."""
    onward = lambda s, _: F.when(_next_shard(s) < shards, _moved(s["high"], s["low"], _next_shard(s))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), state, onward)


def with_shards(df: DataFrame, key: Column, shards: int, name: str) -> DataFrame:
    """df with the jump consistent hash of the key, 16 hex digits, among so many shards. A jump goes up at least by one, so that no key needs more jumps than shards."""
    half = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast("long")
    state = F.col("_jump")
    df = df.withColumn("_jump", _moved(half(1), half(9), F.lit(0).cast("long"))).withColumn("_jump", _jumped(state, shards, min(FIRST_JUMPS, shards)))
    if shards > FIRST_JUMPS:
        df = df.withColumn("_jump", F.when(_next_shard(state) < shards, _jumped(state, shards, shards - FIRST_JUMPS)).otherwise(state))
    return df.withColumn(name, F.col("_jump.shard").cast("int")).drop("_jump")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide, whatever other rows there are. grown_shard is the shard among one more:
    the same, or the new one. slot is the place in the shard by ascending id; it comes from rank queries on the shards' bitmaps of ids
    (llm.ranks), so that no task holds a shard. Texts are read once; what is shuffled has a few numbers a row.

    Nulls: a null text has no bytes (size 16, crc32 0). A row without an id takes the md5 of its text as key, so that many of them
    don't meet in one shard, and comes before the others in its shard. Repeated rows of an id share its shard and ascend by the md5 of their text.
    Very long texts: only sizes and digests of them are kept. Empty table: no rows. Other columns aren't read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("tie"))
    key = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.col("tie")).cast("binary")), 1, 16)
    rows = with_shards(with_shards(rows.withColumn("key", key), F.col("key"), shards, "shard"), F.col("key"), shards + 1, "grown_shard")
    rows = written(rows.select("id", "size", "text_crc32", "tie", "grown_shard", F.col("shard").cast("long").alias("g"), F.monotonically_increasing_id().alias("uid")), "shard-rows")
    return ranked(rows, "shard").select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("g").cast("int").alias("shard"), F.col("rank").alias("slot"), "grown_shard")


def query(docs: DataFrame) -> DataFrame:
    return sharded(docs)


#: The sums of crc32 are taken byte by byte, with a table that a rule makes.
SQL = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS crc FROM range(256) r(b)),
t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, md5(text) AS tie, list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT *, hex(encode(text)) AS h FROM t)),
k AS (SELECT uid, doc_id, tie, strlen(text) + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, crc[xor(c, v) % 256 + 1]))) AS text_crc32,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, tie)), 1, 16))::UBIGINT::HUGEINT AS key FROM b, tab),
j AS (SELECT uid, n, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key, 0::BIGINT AS shard FROM k, (VALUES ({SHARDS}), ({SHARDS + 1})) v(n)
      UNION ALL
      SELECT uid, n, (key * 2862933555777941757 + 1) % 18446744073709551616, onward FROM (SELECT *, floor((shard + 1) * (2147483648.0::DOUBLE / ((key >> 33) + 1)::DOUBLE))::BIGINT AS onward FROM j) WHERE onward < n),
s AS (SELECT uid, max(shard) FILTER (n = {SHARDS}) AS shard, max(shard) FILTER (n = {SHARDS + 1}) AS grown FROM j GROUP BY uid)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, tie) - 1 AS slot, grown::INTEGER AS grown_shard
FROM k JOIN s USING (uid)
"""
