"""Training-order materialisation: token sequences in the order of a keyed permutation, in fixed-stride binary shards."""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itembank.llm.common import releasing, shared_dir, small_enough, written
from itembank.llm.packing import cut, default_tokenizer, encoder_of
from itembank.llm.words import mix64

#: Ids of a sequence, bytes of an id, sequences of a shard: 8 MB shards.
LENGTH, WIDTH, SHARD_ROWS = 256, 2, 16_384
ROUNDS = 6
#: At most so many documents' numbers are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of records that a writing task gets, about, where there are more than spark.sql.shuffle.partitions tasks' worth.
TASK_BYTES = 256 << 20
#: Copies of a repeated row that one row of a task stands for.
COPIES = 1000


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of indices below n under a keyed Feistel network; places beyond n walk on along their cycle until they are below."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, low = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> low, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = (left << low) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@releasing
def _counted(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    """With the checksum of each text's ids and the number of its sequences in the text's place."""
    encoder = encoder_of(path)
    for batch in batches:
        for first, ids, to in encoder.encoded(batch.column(3), end_id):
            n, data = len(to) - 1, memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, n) for i in range(3)], pa.array(crc, pa.int64()), pa.array(-(-np.diff(to) // length))], names=["doc", "h", "g", "crc", "k"])


@releasing
def _sequences(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, width: int, n: int, key: int) -> Iterator[pa.RecordBatch]:
    """Each row's sequences with their slots: `copies` times from the number `first` on."""
    encoder = encoder_of(path)
    kind = np.dtype(f"<u{width}")
    for batch in batches:
        for row, ids, to in encoder.encoded(batch.column(1), end_id):
            if width < 4 and ids.max() >= 1 << 8 * width:
                raise ValueError(f"token ids of {int(ids.max())} need more than {width} bytes")
            rows = len(to) - 1
            copies, begin = (batch.column(i).slice(row, rows).to_numpy() for i in (2, 3))
            text, piece, start, size = cut(to, length)
            pieces = np.bincount(text, minlength=rows)
            again = copies[text]
            which = np.repeat(np.arange(len(text)), again)
            copy = np.arange(len(which)) - np.repeat(np.cumsum(again) - again, again)
            text, piece, start, size = text[which], piece[which], start[which], size[which]
            slot = permuted(begin[text] + copy * pieces[text] + piece, n, key)
            narrow = ids.astype(kind)
            at = np.concatenate(([0], np.cumsum(size * width)))
            place = np.arange(int(size.sum()))
            data = narrow[place + np.repeat(to[text] + start - np.cumsum(size) + size, size)]
            blob = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
            doc = batch.column(0).slice(row, rows).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(size, pa.int32()), pc.cast(blob, pa.binary()), pa.array(slot)], names=["doc", "piece", "start", "length", "data", "slot"])


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@releasing
def _shards(batches: Iterator[pa.RecordBatch], uri: str, stride: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Writes shards of rows that come in the order of slots, record by record, each under a name of its own that is then renamed: a task that runs again or twice leaves the same file."""
    store, folder = _store(uri)
    store.create_dir(folder, recursive=True)
    shard = after = own = out = None

    def closed() -> None:
        if out is not None:
            out.close()
            store.move(own, posixpath.join(folder, f"shard-{shard:08d}.bin"))

    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column(batch.schema.get_field_index("slot")).to_numpy()
            data = batch.column(batch.schema.get_field_index("data"))
            crc, cuts = [], [0, *(np.flatnonzero(np.diff(slot // shard_rows)) + 1).tolist(), len(slot)]
            for lo, hi in zip(cuts, cuts[1:]):
                if slot[lo] // shard_rows != shard:
                    closed()
                    shard, after = int(slot[lo] // shard_rows), int(slot[lo] // shard_rows) * shard_rows
                    own = posixpath.join(folder, f"shard-{shard:08d}.bin.{uuid.uuid4().hex}")
                    out = store.open_output_stream(own)
                if not (slot[lo:hi] == after + np.arange(hi - lo)).all():
                    raise RuntimeError(f"shard {shard}: its slots aren't contiguous; did the documents change between two reads?")
                after += hi - lo
                records = data.slice(lo, hi - lo).to_pylist()
                crc += map(zlib.crc32, records)
                out.write(b"".join(r.ljust(stride, b"\0") for r in records))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc", "piece", "start", "length", "slot")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(slot // shard_rows), pa.array(slot % shard_rows * stride), pa.array(crc, pa.int64())], names=["doc", "piece", "start", "length", "slot", "shard", "byte_offset", "crc"])
        closed()
        out = None
    finally:
        if out is not None:  # the task failed or was ended
            out.close()
            store.delete_file(own)


def in_training_order(docs: DataFrame, tokenizer: str, uri: str, key: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = LENGTH, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes the documents' sequences to uri and returns where each is: id, piece, start, length, slot, shard, byte_offset, ids_crc32.

    A document's ids and end_id are cut into sequences of `length`; the last may be shorter and is padded with zeros. Sequences are
    numbered in the order of id, checksum, text hash and piece, whatever the partitions; the Feistel network of the key gives each
    number its slot. Slots of shard_rows make a shard, a file of records of length * width bytes in the order of slots: slot s is at
    byte s % shard_rows * length * width of shard s // shard_rows, so reading goes on anywhere after one seek.

    Texts are encoded twice rather than kept: a first pass counts sequences, sums over id ranges give each document its first
    number, and a second pass sends each sequence straight to the task that has the range of its slot. So the ids are moved once and
    written once. A task writes its shards in order, record by record. Tasks that are run again write the same files; an executor
    that is killed may leave a part of a shard, named like it with a suffix, that no reader looks at.

    Nulls: a null or empty text is end_id alone; a null id comes first in the order. Repeated rows are written each; rows that
    are equal are interchangeable. Empty table: no rows, no shards. Other columns are not read. Ids beyond `width` bytes raise.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"))
    counted = rows.mapInArrow(lambda it: _counted(it, tokenizer, end_id, length), "doc long, h long, g long, crc long, k long")
    texts = counted.groupBy("doc", "h", "g", "crc", "k").agg(F.count("*").alias("copies"))
    texts = written(texts.repartitionByRange(F.col("doc").asc_nulls_first(), "crc", "h", "g").withColumn("part", F.spark_partition_id()), "order-texts")
    parts = texts.groupBy("part").agg(F.sum(F.col("k") * F.col("copies")).alias("in_part"))
    parts = written(parts.withColumn("before", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "order-parts")
    n = parts.agg(F.sum("in_part")).first()[0] or 0
    inside = Window.partitionBy("part").orderBy(F.col("doc").asc_nulls_first(), "crc", "h", "g").rowsBetween(Window.unboundedPreceding, -1)
    first = texts.join(parts, "part").withColumn("first", F.col("before") + F.coalesce(F.sum(F.col("k") * F.col("copies")).over(inside), F.lit(0)))
    first = written(first.select(F.col("doc").alias("t_doc"), F.col("h").alias("t_h"), F.col("g").alias("t_g"), "k", "copies", "first"), "order-first")

    own_first = F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("h") == F.col("t_h")) & (F.col("g") == F.col("t_g"))
    ready = rows.join(small_enough(first, BROADCAST_ROWS), own_first)
    once = ready.where("copies = 1")
    repeated = first.where("copies > 1")
    if not repeated.isEmpty():  # one of the equal rows stands for all, in parts that are dealt over tasks
        spread = rows.join(small_enough(written(repeated, "order-repeated"), BROADCAST_ROWS), own_first).dropDuplicates(["doc", "h", "g"])
        spread = spread.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES)))).repartition("doc", "h", "lo")
        once = once.unionByName(spread.withColumn("first", F.col("first") + F.col("lo") * F.col("k")).withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("lo"))).drop("lo"))
    placed = once.select("doc", "text", "copies", "first").mapInArrow(lambda it: _sequences(it, tokenizer, end_id, length, width, n, key), "doc long, piece int, start long, length int, data binary, slot long")

    stride, shards = length * width, max(1, -(-n // shard_rows))
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * stride // TASK_BYTES)))
    ranges = placed.repartitionById(tasks, F.floor(F.floor(F.col("slot") / shard_rows) * tasks / shards).cast("int")).sortWithinPartitions("slot")
    index = written(ranges.mapInArrow(lambda it: _shards(it, uri, stride, shard_rows), "doc long, piece int, start long, length int, slot long, shard long, byte_offset long, crc long"), "order-index")
    return index.select(F.col("doc").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "slot", "shard", "byte_offset", F.col("crc").alias("ids_crc32"))


def read_slots(uri: str, first: int, n: int, length: int = LENGTH, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """The ids of n slots from the first on, shard by shard, with one seek."""
    store, folder = _store(uri)
    while n > 0:
        shard, at = divmod(first, shard_rows)
        with store.open_input_file(posixpath.join(folder, f"shard-{shard:08d}.bin")) as f:
            f.seek(at * length * width)
            got = f.read(min(n, shard_rows - at) * length * width)
        yield from np.frombuffer(got, dtype=f"<u{width}").reshape(-1, length)
        done = len(got) // (length * width)
        if not done:
            return
        first, n = first + done, n - done


def query(docs: DataFrame) -> DataFrame:
    uri = f"{shared_dir(docs.sparkSession)}/training-{uuid.uuid4().hex}"
    return in_training_order(docs, default_tokenizer(), uri, key=20_240_607)
