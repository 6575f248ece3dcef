"""Quality: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itembank.llm import words
from itembank.llm.common import written
from itembank.llm.toxicity import held_out, labelled

#: At most so many labelled rows are learned from, chosen by a hash of their id.
FIT_ROWS = 8_000
#: They have at most so many distinct words together (4 bytes each); rows beyond, in the order of that hash, are left out of the fit.
FIT_WORDS = 50_000_000
#: Hash buckets of words, bins of each statistic, rank of the factors.
BUCKETS, BINS, RANK = 1 << 16, 12, 8
EPOCHS, STEPS, BATCH, RATE, RIDGE = 8, 250, 256, 0.08, 2e-5
#: Statistics of a text's bytes, lines and words; "bytes" stands for the metadata column n_chars, which follows from the text.
STATS = ("upper", "digit", "space", "mark", "other_mark", "exclaim", "beyond_ascii", "bytes", "line_bytes", "same_lines", "word_bytes", "same_words", "long_words", "one_mark_words")
#: Marks that end or join sentences; all other ASCII marks count as "other_mark".
SENTENCE = b".,;:'\"()-?!"


def _kinds() -> np.ndarray:
    """Byte x kind: what the share statistics count."""
    out = np.zeros((256, 7), dtype=np.int8)
    for b in range(256):
        c = bytes([b])
        mark = 0x21 <= b < 0x7F and not c.isalnum()
        out[b] = (c.isupper(), c.isdigit(), c.isspace(), mark, mark and c not in SENTENCE, c == b"!", b >= 0x80)
    return out


_KINDS = _kinds()


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each row has."""
    if not len(hashes):
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    return np.bincount(r[new], minlength=n)


def statistics(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row of STATS per text; the words' bounds, rows and hashes come with it."""
    n, size = len(at) - 1, np.maximum(np.diff(at), 1)
    out = np.zeros((n, len(STATS)))
    for k in range(7):
        out[:, k] = _sums(_KINDS[:, k][data], at) / size
    out[:, 7] = np.log1p(np.diff(at))
    # Lines: runs between line feeds and ends of texts.
    first = np.union1d(np.flatnonzero(data == 0x0A) + 1, at[:-1])
    first = first[first < len(data)]
    if len(first):
        last = np.concatenate((first[1:], [len(data)]))
        in_row = np.searchsorted(at, first, "right") - 1
        lines = np.bincount(in_row, minlength=n)
        out[:, 8] = np.log1p(size / np.maximum(lines, 1))
        out[:, 9] = 1 - _distinct(words.word_hashes(data, first, last), in_row, n) / np.maximum(lines, 1)
    count, length = np.bincount(row, minlength=n), ends - starts
    some = np.maximum(count, 1)
    out[:, 10] = np.bincount(row, length, n) / some
    out[:, 11] = 1 - _distinct(hashes, row, n) / some
    out[:, 12] = np.bincount(row, length > 20, n) / some
    out[:, 13] = np.bincount(row[(length == 1) & (_KINDS[:, 3][data[starts]] > 0)] if len(starts) else row, minlength=n) / some
    return out


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, statistics, and the distinct hashed words of a group of texts: bucket ids and the texts' offsets in them."""
    for first, data, at in words.row_groups(column):
        starts, ends, row = words.word_bounds(data, at)
        hashes = words.word_hashes(data, starts, ends)
        key = np.unique(row * BUCKETS + (hashes >> np.uint64(48)).astype(np.int64))
        yield first, statistics(data, at, starts, ends, row, hashes), key % BUCKETS, np.concatenate(([0], np.cumsum(np.bincount(key // BUCKETS, minlength=len(at) - 1))))


class Machine:
    """score = w0 + sum w x + half of the sum over factors of (sum v x)**2 - sum v**2 x**2, then the logistic function.

    A text's words weigh 1 / sqrt(their number) each; each statistic is one of BINS indicators, by quantiles of the sample.
    """

    def __init__(self) -> None:
        self.edges = np.zeros((len(STATS), BINS - 1))
        self.bias = 0.0
        self.w = np.zeros(BUCKETS + len(STATS) * BINS, dtype=np.float32)
        self.v = np.zeros((len(self.w), RANK), dtype=np.float32)

    def rows(self, stats: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, their values and the texts' offsets, statistics after words."""
        n, k = len(stats), len(STATS)
        binned = np.column_stack([np.searchsorted(self.edges[j], stats[:, j], "right") + BUCKETS + j * BINS for j in range(k)]) if n else np.zeros((0, k), dtype=np.int64)
        size = np.diff(at)
        to = np.concatenate(([0], np.cumsum(size + k)))
        feature, value = np.zeros(to[-1], dtype=np.int64), np.full(to[-1], 1 / np.sqrt(k), dtype=np.float32)
        place = np.arange(len(ids)) + np.repeat(np.arange(n) * k, size)
        feature[place], value[place] = ids, np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
        stat = (to[1:] - k)[:, None] + np.arange(k)
        feature[stat.reshape(-1)] = binned.reshape(-1)
        return feature, value, to

    def raw(self, feature: np.ndarray, value: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the factors' sums: linear in the number of features."""
        vx = self.v[feature] * value[:, None]
        sums = np.add.reduceat(vx, to[:-1], axis=0)
        return self.bias + np.add.reduceat(self.w[feature] * value, to[:-1]) + 0.5 * (sums**2 - np.add.reduceat(vx**2, to[:-1], axis=0)).sum(axis=1), sums

    def fit(self, stats: np.ndarray, ids: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        """Adagrad on the logistic loss; rows come in a fixed random order."""
        if not len(y) or y.min() == y.max():
            self.bias = 0.0 if not len(y) else 4.0 if y[0] else -4.0
            return
        self.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        rng = np.random.Generator(np.random.PCG64(7))
        self.v = rng.normal(0, 0.05, self.v.shape).astype(np.float32)
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        gw, gv = np.full(self.w.shape, 1e-4, dtype=np.float32), np.full(self.v.shape, 1e-4, dtype=np.float32)
        size = np.diff(at)
        for _ in range(max(EPOCHS, STEPS * BATCH // len(y))):  # small samples are seen more often
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                pick = order[lo : lo + BATCH]
                part = np.concatenate([ids[at[p] : at[p + 1]] for p in pick])
                feature, value, to = self.rows(stats[pick], part, np.concatenate(([0], np.cumsum(size[pick]))))
                raw, sums = self.raw(feature, value, to)
                error = (1 / (1 + np.exp(-raw)) - y[pick]).astype(np.float32)
                text = np.repeat(np.arange(len(pick)), np.diff(to))
                used, slot = np.unique(feature, return_inverse=True)
                e = error[text] * value
                dw = np.bincount(slot, e, len(used)) / len(pick) + RIDGE * self.w[used]
                pull = e[:, None] * (sums[text] - self.v[feature] * value[:, None])
                dv = np.column_stack([np.bincount(slot, pull[:, r], len(used)) for r in range(RANK)]) / len(pick) + RIDGE * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= 0.02 * float(error.mean())

    def score(self, stats: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        raw, _ = self.raw(*self.rows(stats, ids, at))
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, edges=self.edges, bias=self.bias, w=self.w.astype(np.float16), v=self.v.astype(np.float16))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Machine:
        own, found = cls(), np.load(io.BytesIO(data))
        own.edges, own.bias, own.w, own.v = found["edges"], float(found["bias"]), found["w"].astype(np.float32), found["v"].astype(np.float32)
        return own


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, stats, ids, at in features(batch.column(1)):
            n = len(stats)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).cast(pa.int64()), batch.column(2).slice(first, n).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(STATS), pa.int32()), pa.array(stats.reshape(-1))), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=["id", "y", "stats", "ids"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("stats", pa.list_(pa.float64())), ("ids", pa.list_(pa.int32()))])
    table = pa.Table.from_batches([pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, kinds.types)], schema=kinds) for b in batches], schema=kinds).combine_chunks().sort_by("id")
    y = table.column("y").to_numpy().astype(np.float64)
    ids = table.column("ids").combine_chunks()
    at = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))) if len(y) else np.zeros(1, dtype=np.int64)
    machine = Machine()
    machine.fit(np.array(table.column("stats").to_pylist(), dtype=np.float64).reshape(len(y), len(STATS)), ids.flatten().to_numpy().astype(np.int64) if len(y) else np.zeros(0, dtype=np.int64), at, y)
    yield pa.RecordBatch.from_arrays([pa.array([machine.dumps()], pa.binary())], names=["model"])


def fit(sample: DataFrame) -> Machine:
    """Learns from id, text, y: a bounded sample (FIT_ROWS, FIT_WORDS). Features are made where the texts are; one task fits, and the driver sees the model alone."""
    rows = written(sample.select("id", "text", "y").mapInArrow(_featured, "id long, y int, stats array<double>, ids array<int>"), "quality-sample")
    sizes = rows.groupBy("id").agg(F.sum(F.size("ids")).alias("n")).withColumn("h", F.xxhash64("id"))
    fits = sizes.withColumn("sum", F.sum("n").over(Window.orderBy("h", "id"))).where(F.col("sum") <= FIT_WORDS).select("id")  # FIT_ROWS numbers at most
    rows = rows.join(F.broadcast(fits), "id", "left_semi")
    found = rows.repartition(1).mapInArrow(_fitted, "model binary").first()
    return Machine.loads(found["model"]) if found else Machine()  # no rows, no task


def _scored(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    machine = Machine.loads(model)
    for batch in batches:
        for first, stats, ids, at in features(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(stats)), pa.array(machine.score(stats, ids, at))], names=["id", "score"])


def quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id, score (0 to 1, higher: better), predicted (1 if score >= threshold).

    Whole texts are scored where they are read; nothing is shuffled.

    Nulls: a null text is an empty text, whose statistics are zero; a null id stays null. Repeated rows are scored each. Equal
    texts have equal scores. Empty table: no rows. Other columns are not read.
    """
    model, kind = machine.dumps(), dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda it: _scored(it, model), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = fit(labelled(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), "quality", FIT_ROWS))
    return quality(docs, machine).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
