"""Near deduplication of texts: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm import words
from itembank.llm.common import BROADCAST_IDS, by_block, releasing, small_enough, without, written
from itembank.llm.graph import connected_components

#: At a Jaccard similarity of 0.8, 42 bands of 6 bins miss a pair with probability (1 - 0.8**6)**42 < 3e-6.
BANDS, BAND_BINS, BINS = 42, 6, 256
#: At most so many ids or buckets are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The seed of the hashes that confirm links; candidates are found by those of seed 0, so that what collides in one set of hashes doesn't in the other.
CONFIRM = 1
#: Texts and shingles of one centre that a block holds, about; a centre with more has several blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 4_000_000


def _donors() -> tuple[np.ndarray, np.ndarray]:
    """For every bin the order in which an empty bin asks the others, and each bin's place in that order."""
    keys = words.mix64(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)).reshape(BINS, BINS)
    order = np.argsort(keys, axis=1)
    return order, np.argsort(order, axis=1)


_ORDER, _PLACE = _donors()


def signatures(sets: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set: the least hash in each bin; an empty bin takes that of the first full bin in its own random order, so that empty bins choose independently of each other."""
    n = len(to) - 1
    text = np.repeat(np.arange(n), np.diff(to))
    place = text * BINS + (sets >> np.uint64(56)).astype(np.int64)
    least = np.ones(len(place), dtype=bool)
    least[1:] = place[1:] != place[:-1]  # sets are ascending, and the bin is the top byte
    sig = np.zeros(n * BINS, dtype=np.uint64)
    sig[place[least]] = sets[least]
    full = np.zeros(n * BINS, dtype=bool)
    full[place[least]] = True
    sig, full = sig.reshape(n, BINS), full.reshape(n, BINS)
    bins = full.sum(axis=1)
    few = np.flatnonzero((bins > 0) & (bins <= 16))
    if len(few):  # look at each full bin rather than at each step of the order
        best = np.full((len(few), BINS), BINS, dtype=np.int64)
        rest = full[few]
        while rest.any():
            some = rest.any(axis=1)
            one = np.where(some, rest.argmax(axis=1), 0)
            best = np.where(some[:, None], np.minimum(best, _PLACE[:, one].T), best)
            rest[np.arange(len(few)), one] = False
        donor = _ORDER[np.arange(BINS)[None, :], best]
        sig[few] = np.where(full[few], sig[few], sig[few[:, None], donor])
    t, b = np.nonzero(~full & (bins > 16)[:, None])
    for step in range(BINS):
        if not len(t):
            break
        donor = _ORDER[b, step]
        hit = full[t, donor]
        sig[t[hit], b[hit]] = sig[t[hit], donor[hit]]
        t, b = t[~hit], b[~hit]
    return sig


def _print(sets: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A fingerprint of each set: the sum of its members, mixed once more."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words.mix64(sets + np.uint64(11)), dtype=np.uint64)))
    return (sums[to[1:]] - sums[to[:-1]]).view(np.int64)


@releasing
def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, at in words.row_groups(batch.column(1)):
            sets, to = words.shingle_sets(data, at, k)
            n, size = len(at) - 1, np.diff(to)
            sig = signatures(sets, to)[:, : BANDS * BAND_BINS].reshape(n, BANDS, BAND_BINS)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
            for i in range(BAND_BINS):
                band = words.mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            full = size > 0
            print_ = [_print(sets, to), _print(*words.shingle_sets(data, at, k, CONFIRM))]
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * BANDS))), pa.int32()), pa.array(band[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(size, pa.int64()), pa.array(print_[0]), pa.array(print_[1]), bands], names=["id", "n", "p", "q", "bands"])


@releasing
def _with_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, at in words.row_groups(batch.column(1)):
            sets, to = words.shingle_sets(data, at, k, CONFIRM)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(at) - 1), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(sets.view(np.int64)))], names=["id", "s"])


@releasing
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that span each block's components, from its full sets; and (id, null) for members of a block that is a part (`cut`) which aren't in their centre's component there.

    The block's first text is compared with all others at once, then each that isn't in one component with all others yet, so a
    block of near copies takes few steps. Texts of one component aren't compared with each other; `known` texts are in one already.
    """
    for block in by_block(batches):
        block = block.combine_chunks().sort_by("id")
        ids, column = block.column("id").to_numpy(), block.column("s").combine_chunks()
        centre, known, cut = (block.column(c).to_numpy() for c in ("centre", "known", "cut"))
        size = column.value_lengths().to_numpy().astype(np.int64)
        _, shingle = np.unique(column.flatten().to_numpy(), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(size)))
        label, mark, a, b = np.arange(len(ids)), np.zeros(int(shingle.max()) + 1, dtype=bool), [], []
        for c in np.unique(centre[known]):
            one = np.flatnonzero(known & (centre == c))
            label[one] = label[one[0]]
        for o in range(len(ids)):
            other = (label != label[o]) & (100 * np.minimum(size, size[o]) >= percent * np.maximum(size, size[o]))
            if not other.any():
                if (label == label[0]).all():
                    break
                continue
            mark[shingle[at[o] : at[o + 1]]] = True
            shared = np.add.reduceat(mark[shingle], at[:-1], dtype=np.int64)
            mark[shingle[at[o] : at[o + 1]]] = False
            near = other & (100 * shared >= percent * (size + size[o] - shared))
            for new in np.unique(label[near]):
                a.append(ids[o])
                b.append(ids[np.flatnonzero(near & (label == new))[0]])
                label[label == new] = label[o]
        own = np.searchsorted(ids, centre)  # a part holds its centre
        far = np.flatnonzero(cut & (label != label[np.minimum(own, len(ids) - 1)]))
        if a or len(far):
            none = pa.nulls(len(far), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.array(a, dtype=np.int64)), pa.array(ids[far])]), pa.concat_arrays([pa.array(np.array(b, dtype=np.int64)), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(centre[far])])], names=["a", "b", "centre"])


def _confirmed(spokes: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """a, b: links that span the components of each centre's members (columns centre, id, n).

    A centre with few members is one block. The members of others are dealt over parts, each with the centre. A member that is
    connected with the centre inside its part is so with all others that are; only those that aren't go on to the other parts. So
    a group of near copies costs its size, and what isn't near its centre is still compared with all members.
    """
    ids = written(spokes.select("id").distinct(), "near-ids")
    chosen = texts.join(small_enough(ids, BROADCAST_ROWS), "id", "left_semi")
    sets = chosen.mapInArrow(lambda it: _with_sets(it, shingle_words), "id long, s array<long>")

    def linked(blocks: DataFrame) -> DataFrame:
        dealt = blocks.join(sets, "id").repartition("block").sortWithinPartitions("block")
        return written(dealt.select("block", "id", "centre", "known", "cut", "s").mapInArrow(lambda it: _linked(it, percent), "a long, b long, centre long"), "near-links")

    parts = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = written(spokes.groupBy("centre").agg(parts.alias("parts")).where("parts > 1"), "near-large")
    dealt = spokes.join(small_enough(large, BROADCAST_IDS), "centre", "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    dealt = dealt.where("parts IS NULL OR id != centre").select("centre", "id", "part", F.col("parts").isNotNull().alias("cut"))
    centres = large.select("centre", F.col("centre").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("cut"))
    first = linked(dealt.unionByName(centres).withColumn("known", F.lit(False)).withColumn("block", F.xxhash64("centre", "part")))
    links, far = first.where("b IS NOT NULL").select("a", "b"), first.where("b IS NULL").select("centre", F.col("a").alias("id"))
    if far.isEmpty():
        return links
    far = written(far.join(large, "centre").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "near-far")
    lots = written(far.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("lots")), "near-lots")
    far = far.join(lots, "centre").withColumn("lot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("lots")).cast("int"))
    beside = far.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other != part").select("centre", "id", F.col("other").alias("part"), "lot", F.lit(False).alias("known"))
    members = dealt.where("cut").join(small_enough(lots, BROADCAST_IDS), "centre")
    near = F.col("f_id").isNull()
    members = members.join(far.select(F.col("centre").alias("f_centre"), F.col("id").alias("f_id")), F.expr("centre = f_centre AND id = f_id"), "left")
    members = members.select("centre", "id", "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), near.alias("known"))
    second = linked(members.unionByName(beside).withColumn("cut", F.lit(False)).withColumn("block", F.xxhash64("centre", "part", "lot")))
    return links.unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets A, B of distinct shingles; component_id is the
    smallest id reachable over links, kept tells whether that is the row's own id. Words are runs of non-space characters, A-Z as
    a-z. Ids are integers.

    Documents with the same set (by fingerprints of two independent hashes of all shingles) become one representative. Representatives that share a band's values are in one bucket, and each
    bucket hands its members to its smallest id: the star's centre. Candidates are these spokes, so they grow with the documents,
    not with their square. The sets of a centre's members (64-bit hashes of all shingles, independent of those that found the candidates), made from the
    texts again for candidates alone, come together in blocks of bounded size, where they are confirmed in full, centre first (_confirmed); only links that
    span components leave the task. Every two texts that share a band have a common centre, so none but pairs without a common
    band are missed (fewer than 3 in a million at the threshold).

    Nulls: a null text has no shingles; a null id is linked with nothing, has a null component and is kept. Texts without words
    have an empty set and are linked with nothing. Repeated rows: rows with one id are one document. Empty table: no rows.
    Columns besides id and text are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(lambda it: _signed(it, shingle_words), "id long, n long, p long, q long, bands array<long>"), "near-signed")
    known = signed.where("n > 0 AND id IS NOT NULL")
    copies = known.groupBy("n", "p", "q").agg(F.min("id").alias("rep"))
    same_set = [F.col(f"{c}").eqNullSafe(F.col(f"r_{c}")) for c in "npq"]
    members = written(signed.drop("bands").join(copies.select("rep", *[F.col(c).alias(f"r_{c}") for c in "npq"]), same_set, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "near-members")

    reps = members.where("id = rep").select("rep").distinct()
    in_bands = known.join(reps, F.expr("id = rep"), "left_semi").select("id", "n", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("a"), F.max(F.struct("id", "n")).alias("b"), F.count("*").alias("k"))
    buckets = written(buckets.where("k > 1 AND a.id < b.id").select("bucket", "a", "b", "k"), "near-buckets")
    of_two = buckets.where(F.expr(f"k = 2 AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")).select(F.col("a.id").alias("centre"), F.explode(F.array("a", "b")).alias("m")).select("centre", "m.id", "m.n")
    larger = buckets.where("k > 2").select("bucket", F.col("a.id").alias("centre"))
    of_more = in_bands.join(small_enough(larger, BROADCAST_ROWS), "bucket").select("centre", "id", "n")
    spokes = written(of_two.unionByName(of_more).distinct(), "near-spokes")

    links = written(_confirmed(spokes, texts, shingle_words, percent).distinct(), "near-confirmed")
    component = connected_components(links, "near-components")
    found = members.join(component, F.expr("rep = node"), "left").withColumn("component_id", F.coalesce("component", "rep", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: one document of each component, rows without id as they are."""
    gone = near_duplicates(docs, id_col, text_col, shingle_words, percent).where("NOT kept").select(F.col(id_col).alias("__id")).distinct()
    return without(docs, gone, id_col)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle_words=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON s.doc_id = c.node
"""
