"""Near deduplication of embeddings by randomly rotated binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import by_block, dealt_in_blocks, written
from itembank.llm.graph import connected_components

#: Chance that a pair at the threshold agrees in no band.
MISS = 1e-6
#: Rotations that an estimate averages, and its bound in standard deviations (one side).
ROTATIONS, SIGMAS = 4, 6.0
#: Vectors of a bucket that one block holds; larger buckets are cut into blocks, and all pairs of blocks are compared.
BLOCK_ROWS = 1500


def band_shape(rows: int, cosine: float) -> tuple[int, int]:
    """Bits to a band and number of bands: bits follow the rows, so buckets stay small; bands follow the bits, so MISS holds at every size."""
    bits = min(28, max(8, math.ceil(math.log2(max(rows, 2)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def rotations(dim: int, n: int) -> np.ndarray:
    """n random rotations of dim dimensions, the same on every executor: dim x (n * dim)."""
    rng = np.random.Generator(np.random.PCG64(20_240_607 + dim))
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _coded(batches: Iterator[pa.RecordBatch], bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Binary codes of all rotations (packed), the correction factors of the first ROTATIONS, and the value of each band."""
    turn: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            need = max(ROTATIONS, math.ceil(bits * bands / dim))
            if dim not in turn:
                turn[dim] = rotations(int(dim), need)
            x = _matrix(part.column("v"), int(dim))
            x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
            for lo in range(0, len(x), 4096):
                y = (x[lo : lo + 4096] / np.linalg.norm(x[lo : lo + 4096], axis=1, keepdims=True)) @ turn[dim]
                code = y > 0
                factor = np.abs(y[:, : ROTATIONS * dim]).reshape(len(y), ROTATIONS, dim).sum(axis=2) / math.sqrt(dim)
                value = code[:, : bits * bands].reshape(len(y), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
                packed = np.packbits(code, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).slice(lo, len(y)) for c in ("id", "label", "dim", "v", "weight")],
                        pa.array([p.tobytes() for p in packed], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * ROTATIONS, pa.int32()), pa.array(factor.reshape(-1).astype(np.float32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * bands, pa.int32()), pa.array(value.reshape(-1))),
                    ],
                    names=["id", "label", "dim", "v", "weight", "code", "factor", "bands"],
                )


def _links(ids: np.ndarray, side: np.ndarray, within: bool, band: int, x: np.ndarray, code: np.ndarray, factor: np.ndarray, bits: int, bands: int, turn: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one block that are linked. A pair belongs to the first band in which it agrees, so no other block counts it."""
    n, dim = x.shape
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    own = np.triu(np.ones((n, n), dtype=bool), 1) if within else side[:, None] < side[None, :]
    bit = np.unpackbits(code, axis=1)
    if dim >= 16:  # below, the bound tells nothing
        signs = bit[:, : ROTATIONS * dim].astype(np.float32).reshape(n, ROTATIONS, dim) * 2 - 1
        rotated = (unit @ turn[:, : ROTATIONS * dim]).astype(np.float32).reshape(n, ROTATIONS, dim)
        estimate, spread = np.zeros((n, n), dtype=np.float32), np.zeros(n)
        for r in range(ROTATIONS):
            estimate += (signs[:, r] / (math.sqrt(dim) * factor[:, r : r + 1])) @ rotated[:, r].T / ROTATIONS
            spread += (1 / factor[:, r].astype(np.float64) ** 2 - 1) / (dim - 1) / ROTATIONS**2
        own &= estimate + SIGMAS * np.sqrt(np.maximum(spread, 1e-9)).astype(np.float32)[:, None] >= cosine
    i, j = np.nonzero(own)
    values = bit[:, : bits * bands].reshape(n, bands, bits)[:, :band] @ (1 << np.arange(bits, dtype=np.int64))
    found: list[tuple[np.ndarray, np.ndarray]] = [(i[:0], j[:0])]
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        first = ~(values[a] == values[b]).any(axis=1) & (ids[a] != ids[b])
        a, b = a[first], b[first]
        u, w = x[a], x[b]
        exact = np.einsum("ij,ij->i", u, w) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", w, w)))
        found.append((a[exact >= cosine], b[exact >= cosine]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compared(batches: Iterator[pa.RecordBatch], bits: int, bands: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block come in; per linked row of a block its links there, weighted, and the smallest id reachable there."""
    turn: dict[int, np.ndarray] = {}

    def one(block: pa.Table) -> pa.RecordBatch | None:
        ids, side, weight = (block.column(c).to_numpy() for c in ("id", "side", "weight"))
        dim, band = block.column("dim")[0].as_py(), block.column("band")[0].as_py()
        if dim not in turn:
            turn[dim] = rotations(dim, ROTATIONS)
        code = np.frombuffer(b"".join(block.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        factor = np.array(block.column("factor").to_pylist(), dtype=np.float32)
        x = _matrix(block.column("v").combine_chunks(), dim)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and no square over- or underflows
        a, b = _links(ids, side, block.column("within")[0].as_py(), band, x, code, factor, bits, bands, turn[dim], cosine)
        if not len(a):
            return None
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        hit, root = np.flatnonzero(links > 0), ids.copy()
        while True:  # the smallest id reachable inside the block
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, low[a])
            if (low == root).all():
                break
            root = low
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], names=["id", "links", "root"])

    for block in by_block(batches):
        if (out := one(block)) is not None:
            yield out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors of one label are linked at a cosine of `cosine` or more, in double precision. n_links counts the other vectors linked
    directly, component_id is the smallest id reachable over links, kept tells whether that is the row's own. Ids are integers.

    Every vector is rotated at random several times; the signs are its binary code, and the share of its length that a code
    holds is the correction factor stored with it. Runs of code bits are the bands that bring vectors into one bucket (band_shape:
    buckets stay small and a linked pair is missed with a chance of MISS, at every size). Inside a bucket the codes give an
    unbiased estimate of each inner product and its bound; only pairs whose upper bound reaches the threshold are computed exactly.
    A pair counts in the first band in which it agrees. Counts and spanning forests leave the tasks, pairs don't.

    Identical vectors of a label are one, weighted by their number. Buckets of more than BLOCK_ROWS are cut into blocks whose pairs
    are dealt over tasks, so no task gets more than two blocks at once.

    Nulls: a null, empty or zero vector, one with null or non-finite components, and one with a null label or id link with nothing;
    component_id is then the id. Vectors of different lengths are never linked. Repeated rows of one id are one vector's rows: they
    aren't linked with each other unless their ids differ, and get the id's answer. Empty table: no rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = written(rows.withColumn("valid", F.coalesce(valid, F.lit(False))), "vectors")
    good = rows.where("valid")
    distinct = good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"))
    distinct = written(distinct.withColumn("dim", F.size("v")), "vectors-distinct")
    bits, bands = band_shape(distinct.count(), cosine)
    coded = distinct.mapInArrow(lambda it: _coded(it, bits, bands), f"id long, label string, dim int, v {dict(rows.dtypes)['v']}, weight long, code binary, factor array<float>, bands array<long>")
    coded = written(coded, "vectors-coded")

    in_bands = coded.select("id", "label", "dim", F.posexplode("bands").alias("band", "value"))
    bucket = ["label", "dim", "band", "value"]
    shared = in_bands.groupBy(*bucket).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    members = written(in_bands.join(shared, bucket).select(*bucket, "id"), "vectors-members")
    dealt = dealt_in_blocks(members, bucket, "id", BLOCK_ROWS).select("id", "band", "side", "within", "block")
    blocks = dealt.join(coded.drop("bands", "label"), "id").repartition("block").sortWithinPartitions("block")
    found = written(blocks.mapInArrow(lambda it: _compared(it, bits, bands, cosine), "id long, links long, root long"), "vectors-found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("id > root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), "vectors-components")
    reps = distinct.select(F.col("label").alias("l"), F.col("v").alias("w"), F.col("id").alias("rep"), "weight")
    answers = reps.join(links, F.expr("rep = id"), "left").drop("id").join(component, F.expr("rep = node"), "left").select("l", "w", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(answers, F.expr("label = l AND v = w")).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.node
"""
