"""The Merkle manifest and the shards against brute force, on ids that repeat, are missing or lie far apart."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from itembank.llm import merkle, ranks, sharding
from itembank.llm.common import LOWER, UPPER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def way(found, at):
    sides = []
    for nodes in found[:-1]:
        run = at // 8 * 8
        sides.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return sides


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = now = digest(framed(r[f]) for f in merkle.FIELDS)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            text = r["text"] if r["text"] is None else r["text"].translate(str.maketrans(UPPER, LOWER))
            now = digest(framed(text if f == "text" else r[f]) for f in merkle.FIELDS)
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, now, r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    crown = levels([trees[g][-1][0] for g in names])
    root = crown[-1][0] if names else None
    for place, g in enumerate(names):
        for rank, (_, _, leaf, now, doc_id) in enumerate(sorted(groups[g])):
            sides = way(trees[g], rank) + way(crown, place)
            for before, after in sides:
                now = digest((before, now, after))
            yield doc_id, leaf, rank, trees[g][-1][0], root, digest(b + a for b, a in sides), now, now == root


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


COLUMNS = ["doc_id", "leaf", "leaf_rank", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def odd_rows(n: int, seed: int):
    rng = random.Random(seed)
    ids = lambda: rng.choice([None, 7, 7, rng.randrange(-300, 300), rng.randrange(-(2**63), 2**63)])
    return [(ids(), rng.choice([None, "", "A b", "É x", str(rng.random())]), rng.choice([None, "", "en", "EN", "é", *(f"l{i}" for i in range(600))]), rng.choice([None, "s"]), rng.choice([None, 3])) for _ in range(n)]


@pytest.mark.parametrize("rows", [odd_rows(3000, 2), [(i, f"T{i}", "en", "s", 1) for i in range(4700)], [(5, "Only one", None, None, None)], [(i, "A" * 300_000, "en", "s", 1) for i in range(3)]], ids=["odd", "deep", "one", "long"])
def test_manifest_is_the_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("id", "grp", "tie", "uid", "g", "w", "n", "rank", "nodes", "digest", "now", "block", "path"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert plain(merkle.query(docs).select(COLUMNS).collect()) == plain(manifest([dict(zip(merkle.FIELDS, (r[0], r[3], r[2], r[4], r[1]))) for r in rows]))


def test_manifest_of_nothing(spark):
    assert merkle.query(spark.createDataFrame([], DOCS)).collect() == []


def test_an_unchanged_row_verifies_and_a_changed_one_does_not(spark):
    rows = spark.createDataFrame([(i, f"Text {i}", "en", "s", 1) for i in range(60)], DOCS)
    found = {r.doc_id: r.verified for r in merkle.query(rows).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 3 != 0 for i in range(60)}


def test_ranks_without_a_sort_of_groups(spark):
    """No window of the ranking is over a whole group, and a hot id is cut by ties and partitions."""
    rng = random.Random(4)
    ids = [5] * 4000 + [rng.randrange(-(2**40), 2**40) for _ in range(6000)] + [None] * 500
    rows = spark.createDataFrame([(1, i, f"{rng.randrange(3):03x}", n << 20) for n, i in enumerate(ids)], "g long, id long, tie string, uid long")
    found = sorted((r.rank, r.id is not None, r.id or 0, r.tie) for r in ranks.ranked(rows, "test").collect())
    assert [f[0] for f in found] == list(range(len(ids)))
    assert [f[1:] for f in found] == sorted(f[1:] for f in found)


def jump(key: int, shards: int) -> int:
    at, onward = -1, 0
    while onward < shards:
        at = onward
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        onward = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_the_published_hash(spark, documents, shards):
    rows = [(i, t, s) for i, t, _, s, _ in odd_rows(2500, 6)] + [(11, "x" * 2_000_000, "s")]
    found = sharding.sharded(documents(rows), shards).collect()
    expected, places = [], defaultdict(list)
    for i, t, _ in rows:
        data = (t or "").encode()
        key = int(hashlib.md5(str(i).encode() if i is not None else hashlib.md5(data).hexdigest().encode()).hexdigest()[:16], 16)
        expected.append((i, len(data) + 16, zlib.crc32(data), "key", jump(key, shards), jump(key, shards + 1)))
    assert plain([(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found]) == plain(expected)
    assert all(r.grown_shard in (r.shard, shards) for r in found)
    for r in found:
        places[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0))
    for place in places.values():
        assert [p[0] for p in sorted(place)] == list(range(len(place)))
        assert [p[1:] for p in sorted(place)] == sorted(p[1:] for p in place)


def test_shards_are_even_and_few_rows_move(spark, sf_dir):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.sharded(docs).groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("grown_shard") == 40).cast("int")).alias("moved")).collect()
    assert len(found) == 40 and all(4600 < r.n < 5400 for r in found)
    assert 0.02 < sum(r.moved for r in found) / 200_000 < 0.029


def test_shards_have_no_python(spark, sf_dir):
    plan = sharding.query(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert sharding.query(spark.createDataFrame([], DOCS)).collect() == []
