"""Exact and near deduplication against brute force; copies in one hot group; collisions; nulls, blanks, repeated rows, empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from itembank.llm import exact_dedup, graph, near_dedup, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_equals_brute_force(spark, documents, texts, keep):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(documents([(i, t, "s") for i, t in enumerate(texts)]), keep=keep).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(FOLD)].append(i)
    assert len(got) == len(texts)
    for norm, ids in groups.items():
        best = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(ids), i == best, hashlib.sha256(norm.encode()).hexdigest())


def test_colliding_hashes_are_told_apart_by_bytes(spark, documents):
    docs = documents([(1, "abc", "s"), (2, "abd", "s"), (3, "ABC", "s"), (4, "xyz", "s"), (5, None, "s")])
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 4, "0"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, content_hash=weak).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def test_exact_with_null_ids_and_repeated_rows(spark, documents):
    docs = documents([(None, "a", "s"), (7, "A", "s"), (3, "b", "s"), (3, "b", "s"), (None, "z", "s")])
    rows = sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert rows == sorted([(None, 7, False), (7, 7, True), (3, 3, True), (3, 3, True), (None, None, True)], key=str)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(documents([(3, "b", "s"), (3, "b", "s"), (1, "q", "s"), (2, "Q", "s")])).collect()) == [1, 3]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_near_equals_brute_force(spark, documents, texts, k):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents([(i, t, "s") for i, t in enumerate(texts)]), shingle_words=k).collect()}
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(range(len(sets)), links)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(sets))}


def test_near_with_null_ids_repeated_rows_and_a_hot_group(spark, documents):
    rows = [(None, "a b c", "s"), (5, "a b c", "s"), (5, "a b c", "s"), (4, "q", "s"), (9, None, "s")] + [(100 + i, "hot " * 3 + "text", "s") for i in range(300)]
    got = defaultdict(set)
    for r in near_dedup.near_duplicates(documents(rows), shingle_words=2).collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert got[None] == {(None, True)} and got[5] == {(5, True)} and got[4] == {(4, True)} and got[9] == {(9, True)}
    assert all(got[100 + i] == {(100, i == 0)} for i in range(300))
    assert near_dedup.drop_near_copies(documents(rows)).where("doc_id >= 100").count() == 1


def test_large_blocks_are_cut(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    rows = [(i, t, "s") for i, t in enumerate(texts[:60] + texts[120:160])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(rows), shingle_words=2).collect()}
    sets = [shingles(t, 2) for _, t, _ in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == roots(range(len(sets)), links)


def test_members_that_are_not_near_their_centre_are_compared_with_all(spark, documents, texts, monkeypatch):
    """One centre for all texts, in parts of four: most members aren't near it, but near each other."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    spokes = spark.createDataFrame([(0, i, len(s)) for i, s in sets.items() if s], "centre long, id long, n long")
    table = documents([(i, t, "s") for i, t in enumerate(texts)]).select(F.col("doc_id").alias("id"), "text")
    links = [(r["a"], r["b"]) for r in near_dedup._confirmed(spokes, table, 2, 80).collect()]
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    assert all(near(sets[a], sets[b]) for a, b in links)
    assert roots(sets, links) == roots(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])


def test_empty_tables(spark, documents):
    none = documents([(1, "x", "s")]).where("false")
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_copies(none).columns == none.columns


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate((a[: n * 9 // 10], rng.integers(0, 2**64, n - n * 9 // 10, dtype=np.uint64)))
        sets = [np.unique(a), np.unique(b)]
        sig = near_dedup.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert (sig != 0).all() and abs((sig[0] == sig[1]).mean() - true) < 0.17


def test_word_hashes_follow_words_alone():
    import pyarrow as pa

    column = pa.array(["The cat", " the\tCAT\n", None, "", "catthe", "x" * 100])
    found = {}
    for first, data, at in words.row_groups(column):
        starts, ends, row = words.word_bounds(data, at)
        for r, h in zip(row, words.word_hashes(data, starts, ends)):
            found.setdefault(first + int(r), []).append(int(h))
    assert found[0] == found[1] and 2 not in found and 3 not in found and len({*found[0], *found[4], *found[5]}) == 4


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({x for p in clean for x in p}, clean)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_word_of_the_thue_morse_pattern_is_not_its_complement(spark, documents):
    """In a polynomial hash with an odd base modulo 2**64 the two are equal, whatever the base."""
    pattern = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = pattern.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{pattern} {pattern} x", "s"), (2, f"{other} {other} x", "s"), (3, f"{pattern} {pattern} X", "s")]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows), shingle_words=2).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_stages_keep_columns_named_like_their_own(spark):
    from itembank.llm import exact_dedup, mixing

    rows = [(i, text, "s", "en", 1) for i, text in enumerate(["a b c d e f", "A b c d e f", "a b c d e f g", "other words", None, "other words"])]
    docs = spark.createDataFrame([*rows, *rows[-1:]], "doc_id long, text string, source string, lang string, n_chars long")
    for name in ("__id", "_id", "__row", "___row", "__times", "__time", "__hash"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for stage in (exact_dedup.drop_exact_copies, near_dedup.drop_near_copies, mixing.mixed_documents):
        left = stage(docs)
        assert left.columns == docs.columns
        assert all(r["__id"] == f"__id{r.doc_id}" and r["__row"] == f"__row{r.doc_id}" and r["__times"] == f"__times{r.doc_id}" for r in left.collect())
