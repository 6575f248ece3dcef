"""Mixing against its SQL and its contract; packing as an exact round trip."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from itembank.llm import mixing, packing


def mixed(docs, **more):
    return mixing.mix(docs, **more).collect()


def test_mix_equals_sql(spark, documents, texts):
    rows = [(i, t, (None, "b", "a", "c", "a")[i % 5]) for i, t in enumerate(texts)]
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 9), r["taken"]) for r in mixed(documents(rows)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = sorted((a, b, c, round(d, 9), e) for a, b, c, d, e in con.execute(mixing.SQL).fetchall())
    assert got == want


def test_noisy_sources_are_cut_as_sql_cuts_them(spark, documents, monkeypatch):
    """Documents of low weight have large keys: their source ends in a far bucket."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30) + "#" * rng.randint(0, 400), ("a", "b", "c")[i % 3]) for i in range(1500)]
    got = sorted((r["doc_id"], r["taken"]) for r in mixed(documents(rows)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert got == sorted((a, e) for a, b, c, d, e in con.execute(mixing.SQL).fetchall())


def test_targets_shares_and_caps(spark):
    s = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 5, 1)], "source string, source_size long, rows long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(s).collect()}
    assert t["a"] == 30.0 and t[None] == 15.0
    assert t["b"] == pytest.approx(2 * t["c"]) and sum(t.values()) == pytest.approx(2015)
    one = mixing.source_targets(s.where("source = 'b'")).first()
    assert one["target"] == 1000.0


def test_mix_meets_its_targets(spark, documents):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    took, target = defaultdict(int), {}
    for r in mixed(documents(rows)):
        took[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(target[s] - 1 < took[s] <= target[s] for s in target)
    again = {(r["doc_id"], r["taken"]) for r in mixed(documents(rows[::-1]))}
    assert again == {(r["doc_id"], r["taken"]) for r in mixed(documents(rows))}


def test_whole_documents_come_near_the_target(spark, documents):
    rows = [(i, "w " * (i % 50), f"s{i % 3}") for i in range(900)]
    out = mixing.mixed_documents(documents(rows))
    took = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    target = {r["source"]: r["target"] for r in mixed(documents(rows))}
    assert all(abs(took[s] - target[s]) <= 50 for s in target) and out.columns == documents(rows).columns


def test_mix_of_nulls_blanks_and_nothing(spark, documents):
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixed(documents([(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, " ", "b")]))}
    assert got[1] == (0, 0) and got[2] == (0, 0) and got[3] == (0, 0) and got[None][0] == 2
    assert mixed(documents([(1, "x", "s")]).where("false")) == []


def check_pieces(rows, ids):
    """Every document's ids come back from its pieces; sequences are gapless and not too long."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    for doc, parts in docs.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[doc][at : at + length], dtype="<u4").tobytes())
            assert length == packing.CAPACITY or k == len(parts) - 1
            at += length
        assert at == len(ids[doc])
    return len(sequences)


def test_packing_round_trip(spark, documents, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["It's <|endoftext|> here", "a\x01b \x01 c", "naïve ﬁ ½ ４ café", "U.S.A... (ok)!", "日本 語、テスト", "x y z", "Don'T'LL 'S", "\x01"]
    rows = [(i, t, "s") for i, t in enumerate([*texts, *odd])]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    out = packing.query(documents(rows)).collect()
    sequences = check_pieces(out, ids)
    total = sum(map(len, ids.values()))
    assert sequences <= -(-total // packing.CAPACITY) + 2
    assert sorted((r["doc_id"], r["piece"], r["offset"]) for r in out) == sorted((r["doc_id"], r["piece"], r["offset"]) for r in packing.query(documents(rows[::-1])).collect())


def test_packing_of_repeated_rows_null_ids_and_nothing(spark, documents):
    out = packing.query(documents([(1, "a b", "s"), (1, "a b", "s"), (None, None, "s"), (2, "word " * 5000, "s")])).collect()
    assert sum(r["doc_id"] == 1 for r in out) == 2 and sum(r["doc_id"] is None and r["length"] == 1 for r in out) == 1
    assert sorted((r["piece"], r["length"]) for r in out if r["doc_id"] == 2) == [(0, 4096), (1, 905)]
    assert packing.query(documents([(1, "x", "s")]).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4095, np.maximum(1, rng.lognormal(6.2, 1.1, 3000).astype(int)))
    sequence = packing.pack(lengths)
    filled = np.bincount(sequence, lengths)
    assert filled.max() <= 4096 and filled.min() > 0
    assert len(filled) <= 1.01 * lengths.sum() / 4096 + 2


def test_pack_of_halves_and_of_nothing():
    assert len(set(packing.pack(np.full(100, 2049)))) == 100
    assert len(set(packing.pack(np.full(100, 2048)))) == 50
    assert len(packing.pack(np.zeros(0, dtype=np.int64))) == 0


def test_rows_without_id_or_with_one_id_are_mixed_each(spark, documents):
    rows = [(None if i % 2 else 7, "w " * (1 + i % 9) + f"t{i}", f"s{i % 3}") for i in range(300)]
    docs = documents(rows)
    out = mixing.mixed_documents(docs).collect()
    target = {r["source"]: r["target"] for r in mixed(docs)}
    took, times = defaultdict(int), defaultdict(int)
    for r in out:
        took[r["source"]] += len(r["text"].split())
        times[r["text"]] += 1
    assert all(abs(took[s] - target[s]) <= 10 for s in target)
    assert max(times.values()) <= 3 and sorted(r["text"] for r in mixing.mixed_documents(documents(rows[::-1])).collect()) == sorted(r["text"] for r in out)


def test_chunks_end_where_the_tokenizer_drops_white_space():
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = [f"{a}{chr(c)}{b}" for c in [*range(1, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF] for a, b in (("a", "b"), ("Word.", "été"), ("x ", " Y!"), ("", "b"))]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.by_chunks and encoder.by_letters and encoder.lowers and encoder.cuts_tails
    assert encoder.encode(texts) == want


def test_a_cased_vocabulary_keeps_its_capitals(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"?": 0, "tree": 1, "TREE": 2, ".": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "cased.json"))
    encoder = packing.Encoder(str(tmp_path / "cased.json"))
    assert encoder.encode(["TREE. tree."]) == [np.array([2, 3, 1, 3], dtype="<u4").tobytes()]
