"""Each stage of the pipeline on the smallest tables against brute force on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from itembank.llm import mixing, packing, toxicity
from itembank.llm.common import written
from tests.llm.test_dedup import FOLD, roots, shingles
from tests.llm.test_mixing_and_packing import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = {r["doc_id"] for r in toxicity.query(stages[0], labels).where("predicted = 1").collect()}
    assert sorted(rows(stages[1])) == sorted(r for r in rows(stages[0]) if r[0] not in verdict)


def test_exact_copies_go(stages):
    best = {}
    for i, t in sorted(rows(stages[1])):
        best.setdefault(t.translate(FOLD), i)
    assert sorted(i for i, _ in rows(stages[2])) == sorted(best.values())


def test_near_copies_go(stages):
    docs = dict(rows(stages[2]))
    sets = {i: shingles(t, 5) for i, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(i for i, _ in rows(stages[3])) == sorted(i for i, r in roots(docs, links).items() if i == r)


def test_mix_takes_whole_documents_near_the_targets(stages):
    plan = {r["doc_id"]: r for r in mixing.mix(stages[3], boundary="whole").collect()}
    times = Counter(i for i, _ in rows(stages[4]))
    took, largest = defaultdict(int), defaultdict(int)
    for i, r in plan.items():
        assert times[i] * r["size"] == r["taken"]
        took[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(took[r["source"]] - r["target"]) <= largest[r["source"]] / 2 + 1 for r in plan.values())


def test_sequences_hold_the_mix(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    once = stages[4].dropDuplicates(["doc_id"])
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows(once)}
    check_pieces(packing.query(once).collect(), ids)
    total = stages[5].agg(F.sum("length")).first()[0]
    assert total == sum(len(ids[i]) for i, _ in rows(stages[4]))
    assert stages[5].select("sequence_id").distinct().count() <= 1.02 * total / packing.CAPACITY + 2


def test_run_gives_the_same(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"], r["offset"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[5])
