"""Held-out accuracy of the two classifiers, the automata against edit distances, the sum-of-squares identity."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from itembank.llm import automata, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distances():
    rng = random.Random(4)
    terms = ["abba", "abcab", "cabbage", "backpack", "bcd", "abca*"]
    auto = automata.build(terms)
    for _ in range(600):
        t = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z", "ca"])
        word = "".join(t) or "a"
        want = min([edits(word, x) for x in terms if not x.endswith("*") and edits(word, x) <= automata.edits_allowed(x)] + [edits(word[:n], "abca") for n in range(len(word) + 1) if edits(word[:n], "abca") <= 1], default=None)
        _, _, best = automata.find(auto, word)
        assert (None if best[0] == automata.NONE else best[0] // automata.STRIDE) == want, word


def test_masks_and_ends():
    auto = automata.build(["idiot"])
    text = "id*ot idiot*** 1diot IDIOT, x-idiot! idiotic diot idot"
    s, e, best = automata.find(auto, text)
    assert [text[a:b] for a, b, z in zip(s, e, best) if z < automata.NONE] == ["id*ot", "idiot", "1diot", "IDIOT", "idiot", "diot", "idot"]


def test_context():
    plain = toxicity.context_factor("what an awful ", " that was")
    assert plain == 1.0 > toxicity.context_factor('they wrote "you ', '" again')
    assert toxicity.context_factor("the word ", " means") < 1 < toxicity.context_factor("you are an ", "")


@pytest.fixture(scope="module")
def corpus(spark, documents):
    """Clean texts, texts with insults (some misspelled), quoted insults, and shouted or garbled texts of low quality."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(1500):
        w = rng.choices(vocabulary, k=rng.randint(20, 80))
        toxic, bad = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                term = rng.choice(["grotbag", "plonker", "wazzock"])
                if rng.random() < 0.3:
                    k = rng.randrange(1, len(term))
                    term = term[:k] + term[k + 1 :]
                w.insert(rng.randrange(len(w)), term)
        text = " ".join(w)
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(x + rng.choice(["###", "%%%", "$$"]) for x in w)
        rows.append((i, text, "s"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(9000, "", "s"), (9001, None, "s"), (None, "a plonker grotbag wazzock", "s"), (9002, "word " * 40_000, "s"), (0, rows[0][1], "s")]
    return documents(rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module, parts, part, at", [(toxicity, 3, 1, 1), (quality, 4, 2, 0)])
def test_held_out_accuracy(corpus, module, parts, part, at):
    docs, labels, truth = corpus
    rows = module.query(docs, labels).collect()
    assert len(rows) == docs.count()
    right = total = 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part)
        if r["doc_id"] in truth and r["held_out"]:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]][at]
    assert total > 300 and right / total > 0.97


def test_toxicity_rejects_toxic_documents_only(corpus):
    docs, labels, truth = corpus
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).select("doc_id").collect()}
    assert {None, 9000, 9001, 9002} <= kept
    clean = {i for i, (_, t) in truth.items() if not t}
    assert len(clean - kept) <= 0.01 * len(clean) and len(kept & (truth.keys() - clean)) <= 0.05 * len(truth.keys() - clean)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_and_no_rows(spark, documents, module):
    none = spark.createDataFrame([], LABELS)
    docs = documents([(1, "a b", "s"), (2, None, "s")])
    assert len(module.query(docs, none).collect()) == 2
    assert module.query(docs.where("false"), none).count() == 0


def test_the_fit_is_bounded_by_words_too(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_WORDS", 300)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), i % 2) for i in range(20)]
    seen = []
    monkeypatch.setattr(quality, "_fitted", lambda batches: iter([__import__("pyarrow").RecordBatch.from_pydict({"model": [str(sum(b.num_rows for b in batches)).encode()]})]))
    monkeypatch.setattr(quality.Machine, "loads", classmethod(lambda cls, data: seen.append(int(data))))
    quality.fit(spark.createDataFrame(rows, "id long, text string, y int"))
    assert seen == [6]


def test_sum_of_squares_identity():
    m = quality.Machine()
    rng = np.random.default_rng(0)
    m.w, m.v, m.bias = rng.standard_normal(len(m.w)).astype(np.float32), rng.standard_normal(m.v.shape).astype(np.float32), 0.3
    feature, value = np.array([3, 70, 900, 5, 6]), np.array([0.5, 1.0, -0.2, 2.0, 0.1], dtype=np.float32)
    raw, _ = m.raw(feature, value, np.array([0, 3, 5]))
    for k, (lo, hi) in enumerate(((0, 3), (3, 5))):
        pairs = sum(float(m.v[feature[i]] @ m.v[feature[j]]) * value[i] * value[j] for i in range(lo, hi) for j in range(i + 1, hi))
        assert raw[k] == pytest.approx(0.3 + float((m.w[feature[lo:hi]] * value[lo:hi]).sum()) + pairs, rel=1e-4)
    assert quality.Machine.loads(m.dumps()).bias == pytest.approx(0.3)


def test_every_significant_term_is_kept(spark):
    """240 insults, each in fewer than 1 % of the toxic rows, which are variants of clean ones."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    insults = sorted({"".join(rng.choice("bcfgjkmpqvwxyz") for _ in range(8)) for _ in range(240)})
    clean = [rng.choices(vocabulary, k=10) for _ in range(4500)]
    toxic = [[*clean[i], insults[2 * i % len(insults)], insults[(2 * i + 1) % len(insults)]] for i in range(600)]
    rows = [(i, " ".join(w), int(i >= len(clean))) for i, w in enumerate(clean + toxic)]
    model = toxicity.fit(spark.createDataFrame(rows, "id long, text string, y int"))
    missing = [x for x in insults if not any(x.startswith(t[:-1]) if t.endswith("*") else t == x for t in model.terms)]
    assert not missing
    docs = spark.createDataFrame([(k, " ".join([*clean[k], x, insults[k - 1], x])) for k, x in enumerate(insults)], "doc_id long, text string")
    assert toxicity.toxicity(docs, model).where("predicted = 1").count() == len(insults)


def test_many_terms_of_many_letters(monkeypatch):
    """5,000 terms over 1,000 letters, some of 60 letters: each is found whole, with an edit where it is long enough, and with small memories alike."""
    rng = random.Random(9)
    letters = [c for c in map(chr, range(0x4E00, 0x4E00 + 600))] + [c for c in map(chr, range(0x400, 0x1000)) if c.isalpha() and c == c.lower() and len(c) == 1][:400]
    assert len(letters) == 1000
    terms = sorted({"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 9, 60]))) for _ in range(5100)})[:5000]
    auto = automata.build(terms)
    said, want = [], []
    for t, term in list(enumerate(terms))[::6]:
        said.append(term)
        want.append((0, t))
        if len(term) >= 5:
            k = rng.randrange(len(term) - 1)
            said.append(term[:k] + term[k + 1] + term[k] + term[k + 2 :] if k % 2 and term[k] != term[k + 1] else term[:k] + "\u4e00\u4e01" [k % 3 == 0] + term[k + 1 :])
            want.append((edits(said[-1], term), t))
    _, _, best = automata.find(auto, " ".join(said))
    got = [divmod(int(b), automata.STRIDE) for b in best]
    for (e, t), (f, u), word in zip(want, got, said):
        assert f <= e and (f < e or u == t or edits(word, terms[u]) == f), word
    monkeypatch.setattr(automata, "CACHE_ENTRIES", 3000)
    monkeypatch.setattr(automata, "CACHE_WORDS", 100)
    small = automata.build(terms[:300])
    again = [int(automata.find(small, w)[2][0]) for w in said[:200]]
    monkeypatch.undo()
    assert again == automata.find(automata.build(terms[:300]), " ".join(said[:200]))[2].tolist()


def test_a_thousand_letters_can_be_learned(spark):
    rng = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(1000)]
    words = ["".join(letters[(7 * k + j) % 1000] for j in range(5)) for k in range(400)]
    bad = ["".join(letters[(11 * k + 3 * j) % 1000] for j in range(2 + k % 30)) for k in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=6) + ([bad[i % 40]] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(2700)]
    model = toxicity.fit(spark.createDataFrame(rows, "id long, text string, y int"))
    assert len({c for t in model.terms for c in t}) > 60 and max(map(len, model.terms)) > 24 and min(len(t.rstrip("*")) for t in model.terms) < 3
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.97 * len(rows)


def test_a_stem_leaves_no_word_out():
    support = {"gvpq*": 105, "gvpqgp*": 100, "gvpqgpvw": 100, "gvpqxx*": 5, "gvpqxxyz": 5, "abcd*": 60, "abcdef": 30, "abcdgh": 30}
    assert toxicity.choose_terms(support) == ["abcd*", "gvpqgpvw", "gvpqxxyz"]
