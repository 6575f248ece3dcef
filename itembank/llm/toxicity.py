"""Toxicity: misspelled terms of a learned lexicon, weighed by what stands around them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm import automata
from itembank.llm.near_dedup import drop_near_copies
from itembank.llm.common import WORD, held, releasing, without, written

#: At most so many labelled rows are learned from, chosen by a hash of their id.
FIT_ROWS = 20_000
#: A term stands in at least so many toxic rows, whatever their number, and is likelier there: its log odds less two standard errors reach so much.
SUPPORT_ROWS, LOG_ODDS = 4, 1.3
#: Rows of one label whose sets of so many words in turn are this similar count as one when terms are learned: else a toxic text with many copies makes all its words terms.
COPY_WORDS, COPY_PERCENT = 2, 60
#: A document's evidence from one term grows with its findings up to MOST of them.
MOST = 4
#: Words before and after a term that tell quotation from abuse, and what they do to its evidence.
WINDOW, QUOTED, MENTIONED, ADDRESSED = 8, 0.35, 0.5, 1.2
#: Words that announce a quotation or mention, and words that address someone.
MENTION = {"word", "words", "term", "called", "said", "says", "quote", "quoted", "quotes", "wrote", "writes", "slur", "insult", "mot", "terme", "dit", "wort", "sagte", "palabra", "dijo"}
ADDRESS = {"you", "your", "youre", "yours", "du", "dein", "dich", "ihr", "tu", "toi", "vous", "eres", "usted"}
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
_TERM = re.compile(r"[^\W\d_]+")
GROUP_CHARS = 1 << 20
#: Terms that a task counts before it hands the counts on.
HELD_TERMS = 60_000


@dataclass
class Model:
    terms: list[str]
    weight: np.ndarray  # term x edits
    coef: np.ndarray  # bias first
    centre: np.ndarray
    scale: np.ndarray


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, y of at most so many labelled documents, chosen by a hash of the id. Ids fit a broadcast: there are no more than rows."""
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")


@releasing
def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each word and each stem of 4 to 7 letters stands; sums of up to HELD_TERMS terms at a time."""
    count: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *[pa.array([n[i] for n in count.values()], pa.int64()) for i in (0, 1)]], names=["term", "t", "c"])

    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            words = set(_TERM.findall(text.as_py().lower()))
            for term in words | {w[:n] + "*" for w in words for n in range(4, 8) if len(w) > n}:
                count.setdefault(term, [0, 0])[1 - y] += 1
            if len(count) > HELD_TERMS:
                yield out()
                count.clear()
    yield out()


def choose_terms(support: dict[str, int]) -> list[str]:
    """A word for each stem that is nearly always that word, else the longest stem that stands as often; nothing twice, and no term that these don't find is left out."""
    names, chosen = sorted(support), []
    left = dict(support)
    for stem in sorted((s for s in support if s.endswith("*")), key=lambda s: (len(s), s)):
        if stem not in left:
            continue
        root = stem[:-1]
        under = [s for s in names[bisect_left(names, root) : bisect_left(names, root + chr(0x10FFFF))] if s in left]
        near = [s for s in under if left[s] >= 0.85 * support[stem]]
        words = [s for s in near if not s.endswith("*")]
        term = max(words, key=lambda s: (left[s], s)) if words else max(near, key=lambda s: (len(s), s))
        chosen.append(term)
        for s in under:  # what the term finds, and stems that stand for it; other words of the stem stay
            if s == term or s.endswith("*") and term.startswith(s[:-1]) or term.endswith("*") and s.startswith(term[:-1]):
                del left[s]
    chosen += [s for s in left if not s.endswith("*")]
    return sorted(chosen)


def automaton_of(terms: list[str]) -> automata.Automaton:
    """The worker's automaton for a lexicon."""
    return held(("automaton", *terms), lambda: automata.build(terms))


def context_factor(before: str, after: str) -> float:
    """What the words around a term do to its evidence: less inside quotation marks or after words of mention, more where someone is addressed."""
    quoted = any(before.count(o) > (before.count(c) if c != o else before.count(o) // 2 * 2) and c in after for o, c in zip(_OPEN, _CLOSE))
    words = [w.strip("\"'.,:;!?()“”„«»‘’").lower() for w in before.split()]
    near = {*words, *(w.strip("\"'.,:;!?()“”„«»‘’").lower() for w in after.split())}
    mentioned = bool(MENTION & set(words[-3:]))
    return (QUOTED if quoted else 1.0) * (MENTIONED if mentioned else 1.0) * (ADDRESSED if near & ADDRESS and not (quoted or mentioned) else 1.0)


def _hits(terms: list[str], texts: list[str]) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, float]]]]:
    """First row, words per text, and (row, code, factor) of each found term, for groups of whole texts."""
    auto, row = automaton_of(terms), 0
    while row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop]) <= GROUP_CHARS):
            size += len(texts[stop]) + 1
            stop += 1
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[row:stop]])))
        joined = "\n".join(texts[row:stop])
        starts, ends, best = automata.find(auto, joined)
        text = np.searchsorted(first, starts, "right") - 1
        found = []
        for w in np.flatnonzero(best < automata.NONE).tolist():
            t = int(text[w])
            lo, hi = max(0, w - WINDOW), min(len(starts) - 1, w + WINDOW)
            a, b = max(int(starts[lo]), int(first[t])), min(int(ends[hi]), int(first[t + 1]) - 1)
            a, b = max(int(first[t]), a - 2), min(int(first[t + 1]) - 1, b + 2)
            found.append((t, int(best[w]), context_factor(joined[a : starts[w]], joined[ends[w] : b])))
        yield row, np.bincount(text, minlength=stop - row), found
        row = stop


@releasing
def _term_edits(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """How often each term stands with each number of edits in toxic and other texts, MOST to a text, and under -1 all words; summed within the task."""
    count: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        y = batch.column(1).to_pylist()
        for row, words, found in _hits(terms, batch.column(0).to_pylist()):
            for (t, code), n in Counter((t, code) for t, code, _ in found).items():
                count[code][1 - y[row + t]] += min(n, MOST)
            for t, n in enumerate(words.tolist()):
                count[-1][1 - y[row + t]] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), *[pa.array([n[i] for n in count.values()], pa.int64()) for i in (0, 1)]], names=["code", "t", "c"])


def _features(texts: list[str], model: Model) -> np.ndarray:
    """Per text: its evidence summed over terms (the MOST strongest of each), the strongest finding, the number of hits, and hits by words."""
    out = np.zeros((len(texts), 4))
    if not model.terms:
        return out
    for row, words, found in _hits(model.terms, texts):
        each: dict[tuple[int, int], list[float]] = defaultdict(list)
        hits = np.zeros(len(words))
        for t, code, factor in found:
            edits, term = divmod(code, automata.STRIDE)
            if (e := model.weight[term, edits] * factor) > 0.3:
                hits[t] += 1
                each[t, term].append(e)
        part = out[row : row + len(words)]
        for (t, _), e in each.items():
            e.sort(reverse=True)
            part[t, 0] += sum(e[:MOST])
            part[t, 1] = max(part[t, 1], e[0])
        part[:, 2] = np.log1p(hits)
        part[:, 3] = np.log1p(100 * hits / np.maximum(words, 1))
    return out


@releasing
def _featured(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _features(batch.column(0).to_pylist(), model)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(4)] + [batch.column(1).cast(pa.int64())], names=["a", "b", "c", "d", "y"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has the bias column first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: DataFrame) -> Model:
    """Learns from id, text, y: a bounded sample. The driver sees the terms that pass the test, which FIT_ROWS bounds, and four numbers a row."""
    sample = written(sample.select("id", "text", "y"), "toxic-labelled")
    # Words marked with the label: texts of different labels share none.
    marked = sample.withColumn("marked", F.regexp_replace("text", F.lit(f"({WORD})"), F.concat(F.col("y").cast("string"), F.lit("$1"))))
    sample = written(drop_near_copies(marked, "id", "marked", COPY_WORDS, COPY_PERCENT).select("text", "y"), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.mapInArrow(_term_counts, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    odds -= 2 * F.sqrt(1 / F.col("t") + 1 / (F.col("c") + 0.5))
    support = {r["term"]: r["t"] for r in counts.where((F.col("t") >= SUPPORT_ROWS) & (odds >= LOG_ODDS)).select("term", "t").collect()}
    terms = choose_terms(support)
    model = Model(terms, np.zeros((len(terms), 3)), np.zeros(5), np.zeros(4), np.ones(4))
    if terms:
        seen = {(e, t): (0, 0) for t, term in enumerate(terms) for e in range(automata.edits_allowed(term.rstrip("*")) + 1)}
        counted = {r["code"]: (r["t"], r["c"]) for r in sample.mapInArrow(lambda it: _term_edits(it, terms), "code long, t long, c long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
        many = counted.pop(-1, (0, 0))
        seen |= {divmod(code, automata.STRIDE): n for code, n in counted.items()}
        for (e, t), (a, b) in seen.items():  # unseen misspellings keep some evidence, those of clean texts none
            model.weight[t, e] = np.clip(np.log((a + 1) / (many[0] + 1)) - np.log((b + 0.25) / (many[1] + 1)), 0, 6)
    rows = sample.mapInArrow(lambda it: _featured(it, model), "a double, b double, c double, d double, y long").toPandas().to_numpy()
    if len(rows):
        x = rows[:, :4]
        model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        model.coef = _logistic(np.column_stack((np.ones(len(x)), (x - model.centre) / model.scale)), rows[:, 4])
    return model


@releasing
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            x = (_features([t or "" for t in part.column(1).to_pylist()], model) - model.centre) / model.scale
            z = np.clip(model.coef[0] + x @ model.coef[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["id", "score"])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= threshold).

    The lexicon's terms are found in whole texts with up to two edits by the intersection of their trie with the Levenshtein
    automata, whose deterministic states are made as the texts' words need them; each finding is weighed by term, edits and the words around it, and a logistic regression makes the score.
    Rows are scored where they are read; nothing is shuffled.

    Nulls: a null text is an empty text, which has no findings; a null id stays null. Repeated rows are scored each. Equal texts
    have equal scores. Empty table: no rows. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda it: _scored(it, model), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from the labels whose id isn't held out."""
    return fit(labelled(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)), "toxic", rows))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns. Texts are scored in place; ids of the toxic ones are then left out. Rows without an id stay."""
    verdict = toxicity(docs, fit_on(docs, labels)).where("predicted = 1 AND doc_id IS NOT NULL")
    return without(docs, verdict.select(F.col("doc_id").alias("__id")).distinct(), "doc_id")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, fit_on(docs, labels)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
