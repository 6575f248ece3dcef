"""Repairs of conversations against a search over all edits, in one part and in many."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from itembank.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {0: (("user", 2),), 1: (("user", 2),), 2: (("assistant", 3),), 3: (("user", 2),)}


def cheapest(rows):
    """The least (cost, audit) with the rows it leaves: all edits tried from every state, the least kept for each."""
    def offer(found, state, way):
        if state not in found or way[:2] < found[state][:2]:
            found[state] = way
            return True
        return False

    def inserted(found):
        grew = True
        while grew:
            grew = any([offer(found, onto, (c + 3, a + "I", o + ((role, ""),))) for state, (c, a, o) in list(found.items()) for role, onto in NEXT[state]])
        return found

    best = {0: (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, out) in inserted(best).items():
            offer(new, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 if fault == "truncated" else 0
            if role[:1] == "s" and state == 0:
                offer(new, 1, (cost, audit + "K", (*out, (role, text))))
            for named, onto in NEXT[state]:
                if role[:1] == named[0]:
                    offer(new, onto, (cost, audit + "K", (*out, (role, text))))
                offer(new, onto, (cost + 3, audit + "R", (*out, (named, text))))
        best = new
    best = inserted(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda way: way[:2])


def expected(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talk, said = talks[conv], lambda x: " " if x is None else str(x)
        chance, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
        talk += [] if chance == 0 else [(turn, "user" if chance == 4 else role, text)] * (2 if chance == 3 else 1)
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in talk:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in talk if t is not None]
        cost, audit, out = cheapest(marked)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def odd_rows():
    rng = random.Random(3)
    roles = [None, "", "user", "assistant", "system", "system", "tool", "User", "user", "assistant"]
    texts = [None, "", " \n", "Hi.", "ok", "yes?", " .", "a. ", "b!\t ", "é ", "x. ", *(f"t{i}." for i in range(9))]
    return [(rng.choice([None, 1, 1, 2, 3, 3, -4, *range(10, 40)]), rng.choice([None, *range(-5, 60)]), rng.choice(roles), rng.choice(texts)) for _ in range(2500)]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("part_bits", [12, 2, 0])
def test_repairs_are_the_cheapest(spark, part_bits):
    """part_bits 0 puts every row in a part of its own: the longer conversations are put together from tables of forms and states."""
    rows = odd_rows()
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    for name in ("none", "conv", "place", "digest", "kind", "part", "codes", "audit", "cost", "_d", "copy"):
        table = table.withColumn(name, F.lit("clash"))
    assert plain(repair.repaired(repair.damaged(table), table, part_bits=part_bits).select(COLUMNS).collect()) == plain(expected(rows))


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert plain(repair.query(table).select(COLUMNS).collect()) == plain(expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))


def test_no_rows_and_a_very_long_text(spark):
    assert repair.query(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(1, 0, "user", "w " * 500_000 + "."), (1, 1, "assistant", "!" * 100_000), (2, None, None, None)]
    assert plain(repair.query(spark.createDataFrame(rows, TURNS)).select(COLUMNS).collect()) == plain(expected(rows))


def test_repairs_without_damage(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (2, 0, "assistant", "A."), (3, 0, "user", "Q?"), (3, 1, "user", "Q?"), (3, 2, "assistant", "A")]
    found = {r.conv_id: (r.audit, r.cost) for r in repair.repaired(spark.createDataFrame(rows, TURNS)).collect()}
    assert found == {1: ("KKK", 0), 2: ("IK", 3), 3: ("KDK", 7)}


def test_blocks_do_what_single_steps_do():
    rng, t = random.Random(1), repair.tables()
    for _ in range(300):
        row = repair.symbols("".join(rng.choice("ABCDEFGHIJKL") for _ in range(rng.randint(0, 40))))
        at = 0
        for symbol in row[::-1]:
            at = int(t.one[at, symbol])
        assert int(repair.carried(row, repair.np.array([0]))[0]) == at
        costs = repair.AT_END
        for symbol in row[::-1]:
            costs = repair.step(costs, int(symbol))
        edits, state, spent = repair.traced(row, 0, 0)
        assert spent + repair.INSERT * len(repair.closed(state)) == costs[0]
        assert all(max(v) <= 10 for v in t.vectors)
