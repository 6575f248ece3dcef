"""Cheapest repairs of conversations: rows are kept, reroled, deleted or inserted until their roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import written

#: White space, ends of sentences, costs of edits, and what an undeleted truncated row adds.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing written yet, after a system row, after a user row, after an assistant row. What comes next by inserting or reroling, and its role.
ONWARD, WRITES = (2, 2, 3, 2), {2: "user", 3: "assistant"}
#: What comes next by keeping a row whose role begins with s, u, a or anything else; -1: it can't be kept there.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: Costs from each state to the end when no row is left: a conversation ends empty or after an assistant.
AT_END = (0, 6, 3, 0)
#: Symbols: four kinds of role, whole; the same truncated; a row that must be deleted. A block has BLOCK of them.
SYMBOLS, MUST_DELETE, BLOCK = 9, 8, 4
#: A row as a letter: A to D whole, E to H truncated, I to L to be deleted, by kind of role.
FIRST_LETTER, KINDS = ord("A"), "sua"
#: Places of 2**PART_BITS rows in the order of all rows are worked on together.
PART_BITS = 12


def step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from each state to the end, a row of this symbol before those that led to after."""
    more = TRUNCATED if 4 <= symbol < MUST_DELETE else 0
    costs = []
    for state in range(4):
        options = [DELETE + after[state]]
        if symbol != MUST_DELETE:
            options.append(REROLE + more + after[ONWARD[state]])
            if KEPT[symbol % 4][state] >= 0:
                options.append(more + after[KEPT[symbol % 4][state]])
        costs.append(min(options))
    for _ in range(3):  # rows inserted before this one
        costs = [min(costs[s], INSERT + costs[ONWARD[s]]) for s in range(4)]
    return tuple(costs)


class Tables(NamedTuple):
    """Cost vectors up to a constant, by number; what a symbol or a block of them makes of each, and the constant."""
    vectors: list[tuple[int, ...]]
    one: np.ndarray
    one_add: np.ndarray
    block: np.ndarray


@cache
def tables() -> Tables:
    """All vectors that can occur, found from the end's, and the lookup tables of symbols and blocks."""
    numbers, vectors, moves = {AT_END: 0}, [AT_END], []
    for vector in vectors:  # grows while new ones are found
        row = []
        for symbol in range(SYMBOLS):
            costs = step(vector, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in numbers:
                numbers[normal] = len(vectors)
                vectors.append(normal)
            row.append((numbers[normal], least))
        moves.append(row)
    one, add = (np.array([[m[i] for m in row] for row in moves], dtype=np.int32) for i in (0, 1))
    block = np.arange(len(vectors), dtype=np.int32)[:, None]
    for _ in range(BLOCK):  # one more symbol in front: it acts after the others, and its digit is the highest
        block = np.concatenate([one[block, symbol] for symbol in range(SYMBOLS)], axis=1)
    return Tables(vectors, one, add, block)


def symbols(codes: str) -> np.ndarray:
    return np.minimum(np.frombuffer(codes.encode("ascii"), dtype=np.uint8) - FIRST_LETTER, MUST_DELETE).astype(np.int64)


def block_numbers(row: np.ndarray) -> np.ndarray:
    whole = row[: len(row) // BLOCK * BLOCK].reshape(-1, BLOCK)
    return whole @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def carried(row: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each vector after the row's symbols the one before them: the odd ones at the end singly, then blocks by lookup."""
    t = tables()
    for symbol in row[len(row) // BLOCK * BLOCK :][::-1]:
        ends = t.one[ends, symbol]
    for number in block_numbers(row)[::-1]:
        ends = t.block[ends, number]
    return ends


@cache
def expanded(piece: tuple[int, ...], end: int, state: int) -> tuple[str, int, int]:
    """A few symbols' edits from a state on, the state then reached and the cost, the least letters first; end: the vector after them."""
    t = tables()
    costs, offset, at = [t.vectors[end]], 0, end
    for symbol in reversed(piece):
        offset += int(t.one_add[at, symbol])
        at = int(t.one[at, symbol])
        costs.append(tuple(c + offset for c in t.vectors[at]))
    costs.reverse()
    edits, spent = [], 0
    for i, symbol in enumerate(piece):
        more = TRUNCATED if 4 <= symbol < MUST_DELETE else 0
        kept = -1 if symbol == MUST_DELETE else KEPT[symbol % 4][state]
        while True:
            left, now = costs[i + 1], costs[i][state]
            if now == DELETE + left[state]:
                edit, paid = "D", DELETE
            elif now == INSERT + costs[i][ONWARD[state]]:
                edits.append("I")
                spent, state = spent + INSERT, ONWARD[state]
                kept = -1 if symbol == MUST_DELETE else KEPT[symbol % 4][state]
                continue
            elif kept >= 0 and now == more + left[kept]:
                edit, paid, state = "K", more, kept
            else:
                edit, paid, state = "R", REROLE + more, ONWARD[state]
            edits.append(edit)
            spent += paid
            break
    return "".join(edits), state, spent


def traced(row: np.ndarray, end: int, state: int) -> tuple[str, int, int]:
    """The row's edits from a state on, the state then reached and the cost: vectors at the blocks' ends by lookup, then block by block expanded the other way."""
    t, tail = tables(), len(row) // BLOCK * BLOCK
    numbers, ends = block_numbers(row), []
    at = int(carried(row[tail:], np.array([end]))[0])
    for number in numbers[::-1]:
        ends.append(at)
        at = int(t.block[at, number])
    pieces = [*zip((tuple(p) for p in row[:tail].reshape(-1, BLOCK).tolist()), reversed(ends))]
    if len(row) > tail:
        pieces.append((tuple(row[tail:].tolist()), end))
    audit, spent = [], 0
    for piece, after in pieces:
        edits, state, cost = expanded(piece, after, state)
        audit.append(edits)
        spent += cost
    return "".join(audit), state, spent


def closed(state: int) -> str:
    """What is inserted after the last row."""
    edits = ""
    while AT_END[state]:
        edits, state = edits + "I", ONWARD[state]
    return edits


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part the vector before it for every vector after it."""
    every = np.arange(len(tables().vectors))
    for batch in batches:
        made = [carried(symbols(c), every).astype("<i4").tobytes() for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("none", "conv", "part")), pa.array(made, pa.binary())], ["none", "conv", "part", "before"])


def _ends(parts: pa.Table) -> pa.Table:
    """The vector after each part of a conversation, from its last part back."""
    parts, at, ends = parts.sort_by([("part", "descending")]), 0, []
    for before in parts.column("before").to_pylist():
        ends.append(at)
        at = int(np.frombuffer(before, dtype="<i4")[at])
    return parts.select(["none", "conv", "part"]).append_column("end", pa.array(ends, pa.int32()))


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each part, for every state before it."""
    for batch in batches:
        made = [bytes(traced(symbols(c), e, s)[1] for s in range(4)) for c, e in zip(batch.column("codes").to_pylist(), batch.column("end").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("none", "conv", "part", "end")), pa.array(made, pa.binary())], ["none", "conv", "part", "end", "leads"])


def _states(parts: pa.Table) -> pa.Table:
    """The state before each part of a conversation, from its first part on, and whether it is the last."""
    parts, state, states = parts.sort_by("part"), 0, []
    for leads in parts.column("leads").to_pylist():
        states.append(state)
        state = leads[state]
    last = [i == len(states) - 1 for i in range(len(states))]
    return parts.select(["none", "conv", "part", "end"]).append_column("state", pa.array(states, pa.int32())).append_column("last", pa.array(last, pa.bool_()))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, costs, illegal = [], [], []
        for codes, end, state, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "end", "state", "last"))):
            audit, state, cost = traced(symbols(codes), end, state)
            more = closed(state) if last else ""
            audits.append(audit + more)
            costs.append(cost + INSERT * len(more))
            kinds = [(ord(c) - FIRST_LETTER) % 4 for c in codes]
            illegal.append(sum(unlawful(a, b) for a, b in zip(kinds, kinds[1:])))
        edges = [[f(c) for c in batch.column("codes").to_pylist()] for f in (lambda c: (ord(c[0]) - FIRST_LETTER) % 4, lambda c: (ord(c[-1]) - FIRST_LETTER) % 4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("none", "conv", "part")), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), *(pa.array(e, pa.int32()) for e in edges)], ["none", "conv", "part", "audit", "cost", "illegal", "opens", "closes"])


def unlawful(a: int, b: int) -> bool:
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


_EDITS = "none boolean, conv {kind}, part long, audit string, cost long, illegal long, opens int, closes int"


def edits(parts: DataFrame, kind: str) -> DataFrame:
    """Of each part of a conversation (none, conv, part, codes) its cheapest edits, cost and unlawful neighbours.

    A conversation that lies in one part is traced at once. Where it has more, each part is first reduced to what it makes of every vector,
    then of every state; these short tables alone meet by conversation.
    """
    key = ["none", "conv"]
    many = parts.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    alone = parts.join(many, key, "left_anti").select(*key, "part", "codes", F.lit(0).alias("end"), F.lit(0).alias("state"), F.lit(True).alias("last"))
    found = alone.mapInArrow(_trace, _EDITS.format(kind=kind))
    if many.isEmpty():
        return found
    longer = written(parts.join(many, key, "left_semi"), "repair-longer")
    head = f"none boolean, conv {kind}, part long"
    before = written(longer.mapInArrow(_carry, f"{head}, before binary"), "repair-before")
    ends = written(before.groupBy(*key).applyInArrow(_ends, f"{head}, end int"), "repair-ends")
    leads = written(longer.join(ends, [*key, "part"]).mapInArrow(_leads, f"{head}, end int, leads binary"), "repair-leads")
    states = written(leads.groupBy(*key).applyInArrow(_states, f"{head}, end int, state int, last boolean"), "repair-states")
    return found.unionByName(longer.join(states, [*key, "part"]).select(*key, "part", "codes", "end", "state", "last").mapInArrow(_trace, _EDITS.format(kind=kind)))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream that is sorted by conversation, kind of record and order: its counts, its edits, its rows.

    Rows are hashed as they come; of a conversation no more than its edits are held.
    """
    now, out = None, []

    def done() -> None:
        for _ in range(now["at"], len(now["audit"])):
            write(now, now["state"], None)
        head = now["head"]
        out.append({"none": head["none"], "conv": head["conv"], **{c: (head[c] or 0) + now.get(c, 0) for c in _COUNTS}, "audit": now["audit"], "repaired_sha256": now["sha"].hexdigest()})

    def write(now: dict, state: int, kept: tuple[str, str] | None) -> None:
        role, text = kept or (WRITES[ONWARD[state]], "")
        now["sha"].update(f"{now['joint']}{role}:{text}".encode())
        now["joint"] = "\n"
        if kept is None:
            now["state"] = ONWARD[state]

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if now:
                    done()
                now = {"head": r, "pieces": [], "audit": "", "at": 0, "state": 0, "sha": hashlib.sha256(), "joint": "", "cost": 0, "illegal": 0, "closes": None}
            elif r["kind"] == 1:
                now["pieces"].append(r["audit"])
                now["cost"] += r["cost"]
                now["illegal"] += r["illegal"] + (now["closes"] is not None and unlawful(now["closes"], r["opens"]))
                now["closes"] = r["closes"]
            else:
                if now["pieces"]:
                    now["audit"], now["pieces"] = "".join(now["pieces"]), []
                while now["audit"][now["at"]] == "I":
                    write(now, now["state"], None)
                    now["at"] += 1
                edit = now["audit"][now["at"]]
                now["at"] += 1
                if edit == "K":
                    write(now, now["state"], (r["role"], r["text"]))
                    now["state"] = KEPT[KINDS.index(r["role"][0])][now["state"]]
                elif edit == "R":
                    role = WRITES[ONWARD[now["state"]]]
                    write(now, now["state"], (role, r["text"]))
                    now["state"] = ONWARD[now["state"]]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_told_schema(batch.schema.field("conv").type))
            out.clear()
    if now:
        done()
        yield pa.RecordBatch.from_pylist(out, schema=_told_schema(pa.array([now["head"]["conv"]]).type if now["head"]["conv"] is not None else pa.int64()))


def _told_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("none", pa.bool_()), ("conv", kind), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repaired(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_bits: int = PART_BITS) -> DataFrame:
    """One row for each conversation of rows, and of conversations (a column conv_col) if that is given: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation are taken by turn. Each is blank, a duplicate of an earlier one, truncated, or whole; blank and duplicate ones are deleted,
    others kept, reroled or deleted, and empty rows inserted, so that the roles' initials are nothing or an s at most followed by ua, ua, ...
    at the least cost, ties by the audit's least letters. The costs of the ways on from each of four states take few forms up to a constant; tables say
    what a block of four rows makes of each form, and blocks are expanded against the direction of the lookups.

    Rows are put in order by ranges of (conversation, turn, role, digest), so that a conversation with most of all rows lies in many
    parts; these meet as tables of forms and states. Duplicates are found by the least place of each digest. Texts are shuffled once, and
    hashed as they come in order: the one digest of a conversation's text is made by one task, which holds its edits alone.

    Nulls: a null role or text is one space; a null turn comes first and counts for no gap; rows without a conversation are one conversation.
    Rows with one turn ascend by role, then by digest of role and text; repeated rows are duplicates. Empty texts are blank; very long texts are read whole.
    A conversation without rows has zeros, an empty audit and the digest of nothing. Empty table: no rows. Other columns aren't read, whatever their names.
    """
    kind = rows.schema[conv_col].dataType
    conv = F.coalesce(F.col(conv_col), F.lit(0).cast(kind))
    taken = rows.select(F.col(conv_col).isNull().alias("none"), conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    taken = taken.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    narrow = written(taken.select("none", "conv", "turn", "role", "digest", (end == "").alias("blank"), (~end.isin(*ENDS)).alias("open")), "repair-rows")
    order = ["none", "conv", F.asc_nulls_first("turn"), "role", "digest"]
    placed = written(narrow.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "repair-order")

    key = ["none", "conv"]
    again = placed.where("NOT blank").groupBy(*key, "digest").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    marked = placed.join(again, [*key, "digest"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    marked = marked.withColumn("duplicate", duplicate).withColumn("truncated", ~F.col("blank") & ~duplicate & F.col("open"))
    role = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    code = F.when(F.col("blank") | F.col("duplicate"), 8).when(F.col("truncated"), 4).otherwise(0) + role
    marked = written(marked.select(*key, "turn", "place", "blank", "duplicate", "truncated", F.char(code + FIRST_LETTER).alias("code")), "repair-marked")

    counts = marked.groupBy(*key).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    turns = marked.where("turn IS NOT NULL").groupBy(*key, "turn").agg(F.lit(1).alias("one")).groupBy(*key).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    heads = marked.select(*key)
    if conversations is not None:
        heads = heads.unionByName(conversations.select(F.col(conv_col).isNull().alias("none"), conv.alias("conv")))
    heads = heads.distinct().join(counts, key, "left").join(turns, key, "left").select(*key, F.lit(0).alias("kind"), "gaps", "blank", "duplicate", "truncated", F.lit(0).cast("long").alias("illegal"), F.lit(0).cast("long").alias("cost"))

    parts = marked.groupBy(*key, F.shiftright("place", part_bits).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("row"))
    parts = written(parts.select(*key, "part", F.array_join(F.col("row.code"), "").alias("codes")), "repair-parts")
    found = edits(parts, kind.simpleString()).withColumn("kind", F.lit(1))
    texts = taken.select(*key, F.lit(2).alias("kind"), "turn", "role", "digest", "text")

    stream = heads.unionByName(found, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition(*key).sortWithinPartitions(*key, "kind", "part", F.asc_nulls_first("turn"), "role", "digest")
    told = stream.mapInArrow(_told, f"none boolean, conv {kind.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    return told.select(F.when(~F.col("none"), F.col("conv")).alias(conv_col), *_COUNTS, "audit", "repaired_sha256")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults that a hash of conversation and turn chooses: of twenty residues, 0 drops a row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it a user's. Nulls are one space; a null turn stays null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate(said(text_col), ENDS, "")).otherwise(said(text_col))
    role = F.when(F.col("_d") == 4, "user").otherwise(said(role_col))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select(conv_col, turn_col, role_col, text_col).withColumn("_d", chance).where("_d <> 0")
    return kept.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), F.explode(copies).alias("_copy")).drop("_copy")


def query(rows: DataFrame) -> DataFrame:
    return repaired(damaged(rows), rows)


_CHANCE = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20"
_SPACES = "||".join(f"chr({ord(c)})" for c in SPACE)

#: Row by row over all conversations at once: of each state the cheapest edits so far. w: whether a state's costs, edits and text go on by none, one or two inserted rows.
SQL = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CHANCE} AS d FROM conversations),
e AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE d <> 0),
r AS (SELECT *, right(rtrim(text, {_SPACES}), 1) AS last, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS pos FROM e),
f AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM r),
g AS (SELECT *, NOT blank AND NOT duplicate AND last NOT IN ('.', '!', '?') AS truncated FROM f),
w(q, onto, edits, paid, said) AS (VALUES (0, 0, '', 0, NULL), (1, 1, '', 0, NULL), (2, 2, '', 0, NULL), (3, 3, '', 0, NULL), (0, 2, 'I', 3, 'user:'), (1, 2, 'I', 3, 'user:'), (2, 3, 'I', 3, 'assistant:'), (3, 2, 'I', 3, 'user:'),
      (0, 3, 'II', 6, 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, 'user:' || chr(10) || 'assistant:'), (2, 2, 'II', 6, 'assistant:' || chr(10) || 'user:'), (3, 3, 'II', 6, 'user:' || chr(10) || 'assistant:')),
s(q, edit, onto, paid, kept, written) AS (VALUES (0, 'D', 0, 4, NULL, NULL), (1, 'D', 1, 4, NULL, NULL), (2, 'D', 2, 4, NULL, NULL), (3, 'D', 3, 4, NULL, NULL), (0, 'K', 1, 0, 's', NULL), (0, 'K', 2, 0, 'u', NULL), (1, 'K', 2, 0, 'u', NULL),
      (2, 'K', 3, 0, 'a', NULL), (3, 'K', 2, 0, 'u', NULL), (0, 'R', 2, 3, NULL, 'user'), (1, 'R', 2, 3, NULL, 'user'), (2, 'R', 3, 3, NULL, 'assistant'), (3, 'R', 2, 3, NULL, 'user')),
p AS (SELECT DISTINCT conv_id, 1::BIGINT AS pos, 0 AS q, {{'cost': 0, 'audit': '', 'out': NULL::VARCHAR}} AS best FROM conversations
      UNION ALL
      SELECT p.conv_id, p.pos + 1, s.onto, min({{'cost': p.best.cost + w.paid + s.paid + CASE WHEN g.truncated AND s.edit <> 'D' THEN 3 ELSE 0 END, 'audit': p.best.audit || w.edits || s.edit,
             'out': CASE WHEN s.edit = 'D' AND w.said IS NULL THEN p.best.out ELSE concat_ws(chr(10), p.best.out, w.said, CASE WHEN s.edit <> 'D' THEN coalesce(s.written, g.role) || ':' || g.text END) END}})
      FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.pos = p.pos JOIN w ON w.q = p.q JOIN s ON s.q = w.onto AND (s.edit = 'D' OR NOT g.blank AND NOT g.duplicate AND (s.kept IS NULL OR s.kept = g.i))
      GROUP BY p.conv_id, p.pos, s.onto),
a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
z AS (SELECT p.conv_id, min({{'cost': p.best.cost + w.paid, 'audit': p.best.audit || w.edits, 'out': CASE WHEN w.said IS NULL THEN p.best.out ELSE concat_ws(chr(10), p.best.out, w.said) END}}) AS best
      FROM p LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM p.conv_id JOIN w ON w.q = p.q AND w.onto IN (0, 3) WHERE p.pos = coalesce(a.n, 0) + 1 GROUP BY p.conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       z.best.cost::BIGINT AS cost, z.best.audit AS audit, sha256(coalesce(z.best.out, '')) AS repaired_sha256
FROM z LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""
