"""A Merkle manifest of a dataset: leaves placed by rank queries on bitmaps of ids, levels reduced in keyed runs of slots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import LOWER, UPPER, written
from itembank.llm.ranks import numbered, ranked

#: Children of a node. A block of BLOCK nodes is reduced by LEVELS levels in one step.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows give one string."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]).cast("binary"), 256)


def joined_digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def levels_above(digests: list[str], whole: bool) -> list[list[str]]:
    """The levels over a block's nodes, the nodes first: up to the one node left if the block is its whole group, else LEVELS."""
    levels = [digests]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([joined_digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """For each level, what stands before and after the node's place in its run."""
    found = []
    for nodes in levels[:-1]:
        run = slot // FAN * FAN
        found.append(("".join(nodes[run:slot]), "".join(nodes[slot + 1 : run + FAN])))
        slot //= FAN
    return found


def folded(digest: str, path: Iterable[tuple[str, str]]) -> str:
    for before, after in path:
        digest = joined_digest((before, digest, after))
    return digest


def _digests(nodes: pa.Table) -> tuple[pa.Table, list[list[str]]]:
    nodes = nodes.sort_by("rank")
    return nodes, levels_above(nodes.column("digest").to_pylist(), nodes.column("nodes")[0].as_py() <= BLOCK)


def _reduce(nodes: pa.Table) -> pa.Table:
    g, block, n = (nodes.column(c)[0].as_py() for c in ("g", "block", "nodes"))
    return pa.table({"g": [g], "rank": [block], "nodes": [n], "digest": [_digests(nodes)[1][-1][0]]})


_PATH = "path array<struct<before: string, after: string>>"


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The path of each of a block's nodes: its own levels, then the block's."""
    nodes, levels = _digests(nodes)
    up = [(p["before"], p["after"]) for p in above.column("path")[0].as_py()]
    paths = [[{"before": b, "after": a} for b, a in [*siblings(levels, slot), *up]] for slot in range(len(nodes))]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"g": nodes.column("g"), "rank": nodes.column("rank"), "path": pa.array(paths, kind), "subroot": pa.array([above.column("subroot")[0].as_py()] * len(nodes), pa.string())})


def _prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """For each leaf of a block the digest of its siblings up to the root, and the root that its present state leads to."""
    nodes, levels = _digests(nodes)
    up = [(p["before"], p["after"]) for p in above.column("path")[0].as_py()]
    upper, top = "".join(b + a for b, a in up), {}
    proofs, roots = [], []
    for slot, now in enumerate(nodes.column("now").to_pylist()):
        own = siblings(levels, slot)
        proofs.append(joined_digest([*(b + a for b, a in own), upper]))
        at = folded(now, own)
        if at not in top:  # leaves that lead to one node of the block share the way from there
            top[at] = folded(at, up)
        roots.append(top[at])
    return pa.table({"id": nodes.column("id"), "leaf": nodes.column("digest"), "rank": nodes.column("rank"), "subroot": pa.array([above.column("subroot")[0].as_py()] * len(nodes), pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {BLOCK}"))


def _reduced(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each step (g, rank, nodes: how many the group has, digest) in blocks, and every group's last node."""
    steps, roots = [], None
    while True:
        steps.append(_in_blocks(nodes))
        up = written(steps[-1].select("g", "block", "rank", "nodes", "digest").groupBy("g", "block").applyInArrow(_reduce, "g long, rank long, nodes long, digest string"), name)
        done = up.where(F.col("nodes") <= BLOCK).select("g", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if up.where(F.col("nodes") > BLOCK).isEmpty():
            return steps, roots
        nodes = up.where(F.col("nodes") > BLOCK).withColumn("nodes", F.ceil(F.col("nodes") / BLOCK).cast("long"))


def _paths(steps: list[DataFrame], last: DataFrame, name: str) -> DataFrame:
    """Of each block of the first step its path and subroot. last: those of each group's last node (g, path, subroot)."""
    paths = None
    for step in reversed(steps):
        here = step.where((F.col("nodes") <= BLOCK) & (F.col("rank") == 0)).select("g").join(last, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if paths is not None:
            here = here.unionByName(paths.withColumnRenamed("rank", "block"))
        here = written(here, name)
        if step is steps[0]:
            return here
        nodes = step.select("g", "block", "rank", "nodes", "digest")
        paths = written(nodes.groupBy("g", "block").cogroup(here.groupBy("g", "block")).applyInArrow(_descend, f"g long, rank long, {_PATH}, subroot string"), name)
    raise ValueError("no steps")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, now: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, leaf_rank, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's framed fields. Within a group leaves ascend by id, runs of eight become one node until one is left,
    the subroot; the groups' subroots, null group first and then by bytes, become the root in the same way. now: columns that
    a verifier finds instead, in rows where changed holds; folded_root is the root that these lead to with the original siblings.

    Texts are read once, for two digests. A leaf's coordinates come from bitmaps of ids (llm.ranks). Blocks of 512 places are reduced
    to their node, these by 512 again, and the ways back down carry each block's siblings: a task holds a block, whatever a group has,
    and the driver one digest.

    Nulls: a null field is `-`, a null group a group, a row without an id comes before the others of its group and isn't changed by
    a condition on its id. Repeated rows of an id ascend by leaf, equal ones in any order. Empty and very long texts are framed as any.
    Empty table: no rows. Other columns aren't read, whatever their names.
    """
    now = now or {}
    leaf = leaf_digest([F.col(f) for f in fields])
    found = leaf_digest([now.get(f, F.col(f)) for f in fields])
    found = F.when(F.coalesce(changed, F.lit(False)), found) if changed is not None else F.lit(None).cast("string")
    leaves = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("tie"), found.alias("now"), F.monotonically_increasing_id().alias("uid")), "merkle-leaves")
    groups = leaves.groupBy("grp").agg(F.count("*").alias("nodes"))
    groups = written(numbered(groups, F.asc_nulls_first("grp"), name="merkle-order").select("grp", "nodes", F.col("number").alias("g")), "merkle-groups")
    rows = leaves.join(groups.withColumnRenamed("grp", "named"), F.col("grp").eqNullSafe(F.col("named")))
    nodes = written(ranked(written(rows.select("g", "nodes", "id", "tie", "now", "uid"), "merkle-rows"), "merkle").select("g", "rank", "nodes", F.col("tie").alias("digest"), "id", F.coalesce("now", "tie").alias("now")), "merkle-nodes")

    steps, subroots = _reduced(nodes, "merkle-step")
    subroots = written(subroots, "merkle-subroots")
    crown = written(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.lit(groups.count()).cast("long").alias("nodes"), "digest"), "merkle-crown")
    top, roots = _reduced(crown, "merkle-top")
    root = roots.first()
    root = None if root is None else root["digest"]
    none = F.array().cast(_PATH.split(" ", 1)[1])
    ways = _paths(top, top[-1].select("g").distinct().withColumn("path", none).withColumn("subroot", F.lit(root)), "merkle-down")
    down = top[0].select("g", "block", "rank", "nodes", "digest").groupBy("g", "block").cogroup(ways.groupBy("g", "block")).applyInArrow(_descend, f"g long, rank long, {_PATH}, subroot string")
    last = written(down.select(F.col("rank").alias("g"), "path").join(subroots.select("g", F.col("digest").alias("subroot")), "g"), "merkle-last")

    blocks = _paths(steps, last, "merkle-down")
    proved = steps[0].groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(_prove, "id long, leaf string, rank long, subroot string, proof_sha256 string, folded_root string")
    return proved.select(F.col("id").alias(id_col), "leaf", F.col("rank").alias("leaf_rank"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def query(docs: DataFrame) -> DataFrame:
    """Rows whose id's crc32 is a multiple of 3 are tampered with: their texts' A-Z in lower case."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(docs, now={"text": F.translate("text", UPPER, LOWER)}, changed=changed)


def _framed_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


_LEAF = f"sha256({' || '.join(_framed_sql(f) for f in FIELDS)})"
_NOW = f"sha256({' || '.join(_framed_sql(f) for f in FIELDS[:-1])} || {_framed_sql(f'''translate(text, '{UPPER}', '{LOWER}')''')})"
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"


def _tree_sql(name: str, key: str, start: str) -> str:
    """Tables for a forest: NAME (key, level, slot, n, digest), NAME_beside with each node's siblings before and after it."""
    run = f"PARTITION BY {key}, level, slot // {FAN} ORDER BY slot ROWS BETWEEN"
    return f"""{name} AS (SELECT {key}, 0 AS level, slot, n, digest FROM ({start})
      UNION ALL SELECT {key}, level + 1, slot // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY slot)) FROM {name} WHERE n > 1 GROUP BY {key}, level, slot // {FAN}, n),
{name}_beside AS (SELECT {key}, level, slot, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
      coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name} WHERE n > 1)"""


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, lang, {_LEAF} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 3 = 0 THEN {_NOW} ELSE {_LEAF} END AS now FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_tree_sql("tree", "lang", "SELECT lang, slot, n, leaf AS digest FROM o")},
tops AS (SELECT 0 AS one, lang, digest, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM tree WHERE n = 1),
{_tree_sql("crown", "one", "SELECT one, slot, n, digest FROM tops")},
walk AS (SELECT uid, lang, 0 AS level, slot, now AS at, '' AS proof FROM o
         UNION ALL SELECT w.uid, w.lang, w.level + 1, w.slot // {FAN}, sha256(b.before || w.at || b.after), w.proof || b.before || b.after FROM walk w JOIN tree_beside b ON b.lang IS NOT DISTINCT FROM w.lang AND b.level = w.level AND b.slot = w.slot),
climb AS (SELECT w.uid, 0 AS level, t.slot, w.at, w.proof FROM walk w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang AND t.height = w.level
          UNION ALL SELECT c.uid, c.level + 1, c.slot // {FAN}, sha256(b.before || c.at || b.after), c.proof || b.before || b.after FROM climb c JOIN crown_beside b ON b.level = c.level AND b.slot = c.slot),
root AS (SELECT digest AS root, level FROM crown WHERE n = 1)
SELECT o.doc_id, o.leaf, o.slot AS leaf_rank, t.digest AS subroot, r.root, sha256(c.proof) AS proof_sha256, c.at AS folded_root, c.at = r.root AS verified
FROM o JOIN tops t ON t.lang IS NOT DISTINCT FROM o.lang JOIN climb c ON c.uid = o.uid JOIN root r ON c.level = r.level
"""
