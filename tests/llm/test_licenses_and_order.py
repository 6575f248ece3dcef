"""Licence scans against brute force; the training order as a permutation, a round trip and a resumable read."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from itembank.llm import licenses, packing
from itembank.llm import training_order as O


def grams(text):
    w = licenses._words(text)
    return {*zip(w, w[1:])}


def brute(text):
    text = text or ""
    apart, sentences = re.split(r"\n[ \t]*\n", text), re.split(r"[.!?][ \t\n\r\f]+", text)
    units = [*text.split("\n"), *([p for p in apart if "\n" in p] + [text] if len(apart) > 1 else []), *(sentences if len(sentences) > 1 else [])]
    found = []
    for i, u in enumerate(units):
        a = grams(u)
        for name, t in licenses.TEMPLATES.items():
            b = grams(t)
            d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if d >= licenses.LEAST:
                found.append((-len(a & b), -d, i, name))
    return ",".join(sorted({f[-1] for f in found})), min(found)[3] if found else None, round(-min(found)[1], 4) if found else 0.0, min(found)[2] if found else None, text.count("\n") + 1


PROBES = {"Some text here. Released under the MIT License. Thanks to all": "MIT short", "Copyright 2020 Foo. All rights reserved.": "Proprietary", "MIT License": "MIT name", "# SPDX-License-Identifier: GPL-3.0-or-later": "SPDX GPL-3.0-or-later", "as said in\nthe paper. Licensed under\nCC BY 4.0. See more": "CC-BY", (licenses.TEMPLATES["Apache-2.0"] + "\n\n") * 6: "Apache-2.0", "It is said. This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser\nGeneral Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\ncode": "LGPL"}


@pytest.mark.parametrize("text", sorted(PROBES))
def test_notices_inside_other_text(spark, documents, text):
    assert PROBES[text] in licenses.scan_licenses(documents([(1, text, "s")])).first()["licenses"]


@pytest.mark.parametrize("name", ["BSD-3-Clause full", "BSD-2-Clause full", "MIT full", "ISC full"])
def test_a_licence_outranks_the_notice_above_it(spark, documents, name):
    """The notices of a copyright line are found, too, but the licence below it is the best one."""
    text = f"Copyright (c) 2020, Foo.\nAll rights reserved.\n\n{licenses.TEMPLATES[name].replace(', ', ',' + chr(10), 5)}"
    found = licenses.scan_licenses(documents([(1, text, "s")])).first()
    assert found.best_license == name and found.best_dice > 0.9 and "Proprietary" in found.licenses


def test_a_notice_in_the_middle_of_a_sentence_is_told(spark, documents):
    """By its template's wording, whatever stands between the words; a part of it, or longer words, are none."""
    texts = ["see foo.c, licensed under the mit license, for details", "as the\n// Apache License,\n// Version 2.0 says, so", "the emit license, or the MIT licenses", "", None]
    found = {r["doc_id"]: r["inside"] for r in licenses.scan_licenses(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert found == {0: ["MIT licensed", "MIT name"], 1: ["Apache-2.0 name"], 2: [], 3: [], 4: []}


def test_cues_lose_no_match():
    """Any text with the least share of a template's bigrams has a cue."""
    cues = {*licenses._cues(licenses.TEMPLATES, 0.8)}
    for t in licenses.TEMPLATES.values():
        b = grams(t)
        assert 3 * sum(not cues & {*g} for g in b) < 2 * len(b), t  # a match has two thirds of the bigrams


def test_scan_equals_brute_force(spark, documents):
    t = licenses.TEMPLATES
    long = "word " * 50_000
    texts = [None, "", "all", "All rights reserved.", "all RIGHTS -- reserved!\nx", f"intro\n{t['MIT short']}\n{t['CC-BY-NC']}", f"All rights reserved.\n{t['BSD-3-Clause full']}", f"{t['GPL']}\n\n{t['GPL no warranty']}\nAll rights reserved.", t["MIT"].replace(", ", ",\n", 4), f"head\n\n{t['BSD'].replace(' in ', chr(10) + 'in ')}\n\ntail", t["Apache-2.0"][:-60], "Licensed under the Apache License, Version 3.0.", long, f"{long}\nReleased under the MIT License.", t["GPL"] + " " + t["GPL"]]
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(None, "All rights reserved.", "s"), (3, texts[3], "s")]
    got = licenses.query(documents(rows)).collect()
    want = {i: brute(x) for i, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["licenses"], r["best_license"], r["best_dice"], r["unit"], r["n_lines"]) == want[r["doc_id"]], r["doc_id"]
    assert licenses.query(documents(rows).where("false")).count() == 0


def test_size_bounds_lose_nothing():
    sizes = licenses._candidates(licenses.TEMPLATES, 0.8)
    for name, t in licenses.TEMPLATES.items():
        b = len(grams(t))
        assert all((name in sizes.get(n, [])) == (2 * min(n, b) / (n + b) >= 0.8) for n in range(1, 3 * b))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_the_network_permutes(n):
    one, two = O.permuted(np.arange(n), n, 1), O.permuted(np.arange(n), n, 2)
    assert sorted(one) == list(range(n)) and sorted(two) == list(range(n))
    if n >= 1000:
        assert (one != two).mean() > 0.9 and abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.1


@pytest.mark.parametrize("beyond", [False, True])
def test_sequences_come_back_in_any_read(spark, documents, tmp_path, monkeypatch, request, beyond):
    """beyond: with more documents than are broadcast, so that their numbers come by a shuffle."""
    from tokenizers import Tokenizer

    if beyond:
        monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, "word " * (i * 37 % 900), "s") for i in range(60)] + [(None, None, "s"), (7, "again", "s"), (7, "again", "s")]
    where = O.in_training_order(documents(rows), packing.default_tokenizer(), f"file://{tmp_path}/a", key=3, shard_rows=16).collect()
    n = len(where)
    assert sorted(r["slot"] for r in where) == list(range(n))
    records = list(O.read_slots(f"file://{tmp_path}/a", 0, n, shard_rows=16))
    assert len(records) == n
    for a, b in ((5, 30), (31, 1), (n - 2, 99)):
        assert all((x == y).all() for x, y in zip(O.read_slots(f"{tmp_path}/a", a, b, shard_rows=16), records[a : a + b]))
    back = {}
    for r in where:
        ids = records[r["slot"]][: r["length"]]
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // 16, r["slot"] % 16 * 512) and zlib.crc32(ids.astype("<u2").tobytes()) == r["ids_crc32"]
        assert not records[r["slot"]][r["length"] :].any()
        back.setdefault((r["doc_id"], r["start"], r["piece"]), []).append(ids.tolist())
    for i in range(60):
        if i != 7:
            whole = [x for k in sorted(k for k in back if k[0] == i) for x in back[k][0]]
            assert whole == [*tokenizer.encode(rows[i][1], add_special_tokens=False).ids, 1]
    assert back[None, 0, 0] == [[1]] and len([1 for r in where if r["doc_id"] == 7 and r["length"] == 2]) == 2
    again = O.in_training_order(documents(rows[::-1]).repartition(7), packing.default_tokenizer(), f"file://{tmp_path}/b", key=3, shard_rows=16)
    key = lambda r: (str(r["doc_id"]), r["piece"], r["length"], r["slot"])
    assert sorted(map(key, where)) == sorted(map(key, again.collect()))
    assert all((x == y).all() for x, y in zip(O.read_slots(f"{tmp_path}/b", 0, n, shard_rows=16), records))


def test_many_repeated_rows(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "COPIES", 7)
    rows = [(4, "again " * 700, "s")] * 40 + [(None, None, "s")] * 9 + [(i, f"text {i}", "s") for i in range(10, 15)]
    where = O.in_training_order(documents(rows), packing.default_tokenizer(), f"file://{tmp_path}/d", key=5, shard_rows=8).collect()
    assert sorted(r["slot"] for r in where) == list(range(40 * 3 + 9 + 5))
    records = list(O.read_slots(f"{tmp_path}/d", 0, 999, shard_rows=8))
    assert all(zlib.crc32(records[r["slot"]][: r["length"]].astype("<u2").tobytes()) == r["ids_crc32"] for r in where)
    assert sum(r["doc_id"] is None for r in where) == 9 and sum(r["length"] for r in where if r["doc_id"] == 4) == 40 * 701
    assert not [p for p in (tmp_path / "d").iterdir() if p.suffix != ".bin"]


def test_ids_that_are_too_wide_raise(spark, documents, tmp_path):
    with pytest.raises(Exception, match="need more than 1 bytes"):
        O.in_training_order(documents([(1, "zebra", "s")]), packing.default_tokenizer(), f"file://{tmp_path}/e", key=1, width=1)


def test_no_documents_no_shards(spark, documents, tmp_path):
    assert O.in_training_order(documents([(1, "x", "s")]).where("false"), packing.default_tokenizer(), f"file://{tmp_path}/c", key=1).count() == 0
