"""Embedding near-dedup against brute force in double precision."""

from __future__ import annotations

import numpy as np
import pytest

from itembank.llm import embedding_dedup as E
from tests.llm.test_dedup import roots

SCHEMA = "vec_id long, embedding array<float>, label int, weight long, v string, id string"


def brute(rows, cosine=0.98):
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, dtype=np.float32).astype(np.float64))
    links = []
    for a, (la, va) in good.items():
        for b, (lb, vb) in good.items():
            if a < b and la == lb and len(va) == len(vb) and va @ vb / (np.sqrt(va @ va) * np.sqrt(vb @ vb)) >= cosine:
                links.append((a, b))
    return links


@pytest.mark.parametrize("block", [1500, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((40, 64))
    for i in range(220):
        v = base[i % 40] + rng.standard_normal(64) * (0.02, 0.1, 0.25, 0.6)[i % 4]
        rows.append((i, [float(x) for x in v * (1, 1e-3, 1e6)[i % 3]], i % 3))
    same = rows[0][1]
    rows += [(300 + i, same, 0) for i in range(20)] + [(400, [0.0] * 64, 0), (401, None, 0), (402, [float("nan")] * 64, 0), (403, [None] + same[1:], 0), (404, same, None), (None, same, 0), (405, same[:8], 0), (406, [2 * x for x in same[:8]], 0), (407, [], 1), (408, [float("inf")] + same[1:], 0)]
    df = spark.createDataFrame([(*r, 9, "clash", "clash") for r in rows], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(df).collect()}
    links = brute(rows)
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = roots([i for i, *_ in rows if i is not None], links)
    for i, *_ in rows:
        assert got[i] == ((n[i], root[i], root[i] == i) if i is not None else (0, None, True)), i


def test_bands_keep_the_chance_of_a_miss():
    for rows in (1, 500, 10**6, 10**11):
        bits, bands = E.band_shape(rows, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** bands <= 1.01 * E.MISS


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 64))
    x[100:] = x[:100] + 0.15 * rng.standard_normal((100, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x @ E.rotations(64, E.ROTATIONS)).reshape(200, E.ROTATIONS, 64)
    factor = np.abs(y).sum(axis=2) / 8
    estimate = np.mean([(np.sign(y[:, r]) / (8 * factor[:, r : r + 1])) @ y[:, r].T for r in range(E.ROTATIONS)], axis=0)
    spread = np.sqrt(((1 / factor**2 - 1) / 63).sum(axis=1)) / E.ROTATIONS
    error = (estimate - x @ x.T) / spread[:, None]
    assert np.abs(error).max() < E.SIGMAS and abs(error.mean()) < 0.1


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
