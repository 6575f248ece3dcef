"""The operators' queries against their SQL at the smallest scale, and the registry without this subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from itembank.llm import queries

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    clean = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(clean(r) for r in found.fetchall()) == sorted(clean(r) for r in got.select(columns).collect())


def test_registry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", ".hypothesis"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    n, ops, pipeline = out.stdout.split()
    assert int(n) >= 70 and (ops, pipeline) == ("False", "False")
