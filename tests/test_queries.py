"""Every registered reference query against its SQL at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from itembank import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    found = duck.execute(plans.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert _sorted([tuple(r) for r in got.collect()], got.columns) == _sorted(found.fetchall(), columns)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


TEXTS = ["a $x$ b $ y $ c $$z$$", "costs 5$ and 6$", "$$ y $$ c\n$$a", "$ {a $ b $ $ $c$", "a \\(x\\) t \\[z\\] u", "", "  \n ", "*** a b*** c *i* **b** *", "- li\n12. n\n## h\n#### i\n#no\n\n\n\nend", "A. x\nB. y A. z  \nD、 <w> & \"q\" 'p'", "$$$ el y$$$ armici$$$ ñes&&& $$$ x", "$a$$b$ $$c$$$d$", "x" * 150, "y" * 151 + " $z$", None]


@pytest.mark.parametrize("name", ["math_segments", "doc_html", "parse_options", "rendered_texts"])
def test_odd_texts_give_what_sql_gives(spark, sf_dir, tmp_path, name):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("labels", "benchmark", "conversations", "documents"):
        folder = tmp_path if t == "documents" else sf_dir
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    got = plans.QUERIES[name](spark, str(tmp_path))
    found = con.execute(plans.SQL[name])
    assert _sorted([tuple(r) for r in got.collect()], got.columns) == _sorted(found.fetchall(), [c[0] for c in found.description])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plans_have_no_cross_or_nested_loop_joins(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plans.QUERIES["library_page"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "TakeOrderedAndProject" in plan
    brief = plans.QUERIES["practice_briefs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in brief
