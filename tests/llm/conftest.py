from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text, source) with extra columns whose names operators might use themselves."""
    def make(rows):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        for name in ("id", "n", "h", "s", "norm", "kept", "component_id", "size", "key", "bucket", "label", "block"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def texts():
    """Texts of a small language, with exact and near copies, blanks, one-word texts and a very long one."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(120)]
    for base in out[:12]:
        w = base.split()
        for _ in range(4):
            v = list(w)
            for _ in range(max(1, len(w) // 15)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
        out += [base.upper(), base]
    return [*out, "", None, "  \t\n ", "one", "ONE", "two words", " ".join(rng.choices(words, k=30_000)), "é È", "É è"]
