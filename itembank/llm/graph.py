"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component for every node with a link; links: columns a, b. component is the smallest node reachable.

    Alternates large-star and small-star steps: every node hands its neighbours to the smallest of them, until nothing changes.
    Minima are aggregated before the shuffle and joined back, so neither a hub nor a component is gathered in one task, and
    what the driver sees of a round is one count and one checksum. Each round is written to the shared folder.
    Self-links are ignored; links with a null end too. No links: no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u > v").distinct()
    edges, seen = written(edges, name), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), name)
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        edges = written(both.where("v > u").join(least, F.expr("u = k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        near = edges.join(least, F.expr("u = k")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = written(near.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct(), name)
