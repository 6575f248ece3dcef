"""The queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itembank.llm import embedding_dedup, exact_dedup, html_text, licenses, merkle, mixing, near_dedup, packing, quality, repair, sharding, toxicity, training_order
from itembank.llm.common import table


def over(name: str, query: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*[table(spark, sf_dir, t) for t in (name, *more)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": over("documents", packing.query),
    "op2_html_extraction": over("pages", html_text.query),
    "op3_license_scan": over("documents", licenses.query),
    "op4_quality_classifier": over("documents", quality.query, "labels"),
    "op5_near_dedup": over("documents", near_dedup.query),
    "op6_training_order": over("documents", training_order.query),
    "op7_embedding_dedup": over("embeddings", embedding_dedup.query),
    "op8_mix_sources": over("documents", mixing.query),
    "op9_exact_dedup": over("documents", exact_dedup.query),
    "op10_toxicity": over("documents", toxicity.query, "labels"),
    "op11_merkle_manifest": over("documents", merkle.query),
    "op12_sharding": over("documents", sharding.query),
    "op13_conversation_repair": over("conversations", repair.query),
}

SQL: dict[str, str] = {
    "op3_license_scan": licenses.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op8_mix_sources": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_sharding": sharding.SQL,
    "op13_conversation_repair": repair.SQL,
}
