"""Where queries are registered: a name, a function of session and folder, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The question bank of sources.tables as SQL.
BANK = """
questions AS (
  SELECT doc_id AS id, (doc_id % 30 + 1)::INT AS question_number, text AS content, lang AS subject, source AS source_id,
    source || '.PDF' AS filename, (n_chars % 5 + 1)::INT AS difficulty,
    CASE doc_id % 6 WHEN 0 THEN 'single_choice' WHEN 1 THEN '选择题' WHEN 2 THEN 'fill_blank' WHEN 3 THEN 'calculation' WHEN 4 THEN 'essay' END AS question_type,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE left(text, 20) END AS answer,
    CASE WHEN doc_id % 5 <> 0 THEN substr(text, 21, 30) END AS explanation,
    'G' || (doc_id % 3 + 7) AS grade, doc_id % 11 = 0 AS is_deleted,
    CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 10) / 2 END AS score,
    CASE WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'approved' END AS review_status
  FROM documents),
links AS (
  SELECT doc_id AS question_id, 'quality' AS tag_id FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
used AS (
  SELECT DISTINCT question_id FROM (
    SELECT item_id * 3 AS question_id FROM benchmark
    UNION ALL SELECT CASE WHEN turn = 1 THEN conv_id * 5 END FROM conversations))
"""


def query(name: str, sql: str | None = None, bank: bool = False) -> Callable[[Query], Query]:
    """Registers a function; with bank, its SQL may use questions, links and used."""
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {BANK} {sql}" if bank else sql
        return f

    return add
