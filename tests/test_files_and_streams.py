"""File sources, sinks and the job stream on small files."""

from __future__ import annotations

import json

from itembank.sources import files as S
from itembank.streaming import jobs as J


def test_discovery_names_and_guards(spark, tmp_path):
    for name in ("a/Paper.pdf", "b/paper.pdf", "b/notes.txt", "c/x.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = S.discover(spark, str(tmp_path), "*")
    assert found.count() == 4 and S.discover(spark, str(tmp_path)).count() == 2
    known = spark.createDataFrame([("notes.txt",)], "filename string")
    assert {(r["filename"], r["starts_job"]) for r in S.accepted(found, known).collect()} == {("Paper.pdf", True), ("paper.pdf", True)}
    names = {r["stem"]: r["output"] for r in S.output_names(found).collect()}
    assert names["notes"] == "notes" and names["Paper"].startswith("Paper-") and names["Paper"] != names["paper"]


def test_both_json_shapes(spark, tmp_path):
    q = {"id": "1", "number": 1, "content": {"stem": "", "options": {"B": "2", "A": "1"}}, "answer": {"answer": "A", "analysis": "why"}, "text": {"native": "n"}, "quality": {"ocr_confidence": 0.5, "needs_review": True}}
    (tmp_path / "a.json").write_text(json.dumps({"questions": [q]}))
    (tmp_path / "b.json").write_text(json.dumps([q, q | {"id": "2", "quality": None, "text": None, "content": None}]))
    rows = S.bank_rows(S.read_extraction(spark, str(tmp_path))).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["1", "1", "2"]
    assert (rows[0]["content"], rows[0]["explanation"], rows[0]["review_status"]) == ("n", "why", "pending")
    assert rows[2]["review_status"] == "approved" and [o["key"] for o in rows[0]["options"]] == ["A", "B"]


def test_seed_only_into_an_empty_table(spark):
    seed = {"physics": {"mechanics": ["forces", "work"]}}
    assert S.seed_tags(spark, seed).count() == 3
    assert S.seed_tags(spark, seed, spark.range(1)).count() == 0
    assert S.seed_tags(spark, seed, spark.range(0)).count() == 3


def test_versions_and_reports(spark, tmp_path):
    at = S.write_versioned(spark.range(3), str(tmp_path / "t"), "1")
    assert spark.read.parquet(at).count() == 3
    S.write_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_latest_states_stream(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "j", "queued", 1), ("e2", "j", "running", 2), ("e2", "j", "running", 2), ("e3", "k", "queued", 3)], "event_id string, job_id string, status string, s int").selectExpr("event_id", "job_id", "status", "timestamp_seconds(s) AS at")
    rows.write.parquet(str(tmp_path / "log"))
    stream = J.latest_states(J.job_events(spark, str(tmp_path / "log"), rows.schema))
    run = stream.writeStream.format("memory").queryName("job_states").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {r["job_id"]: (r["status"], r["events"]) for r in spark.table("job_states").collect()} == {"j": ("running", 2), "k": ("queued", 1)}
