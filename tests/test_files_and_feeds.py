"""Readers, writers and streams on small files."""

import hashlib
import json

from marksmith.sources import files
from marksmith.streaming import feeds


def run_stream(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_keys_and_papers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {}, "questions": {"Q1": {"answer": "x", "marks": 2}, "_instructions_": {}}}))
    (tmp_path / "b.json").write_text(json.dumps({"Q2": {"question": "why", "marks": "1.5", "answer": "y"}, "metadata": {"subject": "z"}}))
    (tmp_path / "c.json").write_text("no json")
    rows = files.read_keys(spark, str(tmp_path)).collect()
    assert {(r.file[-6:], r.qid, r.answer, r.marks) for r in rows} == {("a.json", "Q1", "x", "2"), ("b.json", "Q2", "y", "1.5")}
    assert files.read_papers(spark, str(tmp_path)).columns == ["file", "qid", "question", "marks", "type"]


def test_pages_in_natural_order(spark, tmp_path):
    for name in ("page_10.txt", "page_2.txt", "cover.txt"):
        (tmp_path / name).write_text(name)
    rows = files.read_pages(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in rows] == [(None, "cover.txt"), (2, "page_2.txt"), (10, "page_10.txt")]


def test_costs_and_manifest(spark, tmp_path):
    lines = '{"run_id": "a", "stage": "s", "model": "m", "input_tokens": 3}\n\nbroken\n'
    (tmp_path / "c.jsonl").write_text(lines)
    rows = files.read_costs(spark, str(tmp_path)).collect()
    assert {(r.run_id, r.input_tokens, r.malformed) for r in rows} == {("a", 3, None), (None, None, "broken")}
    only = files.file_manifest(spark, str(tmp_path)).collect()
    assert [(r.sha256, r.bytes) for r in only] == [(hashlib.sha256(lines.encode()).hexdigest(), len(lines))]


def test_runs_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "results")
    files.replace_runs(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run_id string, mark int"), path)
    files.replace_runs(spark.createDataFrame([("a", 9)], "run_id string, mark int"), path)
    assert {(r.run_id, r.mark) for r in files.read_runs(spark, path).collect()} == {("a", 9), ("b", 3)}


def test_destination(spark):
    rows = spark.createDataFrame([("10 / A", "Maths"), (None, " ")], "c string, s string").select(*files.destination("c", "s")).collect()
    assert [tuple(r) for r in rows] == [("10_A", "Maths"), ("unknown_class", "unknown_subject")]


def test_streams(spark, tmp_path):
    cost, decided, done = (tmp_path / n for n in ("cost", "decided", "done"))
    for d in (cost, decided, done):
        d.mkdir()
    price = spark.createDataFrame([("m", 1.0, 2.0)], "model string, price_in double, price_out double")
    (cost / "1.json").write_text('{"run_id": "a", "stage": "s", "model": "m", "input_tokens": 1000000, "output_tokens": 0}\n')
    (cost / "2.json").write_text('{"run_id": "a", "stage": "s", "model": "m", "input_tokens": 1, "output_tokens": 1, "billed": 0.5}\n')
    rows = run_stream(feeds.cost_stream(spark, str(cost), price), "cost")
    assert [(r.run_id, r.calls, r.tokens, float(r.cost)) for r in rows] == [("a", 2, 1000002, 1.5)]
    (decided / "1.json").write_text('{"review_id": 1, "base": 1, "seq": 2, "decision": "accept"}\n{"review_id": 1, "base": 1, "seq": 1, "decision": "reject", "corrected_marks": 2}\n')
    assert [(r.decision, r.seq) for r in run_stream(feeds.decision_stream(spark, str(decided)), "decided")] == [("accept", 2)]
    (done / "1.json").write_text('{"batch_id": "b", "sheet_no": 2, "status": "done"}\n{"batch_id": "b", "sheet_no": 1, "status": "failed"}\n')
    assert [(r.finished, r.failed) for r in run_stream(feeds.progress_stream(spark, str(done)), "done")] == [(2, 1)]
