"""Stores of runs: whole replacement, idempotent batches, conflicts and compaction; bundles of a sweep that is killed."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from marksmith.sources import archive, files, runs
from marksmith.streaming import feeds


def marks(spark, rows):
    return spark.createDataFrame(rows, "run_id string, mark int")


def test_all_tables_of_a_run_are_replaced_as_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    runs.replace_run_tables(spark, path, {"result": marks(spark, [("a", 1), ("a", 2), ("b", 3)]), "page": marks(spark, [("a", 7)])})
    read = lambda t: sorted((r.run_id, r.mark) for r in files.read_runs(spark, path, t).collect())
    assert read("result") == [("a", 1), ("a", 2), ("b", 3)] and read("page") == [("a", 7)]
    monkeypatch.setattr(runs.RunStore, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        runs.replace_run_tables(spark, path, {"result": marks(spark, [("a", 9)]), "page": marks(spark, [("b", 8)])})
    assert read("result") == [("a", 1), ("a", 2), ("b", 3)] and read("page") == [("a", 7)]  # half a run is never seen
    monkeypatch.undo()
    runs.replace_run_tables(spark, path, {"result": marks(spark, [("a", 9)])})
    assert read("result") == [("a", 9), ("b", 3)] and read("page") == []  # everything of run a was dropped


def test_a_named_batch_counts_once_and_survives_compaction(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "s"), buckets=4)
    for k in range(3):
        assert store.commit(f"b{k}", {"result": marks(spark, [("a", k), (f"r{k}", k)])}, marks(spark, [("a", 0), (f"r{k}", 0)]))
        assert not store.commit(f"b{k}", {"result": marks(spark, [("a", 99)])}, marks(spark, [("a", 0)]))
    want = [("a", 2), ("r0", 0), ("r1", 1), ("r2", 2)]
    read = lambda: sorted((r.run_id, r.mark) for r in store.read("result").collect())
    assert read() == want
    store.compact()
    assert read() == want and len(store.log()) == 1 and not store.commit("b1", {"result": marks(spark, [("a", 99)])}, marks(spark, [("a", 0)]))
    assert len([d for d in os.listdir(tmp_path / "s/data/result") if d.startswith("store_batch=")]) == 1
    store.commit("b9", {"result": marks(spark, [])}, marks(spark, [("a", 0)]))
    assert read() == want[1:]
    assert runs.RunStore(spark, str(tmp_path / "none")).read("result", "run_id string").count() == 0


def test_files_grow_with_buckets(spark, tmp_path):
    many = spark.range(3000).selectExpr("CAST(id AS STRING) AS run_id", "1 AS mark")
    store = runs.RunStore(spark, str(tmp_path / "s"), buckets=8)
    store.commit("all", {"result": many}, many)
    found = [f for _, _, names in os.walk(tmp_path / "s/data/result") for f in names if f.endswith(".parquet")]
    assert len(found) == 8 and store.read("result").count() == 3000


def test_snapshots_are_written_once_even_beside_another_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    archive.write_snapshot(marks(spark, [("a", 1)]), path)
    publish, calls = runs.RunStore.publish, []

    def beaten(self, entry, seq):
        if not calls:  # another job commits run b between our look at the store and our commit
            calls.append(1)
            archive.write_snapshot(marks(spark, [("b", 5)]), path)
        return publish(self, entry, seq)

    monkeypatch.setattr(runs.RunStore, "publish", beaten)
    archive.write_snapshot(marks(spark, [("a", 2), ("b", 2), ("c", 2)]), path)
    assert sorted((r.run_id, r.mark) for r in archive.read_snapshots(spark, path).collect()) == [("a", 1), ("b", 5), ("c", 2)]


def test_index_and_its_lines(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "run_id string, content_hash string, archived_at string, note string")
    path = str(tmp_path / "index")
    archive.write_index(rows(("a", "h", "1", "old"), ("a", "h", "2", "new, quoted"), ("b", "h", "1", "x")), path)
    archive.write_index(rows(("b", "h", "3", "y"), ("b", "i", "3", "z")), path)
    got = sorted(tuple(r) for r in archive.read_index(spark, path).collect())
    assert got == [("a", "h", "2", "new, quoted"), ("b", "h", "3", "y"), ("b", "i", "3", "z")]
    assert [r.line for r in archive.index_lines(rows(("a", "h", "2", "new, quoted"), ("b", "h", "1", "x"))).collect()] == ["b,h,1,x", 'a,h,2,"new, quoted"']


def test_manifest_by_run(spark, tmp_path):
    for name, text in {"r1/state.json": "{}", "r1/Report.PDF": "pdf", "r1/evidence/1.png": "p", "r2/state.json": "[]", "loose.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = files.run_manifest(files.file_manifest(spark, str(tmp_path)), str(tmp_path)).orderBy("run_id").collect()
    assert [(r.run_id, [f.name for f in r.files], r.n_files, r.bytes, r.has_pdf, r.has_evidence) for r in rows] == [
        ("r1", ["Report.PDF", "evidence/1.png", "state.json"], 3, 6, True, True), ("r2", ["state.json"], 1, 2, False, False),
    ]


def test_a_sweep_killed_between_write_and_commit_is_repeated_without_a_second_version(spark, tmp_path, monkeypatch):
    source, index, state = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    source.mkdir()
    put = lambda name, *rows: (source / name).write_text("".join(json.dumps(dict(zip(("run_id", "content", "archived_at"), r))) + "\n" for r in rows))
    sweep = lambda at: feeds.archive_stream(spark, str(source), "run_id STRING, content STRING, archived_at STRING", index).option("checkpointLocation", at).trigger(availableNow=True).start()
    versions = lambda: sorted((r.run_id, r.version, r.content) for r in feeds.archived(spark, index).collect())
    put("1.json", ("a", "one", "1"), ("b", "one", "1"))
    publish = runs.RunStore.publish
    monkeypatch.setattr(runs.RunStore, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        sweep(state).awaitTermination()
    assert versions() == []
    monkeypatch.setattr(runs.RunStore, "publish", publish)
    sweep(state).awaitTermination()
    assert versions() == [("a", 1, "one"), ("b", 1, "one")]

    def after(self, entry, seq):  # this time it is killed when the log has the batch, but the stream doesn't know
        publish(self, entry, seq)
        raise RuntimeError("killed")

    put("2.json", ("a", "two", "2"), ("b", "one", "2"))
    monkeypatch.setattr(runs.RunStore, "publish", after)
    with pytest.raises(Exception, match="killed"):
        sweep(state).awaitTermination()
    monkeypatch.setattr(runs.RunStore, "publish", publish)
    sweep(state).awaitTermination()
    sweep(str(tmp_path / "anew")).awaitTermination()  # and a sweep that begins anew finds nothing
    assert versions() == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "one")]


REPLIES = {
    '{"Marks Awarded": 2, "Feedback": "ok"}': ("clean", "2", "ok"),
    'so: {"Marks Awarded": 2, "Feedback": "a \\d b"} end': ("repaired", "2", "a \\d b"),
    '{"Marks Awarded": 1, "Feedback": "a } in \\"quotes\\" {"} and then {more} prose': ("repaired", "1", 'a } in "quotes" {'),
    '{"Marks Awarded": 3, "Feedback": "f", "Justification": {"a": {"b": 1}}} tail }': ("repaired", "3", "f"),
    '{"Marks Awarded": 1.5, "Feedback": "say \\"yes\\"", "Justification": "cut off': ("salvaged", "1.5", 'say "yes"'),
    "none at all": ("failed", None, None), "": ("failed", None, None), "{": ("failed", None, None), None: ("failed", None, None),
}


def test_replies(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(REPLIES)], "k int, raw string")
    got = {r.k: (r.parse_status, r.marks_awarded, r.feedback) for r in archive.parse_replies(rows).collect()}
    assert got == dict(enumerate(REPLIES.values()))
    nested = archive.parse_replies(rows.where("k = 3")).first()
    assert json.loads(nested.justification) == {"a": {"b": 1}}


def test_replies_are_read_once_whatever_filters_follow(spark):
    """Five readings in all, each behind the failure of those before it; a filter by the status reads none again."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(REPLIES)], "k int, raw string").where("k >= 0").repartition(2)
    kept = archive.parse_replies(rows).where("parse_status <> 'failed'")
    said = kept._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len(re.findall("from_json|jsontostructs", said)) == 5
    assert kept.count() == sum(v[0] != "failed" for v in REPLIES.values())


def test_objects_without_inner_braces(spark):
    texts = ['{"a": "b}', '{"a"}', "{}", '{"a"} ', '{"a\n"}\n', '{"}"}', '{"a": "{"}', '"{}"', "{", '{"a": 1}}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(archive.leading_object(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == ['{"a": "b}', '{"a"}', "{}", '{"a"}', '{"a\n"}', '{"}"}', '{"a": "{"}', None, None, '{"a": 1}']
