"""Small files kept in packs are read as loose ones are."""

import json
import re

import pytest

from marksmith.plans import file_queries
from marksmith.plans.queries import QUERIES
from marksmith.sources import files

SF = "/root/testdata/sf0.001"


def both(spark, folder, held: dict[str, bytes]):
    """Paths of the same files, loose and in packs."""
    loose, packs = folder / "loose", folder / "packs"
    for name, content in held.items():
        (loose / name).parent.mkdir(parents=True, exist_ok=True)
        (loose / name).write_bytes(content)
    files.write_packs(spark.createDataFrame([(n, bytearray(c)) for n, c in held.items()], "file string, content binary"), str(packs))
    return str(loose), str(packs)


def test_packed_manifest_is_that_of_loose_files(spark, tmp_path):
    loose, packs = both(spark, tmp_path, {"a/x.PDF": b"\xff\x00\n", "a/evidence/p.txt": "ä\n".encode(), "b/y": b"y", "stray": b"s"})
    want, got = (sorted(files.run_manifest(files.file_manifest(spark, p, packed=p == packs), p).collect()) for p in (loose, packs))
    assert got == want and [(r.run_id, r.n_files, r.bytes, r.has_pdf, r.has_evidence) for r in got] == [("a", 2, 6, True, True), ("b", 1, 1, False, False)]


def test_packed_keys_are_those_of_loose_files(spark, tmp_path):
    wrapped = {"metadata": {}, "questions": {"Q1": {"question": "wörd", "answer": "x", "marks": 2}, "_instructions_": {}}}
    loose, packs = both(spark, tmp_path, {"e=1/a.json": json.dumps(wrapped, ensure_ascii=False).encode(), "e=2/b.json": b'{"Q2": {"answer": "y"}}', "e=3/c.json": b"no json"})
    for read in (files.read_keys, files.read_papers):
        want, got = ({(re.search("e=.*", r.file)[0], *r[1:]) for r in read(spark, p, packed=p == packs).collect()} for p in (loose, packs))
        assert got == want and len(got) == 2


@pytest.mark.parametrize("name", ["a1_read_keys", "a2_read_papers", "a13_run_manifest"])
def test_files_do_not_grow_with_exams_and_runs(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(file_queries, "scratch", lambda _, kind: f"file://{tmp_path}/{kind}")
    rows = QUERIES[name](spark, SF).collect()
    kept = [p for p in tmp_path.rglob("*") if p.is_file() and p.name.startswith("part-")]
    assert 0 < len(kept) <= 8 and len({r[0] for r in rows}) > len(kept)


def test_a_run_without_id_has_its_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(file_queries, "scratch", lambda _, kind: f"file://{tmp_path}/{kind}")
    timing = spark.createDataFrame([(None, "s", 2), (None, "s", 1), (7, "t", 3)], "run_id long, stage string, event_id long")
    assert {(r.run_id, r.bytes) for r in file_queries.a13(timing).collect()} == {(None, 8), (7, 4)}
