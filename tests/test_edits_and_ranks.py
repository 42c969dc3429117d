"""Edit logs against a plain replay, and exact quantiles."""

import random
import statistics

from marksmith.operators import keyedits, pages, reports

LOG = "exam_id long, seq long, action string, label string, marks string, answer string, groups array<array<string>>"


def plain_replay(key, groups, log):
    held, now_groups, edited, source = dict(key), groups, False, None
    for seq in sorted({e[0] for e in log}):
        event = [e for e in log if e[0] == seq]
        if any(e[1] == "reset" for e in event):
            held, now_groups, edited, source = dict(key), groups, False, None
        for action in ("remove", "marks", "add", "groups", "source"):
            for _, kind, label, marks, answer, chosen in [e for e in event if e[1] == action]:
                number = None if marks in (None, "x") else float(marks)
                if kind == "remove":
                    held.pop(label, None)
                elif kind == "marks" and label in held and number is not None:
                    held[label] = (number, *held[label][1:])
                elif kind == "add":
                    held[f"Q{int(label.split()[-1])}"] = (number or 0.0, (answer or "").strip(), True)
                elif kind == "groups":
                    now_groups = chosen
                elif kind == "source":
                    source = label
                edited = edited or kind != "source"
    return held, now_groups, source, edited


def test_edit_logs_equal_a_plain_replay(spark):
    rng, keys, logs, groups = random.Random(9), {}, {}, {}
    for exam in range(60):
        keys[exam] = {f"Q{n}": (1.0, f"a{n}", False) for n in range(1, 6)}
        groups[exam] = [["Q1(a)", "Q1(b)"]] if rng.random() < 0.5 else []
        logs[exam] = []
        for seq in range(rng.randint(0, 8)):
            kind = rng.choice(["remove", "marks", "add", "groups", "reset", "source"] if rng.random() < 0.5 else ["remove", "marks", "add"])
            if kind in ("remove", "marks"):
                logs[exam].append((seq, kind, f"Q{rng.randint(1, 7)}", rng.choice(["2.5", "x", "0.5"]), None, None))
            elif kind == "add":
                logs[exam].append((seq, kind, f"ques {rng.randint(1, 8)}", rng.choice(["2", "x", None]), rng.choice([" y ", "", None]), None))
            elif kind == "groups":
                logs[exam].append((seq, kind, None, None, None, [["Q2(a)(i)", "Q2(a)(ii)", "Q2(b)"], ["Q3(a)", "Q3(b)"]][: rng.randint(0, 2)]))
            else:
                logs[exam].append((seq, kind, rng.choice(["paper", "key"]), None, None, None))
    key = spark.createDataFrame([(e, q, m, a) for e, k in keys.items() for q, (m, a, _) in k.items()], "exam_id long, qid string, marks double, answer string")
    parsed = spark.createDataFrame([(e, k, "Q1", g) for e, gs in groups.items() for k, g in enumerate(gs)], "exam_id long, group_no int, parent string, members array<string>")
    edits = spark.createDataFrame([(e, *x) for e, log in logs.items() for x in log], LOG)
    new_key, new_groups = keyedits.replay_edits(key, parsed, edits)
    got: dict = {e: {} for e in keys}
    for r in new_key.collect():
        got[r.exam_id][r.qid] = (r.marks, r.answer, r.teacher_added)
        assert r.key_parse_missing == (r.teacher_added and r.answer == "")
    listed: dict = {e: [] for e in keys}
    for r in new_groups.orderBy("group_no").collect():
        listed[r.exam_id].append(r.members)
    choices = {r.exam_id: (r.source, r.edited) for r in keyedits.marks_choice(edits).collect()}
    collapsed = {("Q2(a)(i)", "Q2(a)(ii)", "Q2(b)"): ["Q2(a)", "Q2(b)"]}
    for exam in keys:
        held, now_groups, source, edited = plain_replay(keys[exam], groups[exam], logs[exam])
        assert got[exam] == held, (exam, logs[exam])
        assert listed[exam] == [collapsed.get(tuple(g), g) for g in now_groups]
        assert choices.get(exam, (None, False)) == (source, edited), exam


def test_exact_quantiles(spark):
    rng = random.Random(3)
    for values in ([], [1.0], [2.0, 1.0], [5.0] * 9 + [1.0], [rng.randint(0, 40) / 4 for _ in range(1001)], [rng.random() for _ in range(500)] + [None]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None]
        got = reports.exact_quantile(frame, "v", 0.5).first().value
        assert got == (statistics.median(known) if known else None)
    assert reports.exact_quantile(spark.range(11).selectExpr("CAST(id AS DOUBLE) AS v"), "v", 0.25).first().value == 2.5


def test_evidence_meets_the_key_once(spark):
    """Files go to the parent only where the key lacks the sub-part; a file counts at its first known page."""
    crop = spark.createDataFrame(
        [(1, "Q1.a", 3, "f"), (1, "Q1", 1, "g"), (1, "Q1.a", 2, "f"), (1, "Q1.a", None, "f"), (1, "Q2.a", 5, "h"), (1, "Q2", 4, "i"), (1, "Q3.a", 1, "j"), (1, "Q1", 9, ""), (2, "Q1.a", 1, "k"), (2, "Q4", None, "l"), (2, None, 1, "m")],
        "sheet_id long, qid string, page_no int, file string",
    )
    key = spark.createDataFrame([(1, "Q1"), (1, "Q2"), (1, "Q2.a"), (1, "Q3.b"), (2, "Q2"), (2, None)], "sheet_id long, qid string")
    found = pages.evidence_by_id(crop, key)
    assert {(r.sheet_id, r.qid): r.files for r in found.collect()} == {(1, "Q1"): "g,f", (1, "Q2.a"): "h", (1, "Q2"): "i", (1, "Q3.a"): "j", (2, "Q1.a"): "k", (2, "Q4"): "l", (2, None): "m"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
