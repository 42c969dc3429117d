"""Answers in other questions' slots: literal cases, and plain versions on random sheets."""

import random
import re

import pytest

from marksmith.operators import recovery, splits

ENTRY = "sheet_id long, exam_id long, qid string, base int, pos int, answer string, recovered_from string"


def entries(spark, rows):
    """rows: (sheet, qid, answer) or (sheet, qid, answer, recovered_from)."""
    base = lambda qid: int(m[1]) if (m := re.search(r"([0-9]+)", qid)) else None
    return spark.createDataFrame([(r[0], 1, r[1], base(r[1]), k, r[2], r[3] if len(r) > 3 else None) for k, r in enumerate(rows)], ENTRY)


def question_set(spark, numbers):
    return spark.createDataFrame([(1, n) for n in numbers], "exam_id long, base int")


LINES = {
    "37.": 37, "Q.37": 37, "(Ques 32) text": 32, "Ans 37)": 37, "Q No 17": 17, "Q.No.17: x": 17, "QNo 17": 17, "Question Number 8 y": 8, "A1. x": 1, "a 4) z": 4, "37. (vi) x": 37, "9) b": 9, "12: 3 of": 12, "007.": 7,
    "A11 = -2": None, "Q1 = 3": None, "30 cm": None, "12.5.2024": None, "Q 12.5.2024": None, "plain": None, "Q300x": None, "(37)": None, "- 5.": None, "37. word": None, "Q..4": None, "QNo,17": None, "": None,
}


def test_header_lines(spark):
    read = {r.line: r.number for r in splits.read_lines(spark.createDataFrame([(x,) for x in LINES], "line string")).collect()}
    assert {x: read.get(x) for x in LINES} == LINES == {x: splits.Line(x).opens for x in LINES}


def test_lines_are_read_alike_on_columns_and_texts(spark):
    rng = random.Random(8)
    parts = ["Q", "Ans", "a", "A", "No", "number", "1", "37", "007", "12", "2024", ".", ")", ":", "-", "=", "(", "[", "/", "_", " ", "  ", "x", "ii", "\t", "é"]
    lines = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(6000)})
    read = {r.line: (r.number, r.bare) for r in splits.read_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert {x: read.get(x, (None, False)) for x in lines} == {x: (splits.Line(x).opens, bool(splits.Line(x).bare)) for x in lines}
    assert len(read) > 100


def test_long_lines_are_read_in_time(spark):
    lines = ["x" * 200_000, "Q" * 200_000 + "1", "1" * 100_000 + ".", " " * 100_000 + "7."]
    assert {r.number for r in splits.read_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()} == {7}


def lifted(spark, rows, gaps):
    table = spark.createDataFrame([(7, n) for n in gaps], "sheet_id long, base int")
    return sorted((r.qid, r.answer, r.recovered_from) for r in splits.recover_gaps(entries(spark, rows), table).collect())


def test_gaps_are_recovered_by_their_own_number(spark):
    other = "30 cm\nQ1 = 4 C\n12.5.2024\nA11 = -2"
    got = lifted(spark, [(7, "Q15", "host text\nQ.17 (D) 43\nmore\nAns 18) deep"), (7, "Q20", other)], (17, 18, 1, 12, 11, 30))
    assert got == [("Q15", "host text", None), ("Q17", "(D) 43\nmore", "Q15"), ("Q18", "deep", "Q17"), ("Q20", other, None)]


def test_no_entry_of_a_sheet_is_lost(spark):
    rows = [(7, "Q1(a)", "part a text"), (7, "Q1(b)", "part b text\nQ.4 buried text"), (7, "_unassigned_", "words\n(Ques 6) loose\n7.\nrest"), (7, "Q4", " "), (7, "Q5(a)", " "), (7, "Q9", None)]
    assert lifted(spark, rows, (4, 5, 6)) == [
        ("Q1(a)", "part a text", None), ("Q1(b)", "part b text", None), ("Q4", "buried text", "Q1(b)"), ("Q5(a)", " ", None), ("Q6", "loose", "_unassigned_"), ("Q9", None, None), ("_unassigned_", "words\n7.\nrest", None),
    ]
    assert lifted(spark, [(7, "Q1", "Q.4 all of it")], (4,)) == [("Q1", "Q.4 all of it", None)]  # a host keeps some text
    assert lifted(spark, [(7, "Q1", "own\nQ4 9. (a) two labels")], (4, 9)) == [("Q1", "own", None), ("Q4", "9. (a) two labels", "Q1")]  # nothing would stay with Q4


def plain_recovery(rows, gaps):
    natural = lambda q: [int(x) if x.isdigit() else x.lower() for x in re.split("([0-9]+)", q)]
    held = {q: [t or "", None] for q, t in rows}
    base = lambda q: int(m[0]) if (m := re.search("[0-9]+", q)) else None
    for n in sorted(gaps):
        for host in sorted(held, key=lambda q: [(0, x) if isinstance(x, int) else (1, x) for x in natural(q)]):
            text = held[host][0]
            if base(host) == n or not text.strip():
                continue
            lines = text.split("\n")
            at = next((k for k, x in enumerate(lines) if splits.Line(x).opens == n), None)
            if at is None:
                continue
            end = next((k for k in range(at + 1, len(lines)) if splits.Line(lines[k]).bare), len(lines))
            own = "\n".join([splits.Line(lines[at]).without_label(), *lines[at + 1 : end]]).strip()
            rest = "\n".join(lines[:at] + lines[end:]).strip()
            if own and rest:
                held[host][0], held[f"Q{n}"] = rest, [own, host]
                break
    return {q: (t.strip() if t.strip() else None, s) for q, (t, s) in held.items()}


def test_recovery_equals_a_plain_walk(spark):
    rng = random.Random(12)
    pieces = ["text", "Q.{n} buried", "{n}.", "Ans {n}) more", "", "  ", "{n}. (a) part", "Q{n} {m}. (b) two", "[DIAGRAM: x]", "A{n}. y"]
    rows, gaps, plain = [], [], {}
    for sheet in range(150):
        ids = rng.sample(["Q1", "Q1(a)", "Q1(b)", "Q2", "Q3.i", "Q10", "_unassigned_", "Q4"], rng.randint(1, 6))
        own = [(q, "\n".join(rng.choice(pieces).format(n=rng.randint(1, 9), m=rng.randint(1, 9)) for _ in range(rng.randint(0, 9)))) for q in ids]
        filled = {int(m[0]) for q, t in own if t.strip() and (m := re.search("[0-9]+", q))}
        missing = [n for n in range(1, 10) if n not in filled and rng.random() < 0.8]
        rows += [(sheet, q, t) for q, t in own]
        gaps += [(sheet, n) for n in missing]
        plain[sheet] = (plain_recovery(own, missing), any(s for _, s in plain_recovery(own, missing).values()))
    got: dict = {}
    for r in splits.recover_gaps(entries(spark, rows), spark.createDataFrame(gaps, "sheet_id long, base int")).collect():
        assert r.qid not in got.setdefault(r.sheet_id, {})
        got[r.sheet_id][r.qid] = ((r.answer or "").strip() or None, r.recovered_from)
    assert sum(moved for _, moved in plain.values()) > 40
    for sheet, (want, moved) in plain.items():
        if moved or sheet in got:
            assert got[sheet] == want, sheet


def split(spark, rows, numbers):
    return {(r.host, r.qid): r.answer for r in splits.split_objective_lists(entries(spark, [(7, *r) for r in rows]), question_set(spark, numbers)).collect()}


RUN = "A15. (d) x\nQ.16 (C) y\n17 (b)\nmore\n[DIAGRAM: d]\n18) in the tail"


def test_lists_of_options_are_split(spark):
    tail = "[DIAGRAM: d]\n18) in the tail"
    assert split(spark, [("Q15", RUN)], [15, 16, 17]) == {("Q15", "Q15"): "(d) x", ("Q15", "Q16"): "(C) y", ("Q15", "Q17"): "(b)\nmore\n" + tail}
    assert split(spark, [("Q3", RUN)], [15, 16, 17])[("Q3", "Q3")] == tail
    assert split(spark, [("Q3", RUN)], [15, 16]) == {}  # one isn't a multiple choice question
    assert split(spark, [("Q3", RUN), ("Q16", "own")], [15, 16, 17]) == {}  # one has an answer of its own
    assert split(spark, [("Q3", "1. long prose without any option in it\n2. more\n3. end")], [1, 2, 3]) == {}
    assert split(spark, [("_unassigned_", RUN)], [15, 16, 17])[("_unassigned_", "_unassigned_")] == tail


def test_slots_that_came_from_the_host_do_not_stop_its_split(spark):
    rows = [("Q15", RUN), ("Q16", "(C) y", "Q15")]
    assert ("Q15", "Q16") in split(spark, rows, [15, 16, 17])
    assert split(spark, [("Q15", RUN), ("Q16", "(C) y", "Q14")], [15, 16, 17]) == {}
    assert split(spark, [("Q15", RUN), ("Q16(a)", "a sub-part isn't the slot")], [15, 16, 17]) != {}


def test_hosts_are_split_in_order(spark):
    both = [("Q9", "1) a\n2) b\n3) c"), ("Q8", "2) a\n3) b\n4) c"), ("Q7", "9) a\n10) b\n11) c")]
    got = split(spark, both, [1, 2, 3, 4, 9, 10, 11])
    assert {h for h, _ in got} == {"Q9", "Q7"}  # Q8's slots are Q9's by then; Q9 is empty by then, so its slot is free
    assert got[("Q7", "Q9")] == "a" and got[("Q9", "Q9")] == ""


def test_swallowed_beginnings_go_back(spark):
    texts = {"Q34": "(a) own", "Q34(z)": "not the first", "Q35": "(iii) late part\nof it\n(a) mine", "Q36": "(a) fine\n(b) too", "Q40": "(b) no one before\n(a) mine", "_x_": "(b) y\n(a) z"}
    rows = splits.reattach_continuation(entries(spark, [(7, q, t) for q, t in texts.items()]), question_set(spark, [34, 35, 36, 40])).collect()
    want = {q: (t, False) for q, t in texts.items()} | {"Q34": ("(a) own\n(iii) late part\nof it", True), "Q35": ("(a) mine", True)}
    assert {r.qid: (r.answer, r.moved) for r in rows} == want


def plain_rounds(answers, known, mixed, expected, replies, most, attempts):
    """One sheet: hosts ranked anew in every round, and asked about what is left."""
    words = lambda t: set(re.findall("[a-z0-9_]+", t.lower()))
    fit = lambda t, n: len(words(t) & words(expected.get(n, ""))) / len(words(expected[n])) if words(expected.get(n, "")) else 0.0
    held = {n: t for n, t in answers.items() if t.strip()}
    blanks = {n for n in known if n not in held}
    filled, probes, asked, times = [], [], {}, {}
    while blanks and len(probes) < most:
        hosts = sorted({n for n in mixed if n in known and n in held} | {n for b in blanks for n in (b - 1, b + 1) if n in known and n not in blanks and n in held})
        off = []
        for n in sorted(known):
            if n in held and n not in blanks:
                best = max((fit(held[n], b) for b in blanks if b in expected), default=0.0)
                if best >= 0.5 and best - fit(held[n], n) >= 0.25:
                    off.append((-(best - fit(held[n], n)), n))
        hosts += [n for _, n in sorted(off) if n not in hosts]
        moved = False
        for n in hosts * attempts:
            if not blanks or len(probes) >= most or not blanks - {n}:
                continue
            key = (n, tuple(sorted(blanks)))
            if asked.get(key, 0) >= attempts:
                continue
            asked[key] = asked.get(key, 0) + 1
            times[n] = times.get(n, 0) + 1
            probes.append((len(probes) + 1, n, ",".join(map(str, sorted(blanks))), times[n]))
            target, text = replies.get((n, times[n]), (None, ""))
            if text.strip() and target in blanks and target != n:
                held[target] = text.strip()
                blanks.discard(target)
                filled.append((target, text.strip(), n, len(probes)))
                moved = True
        if not moved:
            break
    return sorted(filled), probes


@pytest.mark.parametrize("most, attempts", [(24, 2), (5, 1)])
def test_matcher_rounds_equal_a_plain_loop(spark, most, attempts):
    rng = random.Random(most)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(2, 6)))
    known, expected = list(range(1, 9)), {n: text() for n in range(1, 9) if n != 4}
    answer, mixed, reply, want = [], [], [], {}
    for sheet in range(60):
        own = {n: (text() if rng.random() < 0.5 else " ") for n in known if rng.random() < 0.9} or {1: "x"}
        flags = [n for n in known if rng.random() < 0.1]
        said = {(h, k): (rng.randint(1, 9), text() if rng.random() < 0.8 else " ") for h in known for k in range(1, 5) if rng.random() < 0.7}
        answer += [(sheet, 1, n, t) for n, t in own.items()]
        mixed += [(sheet, n) for n in flags]
        reply += [(sheet, h, k, target, t) for (h, k), (target, t) in said.items()]
        want[sheet] = plain_rounds(own, known, flags, expected, said, most, attempts)
    filled, probes = splits.repair_glued(
        spark.createDataFrame(answer, "sheet_id long, exam_id long, base int, answer string"), question_set(spark, known), spark.createDataFrame(mixed, "sheet_id long, base int"),
        spark.createDataFrame([(1, n, t) for n, t in expected.items()], "exam_id long, base int, expected string"), spark.createDataFrame(reply, "sheet_id long, host int, ask_no int, target int, text string"), most, attempts,
    )
    got: dict = {sheet: ([], []) for sheet in want}
    for r in filled.collect():
        got[r.sheet_id][0].append((r.base, r.answer, r.recovered_from, r.probe))
    for r in probes.orderBy("probe_no").collect():
        got[r.sheet_id][1].append((r.probe_no, r.host, r.gaps, r.ask_no))
    assert {s: (sorted(f), p) for s, (f, p) in got.items()} == want
    assert sum(len(f) for f, _ in want.values()) > 30


def test_flags_of_layers_are_joined(spark):
    notes = spark.createDataFrame([(1, 2, "mixed", 1, None), (1, 2, "recovered", 2, "second"), (1, 2, "recovered", 1, "first"), (1, 2, "symbol", 1, ""), (1, 2, "symbol", 3, "minus"), (1, None, "mixed", 1, None), (1, 5, "mixed", 2, "x")], "sheet_id long, base int, kind string, layer int, note string")
    rows = {r.base: (r.mixed, r.reason, r.symbol) for r in recovery.merge_side_flags(notes).collect()}
    assert rows == {2: (True, "first", "minus"), 5: (True, None, None)}
