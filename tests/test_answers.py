"""Answers from pages, recovery and merges: literal cases and plain versions on small tables."""

import re

import pytest

from marksmith.operators import assembly, grading, integrity, keyedits, merges, notes, orientation, recovery, regions
from marksmith.plans.fixtures import fixture
from marksmith.plans.recovery_queries import _scores
from marksmith.sources import archive

SF = "/root/testdata/sf0.001"


def question_set(spark, numbers):
    return spark.createDataFrame([(1, n) for n in numbers], "exam_id long, base int")


def assembled(spark, pages, numbers):
    reading = spark.createDataFrame([(7, 1, k, t) for k, t in enumerate(pages)], "sheet_id long, exam_id long, page_no int, text string")
    placed = assembly.place_chunks(reading, question_set(spark, numbers) if numbers else question_set(spark, [1]).limit(0))
    answers = {r.qid: (r.answer, r.is_bad_handwriting) for r in assembly.assembled_answers(placed).collect()}
    return answers, {(r.page_no, r.qid) for r in assembly.page_questions(placed).collect()}, {r.base for r in assembly.collisions(placed).collect()}


def test_continuations_and_misread_numbers(spark):
    pages = ["cover", "[START_Q: 1] one", "more of one", "[START_Q: 2] two [START_Q: ii] still two", "[START_Q: 11]also two"]
    answers, where, odd = assembled(spark, pages, [1, 2, 3])
    assert answers == {"_unassigned_": ("cover", False), "Q1": ("one\nmore of one", False), "Q2": ("two\nstill two\nalso two", False)} and not odd
    assert where == {(0, "_unassigned_"), (1, "Q1"), (2, "Q1"), (3, "Q2"), (4, "Q2")}


def test_a_number_one_digit_off_opens_its_question(spark):
    answers, _, odd = assembled(spark, ["[START_Q: 35] a", "[START_Q: 86] b", "[START_Q: 37] c"], [35, 36, 37])
    assert {k: v[0] for k, v in answers.items()} == {"Q35": "a", "Q36": "b", "Q37": "c"} and odd == {36}


def test_backward_duplicates_stay_and_late_answers_open(spark):
    answers, _, odd = assembled(spark, ["[START_Q: 1] a [START_Q: 3] c", "[START_Q: 1] not one [START_Q: 2] late [BAD_HANDWRITING]", "[START_Q: 3] again"], [1, 2, 3])
    assert answers == {"Q1": ("a", False), "Q3": ("c\nnot one\nagain", False), "Q2": ("late", True)} and odd == {3}


def test_without_a_set_large_numbers_are_misread(spark):
    answers, _, _ = assembled(spark, ["[START_Q: 4] a", "[START_Q: 111] b", "SECTION A\n[INSTRUCTION]: x\n[BLANK PAGE]"], None)
    assert answers == {"Q4": ("a\nb", False)}


def plain_assembly(pages, known):
    """The same walk on the texts themselves, one page after the other."""
    from marksmith.functions.labels import LABEL_WORDS

    word = re.compile(rf"(?i)^\s*(?:{'|'.join(sorted(LABEL_WORDS, key=len, reverse=True))})\s*[.:-]?\s*(?=[0-9])")
    held, active, top, odd = {}, None, None, set()

    def add(qid, text):
        text = text.replace("[BAD_HANDWRITING]", "")
        text = re.sub(r"\[END_Q:[^\]]*\]|(?i:\[BLANK[ _]PAGE\])", "", text)
        text = "\n".join(x for x in text.split("\n") if not re.match(r"(?i)\s*section\s*[-–—]?\s*[a-e]\s*$|\s*\[instruction\]\s*:", x)).strip(" \t\r\n")
        if text or qid in held:
            held.setdefault(qid, []).extend([text] if text else [])

    for text in pages:
        parts = re.split(r"\[START_Q:[ \t]*([^\]\n]*)\]", text)
        if parts[0].strip():
            add(active or assembly.HOLDER, parts[0])
        for tag, chunk in zip(parts[1::2], parts[2::2]):
            tag = re.sub(r"(?i)\s*\(?(?:contd\.?|continued|part\s*[0-9]*|pg\s*[0-9]*)\)?\s*", "", tag).strip().rstrip("-.")
            bare = word.sub("", re.sub("^[^_]*_", "", tag).strip())
            m = re.match(r"\s*0*([0-9]+)(.*)$", bare, re.S)
            n, sub = (int(m[1]), m[2].strip() if re.search("[A-Za-z0-9]", m[2]) else "") if m else (None, "")
            own = f"Q{n}{sub}" if m else f"Q{tag}"
            back = n is not None and top is not None and n < top
            bad = n is None or (back and (own in held or bool(sub)))
            if n is not None and n not in known:
                opened = {int(re.match(r"Q([0-9]+)", k)[1]) for k in held if re.match(r"Q[0-9]", k)}
                near = [y for y in known if y not in opened and (top is None or y > top) and len(str(y)) == len(str(n)) and sum(a != b for a, b in zip(str(y), str(n))) == 1]
                bad = bad or len(near) != 1
                if not bad:
                    n = near[0]
                    own = f"Q{n}{sub}"
                    odd.add(n)
            if bad:
                add(active or own, chunk)
                continue
            if own in held and active is not None and active != own:
                odd.add(n)
            add(own, chunk)
            active, top = own, n if top is None else max(top, n)
    return {k: "\n".join(v) for k, v in held.items()}, odd


def test_assembly_equals_the_plain_walk(spark):
    reading = fixture(spark, SF, "page_scan")
    known = recovery.question_set(integrity.canonical_key(fixture(spark, SF, "key_entry")), fixture(spark, SF, "paper_entry"))
    placed = assembly.place_chunks(reading, known)
    got, odd = {}, {}
    for r in assembly.assembled_answers(placed).collect():
        got.setdefault(r.sheet_id, {})[r.qid] = r.answer
    for r in assembly.collisions(placed).collect():
        odd.setdefault(r.sheet_id, set()).add(r.base)
    sets, pages = {}, {}
    for r in known.collect():
        sets.setdefault(r.exam_id, set()).add(r.base)
    for r in sorted(reading.collect(), key=lambda r: (r.sheet_id, r.page_no)):
        pages.setdefault((r.sheet_id, r.exam_id), []).append(r.text)
    assert len(pages) > 5
    for (sheet, exam), texts in pages.items():
        want, marked = plain_assembly(texts, sets[exam])
        assert (got.get(sheet, {}), odd.get(sheet, set())) == (want, marked), sheet


def test_fragments(spark):
    assert assembly.merged_text("alpha beta", "alpha  beta") in ("alpha beta", "alpha  beta") and assembly.merged_text("", "x") == "x"
    assert assembly.merged_text("begin-a-shared-run-of-words", "a-shared-run-of-words-end") == "begin-a-shared-run-of-words-end"
    assert assembly.merged_text("one row", "another thing altogether") == "one row\nanother thing altogether"


def test_options_and_verdicts(spark):
    cases = [
        ("(b) mitochondria", "(a) mitochondria", "right"), ("(8) (c) QR:QP", "c", "right"), ("Q2. (A) 2x1", "A – two by one", "right"), ("(a)", "(b)", "wrong"), ("(a) and (b)", "(a)", "defer"), ("so the answer is (c)", "(c)", "defer"),
        ("(c) x", "a long text", "defer"), ("D / 1: 8", "(d) 1: 8", "defer"), ("D) 1: 8", "D / 1: 8", "right"), ("(a) oxygen rich blood", "(b) oxygen rich blod", "wrong"), ("(a) oxygen rich blood", "oxygen rich blod", "right"), ("", "(a)", "defer"),
    ]
    rows = spark.createDataFrame([(k, a, b, 1.0) for k, (a, b, _) in enumerate(cases)], "k int, answer string, key_answer string, marks double")
    assert [r.verdict for r in grading.grade_mcq(rows).orderBy("k").collect()] == [v for *_, v in cases]


def test_best_of_n_needs_all_parts(spark):
    parts = [(1, 21, k, "t", m, 2.0, False, "") for k, m in enumerate((1.0, 2.0, 1.0))] + [(1, 22, k, "[BLANK]", 0.0, 1.0, True, "No answer captured") for k in range(2)]
    result = spark.createDataFrame(parts, "sheet_id long, base int, qorder int, answer string, marks_awarded double, marks_max double, needs_review boolean, capture_status string")
    told = spark.createDataFrame([(1, 0, "Q21. Answer any 2 out of the given 3"), (1, 1, "Q22 answer any 1 out of 3"), (1, 2, "write well")], "sheet_id long, pos int, text string")
    rows = {(r.base, r.qorder): r for r in grading.best_of_n(result, grading.choice_rules(told)).collect()}
    assert [(rows[21, k].marks_awarded, rows[21, k].marks_max) for k in range(3)] == [(1.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    assert all(rows[22, k].needs_review and "Expected 3 parts, found 2" in rows[22, k].optional_status for k in range(2))


def test_marks_mismatch_sees_differences_that_cancel(spark):
    key = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "exam_id int, base int, marks double")
    paper = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0)], "exam_id int, base int, marks double")
    row = integrity.marks_mismatch(integrity.cross_check(key, paper)).first()
    assert (row.mismatch, row.key_total, row.paper_total, row.questions, row.recommended) == (True, 5.0, 5.0, "Q1,Q2", "question_paper")


def test_gaps_of_a_misread_number_are_one_range(spark):
    paper = spark.createDataFrame([(1, "Q3"), (1, "Q5"), (1, "Q999999999")], "exam_id int, qid string")
    assert {(r.kind, r.lo, r.hi) for r in integrity.numbering_gaps(paper).collect()} == {("leading", 1, 2), ("internal", 4, 4), ("internal", 6, 999999998)}


def test_collapsed_members(spark):
    cases = {1: (["Q32(A)(I)", "Q32(A)(II)", "Q32(B)(I)"], ["Q32(A)", "Q32(B)"]), 2: (["Q34(IV)(A)", "Q34(IV)(B)"], ["Q34(IV)(A)", "Q34(IV)(B)"]), 3: (["x", "Q1(a)"], ["x", "Q1(a)"]), 4: (["Q9(a)"], ["Q9(a)"])}
    rows = keyedits.collapse_members(spark.createDataFrame([(1, k, m) for k, (m, _) in cases.items()], "exam_id int, group_no int, members array<string>")).collect()
    assert {r.group_no: r.members for r in rows} == {k: v for k, (_, v) in cases.items()}


def test_choices_count_their_best_alternative(spark):
    key = [(1, f"Q31{s}", 31, s, m, f"ans{s}") for s, m in (("(A)(i)", 1.0), ("(A)(ii)", 2.0), ("(B)", 4.0), ("(C)", 1.0))]
    members = spark.createDataFrame([(1, 31, 0, "Q31(A)"), (1, 31, 1, "Q31(B)")], "exam_id int, base int, pos int, member string")
    row = merges.merge_choices(spark.createDataFrame(key, "exam_id int, qid string, base int, sub string, marks double, answer string"), members).first()
    assert (row.qid, row.marks, row.choice_shared, row.choice_marks_unequal) == ("Q31", 5.0, "(C) ans(C)", True)
    assert row.answer == "(C) ans(C)\n(A)(i) ans(A)(i) (A)(ii) ans(A)(ii)\nOR\n(B) ans(B)" and [a.label for a in row.choice_alternatives] == ["A", "B"]


def test_anchors(spark):
    rows = [(1, 1, ["a", "b"], ["10", "500"]), (1, 2, ["a", "b"], ["560", "560"]), (1, 3, ["a", "b", "c"], ["10", "8" + "0" * 30, "600"]), (1, 4, ["a", "b"], ["215", "45"]), (1, 5, ["a"], ["x"])]
    got = regions.anchors(spark.createDataFrame(rows, "sheet_id long, page_no int, wanted array<string>, ys array<string>")).collect()
    by_page = {}
    for r in sorted(got, key=lambda r: (r.page_no, r.pos)):
        by_page.setdefault(r.page_no, []).append((r.y, r.exact))
    assert by_page == {1: [(10, True), (500, True)], 2: [(None, False)] * 2, 3: [(10, False), (None, False), (600, False)], 4: [(None, False)] * 2, 5: [(None, False)]}


def test_bands_hug_the_ink(spark):
    profile = [0] * 100 + [50] * 100 + [0] * 100 + [50] * 200
    ink = spark.createDataFrame([(1, 1, profile, 2)], "sheet_id long, page_no int, profile array<int>, eps int")
    band = spark.createDataFrame([(1, 1, "Q1", 90, 210), (1, 1, "Q2", 210, 500)], "sheet_id long, page_no int, qid string, top int, bottom int")
    fitted = regions.fit_bands(band, ink)
    assert {(r.qid, r.top, r.bottom) for r in fitted.collect()} == {("Q1", 92, 208), ("Q2", 292, 500)}
    role = spark.createDataFrame([(1, 1, q) for q in ("Q1", "Q2", "Q3")], "sheet_id long, page_no int, qid string")
    assert {(r.qid, r.method, r.reason) for r in regions.accept_bands(fitted, ink, role).collect()} == {("Q1", "band", ""), ("Q2", "band", ""), ("Q3", "page", "not placed")}


def plain_vote(scores):
    """{rotation: [(in_set, out_of_set)] of all pages}; page order is the same in each."""
    flagged = [k for k, (_, out) in enumerate(scores[0]) if out]
    before = sum(out for _, out in scores[0])
    total = lambda r: sum(scores[r][k][0] - scores[r][k][1] for k in flagged)
    if before < 2:
        return 0
    best, chosen = total(0), 0
    for r in (180, 90, 270):
        if total(r) > best:
            best, chosen = total(r), r
        if not sum(scores[r][k][1] for k in flagged) and total(r) > 0:
            chosen = r
            break
    return chosen if chosen and sum(out for _, out in scores[chosen]) < before else 0


def test_votes_and_probes_equal_plain_ones(spark):
    score = _scores(*[fixture(spark, SF, t) for t in ("page_turned", "key_entry", "paper_entry", "benchmark")]).cache()
    rows = score.collect()
    by_sheet = {}
    for r in sorted(rows, key=lambda r: r.page_no):
        by_sheet.setdefault(r.sheet_id, {}).setdefault(r.rotation, []).append((r.in_set, r.out_of_set))
    want = {s: v for s, x in by_sheet.items() if (v := plain_vote(x))}
    assert {r.sheet_id: r.rotation for r in orientation.rotation_vote(score).collect()} == want and want
    wide = fixture(spark, SF, "page_turned").where("wide").select("sheet_id", "page_no").distinct()
    landscape, pages = {tuple(r) for r in wide.collect()}, {}
    for r in rows:
        pages.setdefault((r.sheet_id, r.page_no), {})[r.rotation] = r
    expected = {}
    for page, by in pages.items():
        now = by[0]
        reason = "out-of-set" if now.out_of_set else "landscape" if page in landscape else None
        turns = [] if not reason else [90, 270] if reason == "landscape" else [180, 270, 90]
        best = None
        for t in turns:
            r = by[t]
            clearer = r.legibility > now.legibility and r.legibility >= now.legibility * 1.15
            if r.legibility > 0 and r.out_of_set <= now.out_of_set and (r.in_set > now.in_set or clearer) and (best is None or r.legibility > best.legibility):
                best = r
        if best:
            expected[page] = (best.rotation, "rotated", reason)
        elif now.out_of_set:
            expected[page] = (0, "uncertain", reason)
    assert {(r.sheet_id, r.page_no): (r.rotation, r.action, r.reason) for r in orientation.rotation_probe(score, wide).collect()} == expected


def test_replies_of_all_kinds(spark):
    raw = ['{"Marks Awarded": 2, "Justification": "x"}', 'text {"Marks Awarded": 1, "Feedback": "\\alpha"} more', '{"Marks Awarded": 0.5, "Justification": "cut', "", None, "[]"]
    rows = archive.parse_replies(spark.createDataFrame(list(enumerate(raw)), "k int, raw string")).orderBy("k").collect()
    assert [(r.parse_status, r.marks_awarded) for r in rows] == [("clean", "2"), ("repaired", "1"), ("salvaged", "0.5"), ("failed", None), ("failed", None), ("failed", None)]


def test_audits(spark):
    draft = [("Q1", True, "0.9", "1", "2"), ("Q2", True, "0.5", "1", "2"), ("Q3", True, "0.9", "0", "2"), ("Q4", False, None, None, "2"), ("Q5", True, "x", "1", "2")]
    rows = notes.audit_reason(spark.createDataFrame([(1, *d) for d in draft], "sheet_id long, qid string, readable boolean, confidence string, marks_awarded string, marks_max string"))
    assert {r.qid: r.audit_reason for r in rows.collect()} == {"Q1": None, "Q2": "low_confidence", "Q3": "zero_mark", "Q4": "unparseable_draft", "Q5": "non_numeric_confidence"}
    audit = spark.createDataFrame([(1, "Q2", "0.9", "9")], "sheet_id long, qid string, confidence string, marks_awarded string")
    verdict = {r.qid: (r.audited, r.marks_awarded, r.needs_review) for r in notes.final_verdict(rows, audit).collect()}
    assert verdict["Q1"] == ("no", 1.0, False) and verdict["Q2"] == ("yes", 2.0, False) and verdict["Q3"] == ("failed", 0.0, True)
