"""What is found within a row isn't shuffled, and what is shuffled is no text."""

from marksmith.operators import recovery, regions, splits
from marksmith.plans.fixtures import fixture
from marksmith.plans.queries import QUERIES

from .test_repairs import RUN, entries, question_set
from .test_texts import SF, exchanged


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lists_are_found_within_their_rows(spark):
    made = splits.split_objective_lists(entries(spark, [(7, "Q15", RUN), (8, "Q3", "plain")]), question_set(spark, [15, 16, 17]))
    assert not any({"line", "line_no", "answer"} & c for c in exchanged(made))
    assert len(exchanged(made)) <= 3  # by sheet, and by exam on both sides
    assert {r.qid for r in made.collect()} == {"Q15", "Q16", "Q17"}


def test_glued_entries_are_grouped_by_keys_alone(spark):
    whole, brief = (fixture(spark, SF, n) for n in ("glued_entry", "glued_entry_brief"))
    assert rows_of(whole) == rows_of(brief.select(whole.columns))
    assert not any("answer" in c for c in exchanged(brief))


def test_gaps_by_sheet_are_those_of_rows(spark):
    answer = entries(spark, [(7, "Q1", "x"), (7, "Q2", " "), (8, "Q9", None)])
    questions, sheet = question_set(spark, [1, 2, 3]), answer.select("sheet_id", "exam_id").distinct()
    want = {}
    for r in recovery.answer_gaps(answer, questions, sheet).collect():
        want.setdefault(r.sheet_id, set()).add(r.base)
    assert {r.sheet_id: r.gaps for r in recovery.gaps_by_sheet(answer, questions).collect()} == {k: sorted(v) for k, v in want.items()} == {7: [2, 3], 8: [1, 2, 3]}


def test_texts_are_sent_once_to_their_sheets(spark):
    answer = entries(spark, [(7, "Q1", "own\nQ4 buried"), (7, "Q2", "x")])
    gaps = spark.createDataFrame([(7, 4)], "sheet_id long, base int")
    made = splits.recover_gaps(answer, gaps)
    assert sum(bool({"answer", "whole", "text", "lines"} & c) for c in exchanged(made)) == 1
    assert {(r.qid, r.answer) for r in made.collect()} == {("Q1", "own"), ("Q2", "x"), ("Q4", "buried")}
    first = splits.first_lifts(answer, gaps)
    assert not any("answer" in c for c in exchanged(first))
    assert rows_of(first) == [(7, 4, "Q1", 1)]


def test_continuations_move_within_their_sheets(spark):
    answer = entries(spark, [(7, "Q34", "(a) own"), (7, "Q35", "(iii) late part\n(a) mine")])
    made = splits.reattach_continuation(answer, question_set(spark, [34, 35]))
    assert sum("answer" in c for c in exchanged(made)) == 1
    assert {(r.qid, r.answer, r.moved) for r in made.collect()} == {("Q34", "(a) own\n(iii) late part", True), ("Q35", "(a) mine", True)}


def test_pages_are_dealt_by_sheet_once(spark):
    whole, dealt = (fixture(spark, SF, n) for n in ("page_question", "page_question_dealt"))
    assert rows_of(whole) == rows_of(dealt.select(whole.columns))
    for name in ("g2_anchors", "g5_pick_boxes"):
        assert len(exchanged(QUERIES[name](spark, SF))) == 1, name


def test_of_several_replies_the_largest_box_counts(spark):
    replies = ['{"bbox_2d": [100, 100, 300, 400]}', '[{"bbox_2d": [200, 200, 500, 600]}, {"bbox_2d": [1, 1, 30, 30]}]', "[]"]
    box = spark.createDataFrame([(1, 1, r, 1000, 2000) for r in replies] + [(1, 2, '[{"bbox_2d": [0, 0, 900, 900]}, {"bbox_2d": [5, 5, 5, 9]}]', 1000, 2000), (1, 3, None, 1000, 2000)], "sheet_id long, page_no int, reply string, page_w int, page_h int")
    made = {r.page_no: tuple(r)[2:] for r in regions.pick_boxes(box).collect()}
    assert made == {1: (176, 376, 524, 1224, ""), 2: (None, None, None, None, "text, not a figure"), 3: (None, None, None, None, "no diagram found")}
