"""Long texts stay out of shuffles of the rows that have them."""

import re

import pytest
from pyspark.sql import functions as F

from marksmith.functions.texts import in_slice, with_text, with_text_by_slice
from marksmith.operators import grading, recovery
from marksmith.plans import queries
from marksmith.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def exchanged(df):
    """The columns that each shuffle carries."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    said = df._jdf.queryExecution().explainString(mode)
    return [{c.strip().split("#")[0] for c in x.split(",")} for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", said)]


@pytest.fixture
def sheets(spark):
    rows = spark.range(300).selectExpr("id % 40 AS sheet_id", "id AS base", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 7 END AS doc")
    texts = spark.range(6).selectExpr("id AS doc", "CASE WHEN id <> 2 THEN repeat('t' || id, 5) END AS text")
    want = {(i % 40, i, None if i % 3 == 0 or i % 7 in (2, 6) else f"t{i % 7}" * 5) for i in range(300)}
    return rows, texts, want


def test_reread_joins_lengths(spark):
    answer = spark.createDataFrame([(1, 1, "abc"), (1, 2, "x"), (2, 1, None)], "sheet_id long, base int, answer string")
    after = answer.withColumn("answer", F.concat("answer", F.lit("+")))
    found = recovery.commit_reread(answer, after)
    assert {(r.sheet_id, r.rejected, r.grown) for r in found.collect()} == {(1, False, "1,2"), (2, False, "")}
    assert all("was" not in c or "now" not in c for c in exchanged(found))
    kinds = re.findall(r"Project.*?length\(answer", found._jdf.queryExecution().executedPlan().toString())
    assert len(kinds) == 2  # of both readings before the join


def test_text_is_joined_last(sheets):
    rows, texts, want = sheets
    found = with_text(rows, texts, "sheet_id")
    assert {tuple(r) for r in found.select("sheet_id", "base", "text").collect()} == want
    assert not any({"sheet_id", "text"} <= c for c in exchanged(found))


def test_text_is_sent_once_to_a_slice(sheets):
    rows, texts, want = sheets
    found = with_text_by_slice(rows, texts, "sheet_id", 300)
    assert {tuple(r) for r in found.select("sheet_id", "base", "text").collect()} == want
    made = found.groupBy(in_slice(found, "sheet_id")).agg(F.count("text").alias("n"))
    assert len(exchanged(made)) == len(exchanged(found))
    assert {r.sheet_id: r.n for r in made.collect()} == {s: sum(w[0] == s and w[2] is not None for w in want) for s in range(40)}


def test_texts_are_tokenised_once(spark):
    """Answers as references, held against the same answers as texts."""
    ref = spark.createDataFrame([(1, 7, 1, "(b) ", 1), (1, 7, 2, "", 2), (1, 7, 3, "", 3), (2, 7, 1, "red ", None), (2, 7, 2, " ", None)], "sheet_id long, exam_id long, base int, opening string, doc long")
    texts = spark.createDataFrame([(1, "Red fish, RED boat"), (2, "\n"), (3, None)], "doc long, text string")
    expected = spark.createDataFrame([(7, 1, "red boat (b)"), (7, 2, "fish"), (7, 3, "")], "exam_id long, base int, expected string")
    gaps = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "sheet_id long, base int")
    brief, whole = queries.tokened(ref, texts, expected), queries.answered(ref, texts)
    for f in (lambda a: recovery.key_affinity(a, expected), lambda a: recovery.offtopic_hosts(a, expected, gaps, 0.1, -1.0)):
        assert sorted(f(brief).collect()) == sorted(f(whole).collect()) != []
    trimmed = F.trim("answer", F.lit(" \t\r\n")) != ""
    assert {(r.sheet_id, r.base) for r in brief.where(trimmed).collect()} == {(1, 1), (2, 1)}
    assert not any({"sheet_id", "text"} <= c for c in exchanged(recovery.offtopic_hosts(brief, expected, gaps)) if "tokens" not in c)


@pytest.mark.parametrize("name", ["c25_transcript", "c6_merge_answers", "e18_gathered_answers", "e20_merge_subparts", "c4_merge_fragments"])
def test_whole_answers_are_not_shuffled(spark, name):
    assert not any({"sheet_id", "answer"} <= c or {"exam_id", "qid", "answer", "page_no"} <= c for c in exchanged(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["f1_grading_universe", "f2_grade_blanks", "f25_pending_items"])
def test_graded_answers_pass_shuffles_without_their_texts(spark, name):
    """What the key says doesn't go along to the texts, and f25 reads what is graded once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        carried = exchanged(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    refs = [c for c in carried if {"opening", "doc"} <= c]
    assert len(refs) == 1 and not refs[0] & {"key_answer", "marks"}


def test_short_texts_are_as_blank_as_long_ones(spark):
    texts = ["", " ", "NA", " n/a\n", "[BLANK]", "[BLANK]]", " NA " + "x" * 9, " " * 50 + "none", None, "x" * 99, "\t" * 20]
    rows = spark.createDataFrame([(o, t) for o in ("", " ", "N", "Therefore ", "[BLA") for t in texts], "opening string, text string")
    whole = lambda t: F.concat("opening", F.coalesce(t, F.lit("")))
    short = grading.enough_for_blanks(F.col("text"))
    got = rows.select(grading.said(whole(F.col("text"))).alias("a"), grading.is_unanswered(whole(F.col("text"))).alias("x"), grading.is_unanswered(whole(short)).alias("y"), F.length(F.trim(short, F.lit(" \t\n"))).alias("n")).collect()
    assert all(r.x == r.y and (r.n or 0) <= 8 for r in got) and {r.a for r in got if r.x} == {"", "NA", "N/A", "[BLANK]", "NONE"}
