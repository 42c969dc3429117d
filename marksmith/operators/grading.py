"""Grading rules: what is graded, blanks, objective answers, votes, escalation."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.marks import quantize


def grading_universe(key: DataFrame, answer: DataFrame, sheet: DataFrame, blank: Column | None = None) -> DataFrame:
    """Every key entry of the sheet's exam, and answers without one (0 marks); a missing answer is [BLANK], or ``blank`` where answers come in another form."""
    wanted = sheet.select("sheet_id", "exam_id").join(key.select("exam_id", "base", "marks", "key_answer"), "exam_id").drop("exam_id")
    have = answer.select("sheet_id", "base", "answer")
    return wanted.join(have, ["sheet_id", "base"], "full").select(
        "sheet_id", "base", F.coalesce("answer", F.lit("[BLANK]") if blank is None else blank).alias("answer"), F.coalesce("key_answer", F.lit("")).alias("key_answer"), F.coalesce("marks", F.lit(0.0)).alias("marks")
    )


BLANKS, NOT_ATTEMPTED = ("[BLANK]", ""), ("NA", "N/A", "NONE")


def said(answer: Column) -> Column:
    return F.upper(F.trim(answer, F.lit(" \t\r\n")))


def is_unanswered(answer: Column) -> Column:
    """Whether an answer is blank or given as not attempted."""
    return said(answer).isin(*BLANKS, *NOT_ATTEMPTED)


def enough_for_blanks(text: Column) -> Column:
    """A text that, behind whatever opening, is as blank as ``text``: itself, or signs in place of one that is longer than all that counts as unanswered."""
    longest = max(len(w) for w in (*BLANKS, *NOT_ATTEMPTED))
    return F.when(F.length(F.trim(text, F.lit(" \t\r\n"))) > longest, "x" * (longest + 1)).otherwise(text)


def grade_blanks(item: DataFrame) -> DataFrame:
    """Results of answers that are blank (to be reviewed) or given as not attempted (sure); others are left out."""
    rows = item.withColumn("said", said(F.col("answer"))).where(F.col("said").isin(*BLANKS, *NOT_ATTEMPTED))
    blank = F.col("said").isin(*BLANKS)
    return rows.select(
        "sheet_id", "base", F.lit(0.0).alias("marks_awarded"), F.when(blank, "Low").otherwise("High").alias("confidence"), blank.alias("needs_review"),
        F.when(blank, "No answer captured").otherwise("").alias("capture_status"),
    )


#: Words that a pupil writes before an answer, and signs behind an option's letter or number.
ANSWER_WORDS = ("q", "que", "ques", "question", "ans", "answer", "sol", "soln", "solution")
OPTION_SIGNS = ".):-/–—"
SIMILAR_LABELS = 0.85


def option_text(text: Column) -> Column:
    """An answer without the label word and number before it, and without a question's number before a one-letter option."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    word = F.lower(F.regexp_extract(bare, "^([A-Za-z]+)", 1))
    behind = F.regexp_replace(bare, "^[A-Za-z]+", "")
    labelled = word.isin(*ANSWER_WORDS) | ((word == "a") & behind.rlike(r"^\s*\.?\s*[0-9]"))
    unlabelled = F.when(labelled, F.regexp_replace(behind, r"^\s*\.?\s*[0-9]*\s*[.):-]?\s*", "")).otherwise(bare)
    return F.regexp_replace(unlabelled, r"^\s*\(?\s*[0-9]{1,3}\s*[.):–—-]\s*(?=\(?\s*[A-Za-z]\b)", "")


def with_option(text: Column) -> tuple[Column, Column]:
    """(identifier or null, label) of an answer: "(c) Both" is c and Both; without a leading option the whole text is the label."""
    bare = option_text(text)
    token, signs = r"^\s*\(?\s*([A-Za-z]{1,3}|[0-9]{1,2})\s*", "[" + re.escape(OPTION_SIGNS) + "]"
    alone = bare.rlike("^(?:[A-Za-z]|[0-9]{1,2})$")
    led = bare.rlike(token + signs)
    label = F.when(led, F.regexp_replace(bare, token + signs + r"\s*", "")).when(alone, "").otherwise(bare)
    return F.when(led, F.regexp_extract(bare, token + signs, 1)).when(alone, bare), F.trim(label, F.lit(" \t\r\n"))


def option_letters(text: Column) -> Column:
    """Distinct option letters A to E that an answer marks, in order: in brackets, or after white space with a closing sign."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\(?\s*[0-9]+\s*[).:-]\s*", "")
    # each way begins with a character of its own, so that most places are passed after one look
    marked = F.regexp_extract_all(bare, F.lit(r"[(\[]\s*[A-Ea-e]\s*[)\]]|[A-Ea-e](?<!\S.)\s*[).]"), 0)
    return F.array_sort(F.array_distinct(F.transform(marked, lambda m: F.upper(F.regexp_extract(m, "([A-Ea-e])", 1)))))


@F.pandas_udf(BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    may = lambda x, y: 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) >= SIMILAR_LABELS  # noqa: E731 — an upper bound by counts of characters
    return pd.Series([x is not None and may(x, y) and SequenceMatcher(None, x, y).ratio() >= SIMILAR_LABELS for x, y in zip(a, b)], dtype=bool)


def mcq_match(item: DataFrame) -> DataFrame:
    """Adds option, key_option, id_match and label_match to (answer, key_answer).

    Labels match when they are equal but for case and white space, or similar, unless both have an identifier and these
    differ. Only pairs that may be similar by their lengths alone are handed to Python.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    bare_id = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    option, label = with_option(F.col("answer"))
    key_option, key_label = with_option(F.col("key_answer"))
    rows = item.withColumns({"option": option, "key_option": key_option, "_said": plain(label), "_right": plain(key_label)})
    id_match = F.coalesce(bare_id(F.col("option")) == bare_id(F.col("key_option")), F.lit(False))
    conflict = F.col("option").isNotNull() & F.col("key_option").isNotNull() & ~id_match
    both, n, m = (F.col("_said") != "") & (F.col("_right") != ""), F.length("_said"), F.length("_right")
    open_pair = both & (F.col("_said") != F.col("_right")) & ~conflict & (2 * F.least(n, m) >= SIMILAR_LABELS * (n + m))
    similar = _similar(F.when(open_pair, F.col("_right")), F.when(open_pair, F.col("_said")))
    return rows.withColumns({"id_match": id_match, "label_match": (both & (F.col("_said") == F.col("_right"))) | similar}).drop("_said", "_right")


def grade_mcq(item: DataFrame) -> DataFrame:
    """verdict right or wrong for answers that mark one option and begin with one; defer for all others.

    Right when option or text matches the key, wrong when neither does and the key has one option letter too.
    """
    letter = "^[A-Za-z]$"
    found = mcq_match(item).withColumn("letters", option_letters(F.col("answer")))
    clean = (F.size("letters") == 1) & F.coalesce(F.col("option").rlike(letter), F.lit(False))
    matched, keyed = F.col("id_match") | F.col("label_match"), F.coalesce(F.col("key_option").rlike(letter), F.lit(False))
    verdict = F.when(clean & matched, "right").when(clean & keyed, "wrong").otherwise("defer")
    marks = F.when(F.col("verdict") == "right", F.col("marks")).when(F.col("verdict") == "wrong", 0.0)
    return found.withColumn("verdict", verdict).withColumn("marks_awarded", marks).drop("letters", "id_match", "label_match", "option", "key_option")


#: Words that route a question to a rubric, tried in this order.
OBJECTIVE_TYPES = ("objective", "mcq", "multiple choice", "assertion")
BINARY_TYPES = ("true/false", "true or false", "fill in the blank", "one word")
CODE_TYPES = ("code", "programming", "sql", "python")
CODE_SUBJECTS = ("computer science", "informatics", "information practices", "computer")
EQUATION_TYPES = ("equation", "math", "calculation", "numeric", "derivation", "proof")
EQUATION_SUBJECTS = ("mathematics", "maths", "math")


def rubric_kind(kind: Column, subject: Column, marks: Column) -> Column:
    def holds(text: Column, words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.coalesce(F.lower(text), F.lit("")).contains(w)
        return found

    return (
        F.when(holds(kind, OBJECTIVE_TYPES), "objective").when(holds(kind, BINARY_TYPES) & (marks.try_cast("double") <= 1), "objective")
        .when(holds(kind, CODE_TYPES) | holds(subject, CODE_SUBJECTS), "code").when(holds(kind, EQUATION_TYPES) | holds(subject, EQUATION_SUBJECTS), "equation").otherwise("subjective")
    )


def finalize(reply: DataFrame) -> DataFrame:
    """Marks on the grid and not above the key's maximum; capped, off-topic and badly written answers go to review."""
    capped = F.col("raw_mark") > F.col("marks_max")
    review = capped | F.col("off_topic") | F.col("bad_handwriting")
    return reply.withColumns({"marks_awarded": quantize(F.col("raw_mark"), F.col("marks_max")), "marks_capped": capped, "needs_review": review})


def consensus(vote: DataFrame) -> DataFrame:
    """The lower median of votes on the grid, the first vote that gave it, and the spread when votes differ."""
    q = vote.withColumn("q", quantize(F.col("mark")))
    middle = q.groupBy("sheet_id", "base").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY q)").alias("mark"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.count(F.lit(1)).alias("votes")
    )
    first = q.join(middle.select("sheet_id", "base", F.col("mark").alias("q")), ["sheet_id", "base", "q"]).groupBy("sheet_id", "base").agg(F.min("vote_no").alias("vote_no"))
    return middle.join(first, ["sheet_id", "base"]).withColumn("differs", F.col("lo") < F.col("hi"))


def escalation_reason(mark: Column, marks_max: Column, confidence: Column, off_topic: Column, injection: Column, chars: Column, partial: bool = False, parsed: Column | None = None) -> Column:
    """Why a fast result is graded again, the first that holds; null when none does.

    parsed: whether the reply could be read at all. A mark that a reply doesn't give, or gives as an empty text, counts as 0.
    """
    number = F.coalesce(F.nullif(F.trim(mark.cast("string")), F.lit("")), F.lit("0")).try_cast("double")
    unread = F.lit(False) if parsed is None else ~F.coalesce(parsed, F.lit(False))
    reason = (
        F.when(unread, "unparseable_result").when(number.isNull(), "non_numeric_mark").when(F.isnan(number) | (F.abs(number) == float("inf")), "non_finite_mark")
        .when(~F.coalesce(F.lower(F.trim(confidence)), F.lit("")).isin("high", "medium"), "low_confidence").when(off_topic, "off_topic").when(injection, "prompt_injection")
        .when((number <= 0) & (marks_max >= 1) & (chars >= 10), "substantive_zero")
    )
    return reason.when((number > 0) & (number < marks_max), "partial_credit") if partial else reason


def cascade(fast: DataFrame, deep: DataFrame) -> DataFrame:
    """fast (sheet_id, base, mark, reason) with the deep result where there is a reason and a deep mark."""
    joined = fast.join(deep.select("sheet_id", "base", F.col("mark").alias("deep_mark")), ["sheet_id", "base"], "left")
    taken = F.col("reason").isNotNull() & F.col("deep_mark").isNotNull()
    return joined.select(
        "sheet_id", "base", F.when(taken, F.col("deep_mark")).otherwise(F.col("mark")).alias("mark"), F.when(taken, F.col("reason")).alias("escalated_because"), F.when(taken, F.col("mark")).alias("fast_mark")
    )


def starts_like_continuation(answer: Column) -> Column:
    """Whether the first line that isn't blank opens like the rest of another answer."""
    line = F.regexp_extract(F.coalesce(answer, F.lit("")), r"^\s*([^\n]*)", 1)
    return line.rlike(r"^(?:=|∴|⇒)") | line.rlike(r"(?i)^(?:therefore|hence|thus)\b")


def choice_rules(instruction: DataFrame) -> DataFrame:
    """(sheet_id, base, n, m) of instructions (sheet_id, pos, text) such as "Q5 Answer any 2 out of the given 3"; the last for a question counts."""
    number = lambda pattern: F.regexp_extract("text", pattern, 1).try_cast("int")
    any_of = r"[Aa]nswer\s+any\s+([0-9]+)\s+out\s+of\s+(?:the\s+given\s+)?[0-9]+"
    out_of = r"[Aa]nswer\s+any\s+[0-9]+\s+out\s+of\s+(?:the\s+given\s+)?([0-9]+)"
    rules = instruction.select("sheet_id", "pos", number(r"Q\.?\s*([0-9]+).*?[Aa]nswer\s+any").alias("base"), number(any_of).alias("n"), number(out_of).alias("m"))
    last = rules.where("base IS NOT NULL AND m IS NOT NULL").groupBy("sheet_id", "base").agg(F.max_by(F.struct("n", "m"), "pos").alias("r"))
    return last.select("sheet_id", "base", "r.n", "r.m")


def best_of_n(result: DataFrame, rules: DataFrame) -> DataFrame:
    """Parts (sheet_id, base, qorder, answer, marks_awarded, marks_max, needs_review, capture_status) of "answer any n out of m".

    Where a question hasn't m parts, all go to review and nothing else changes. Otherwise the parts beyond the n best, ties
    in order, count 0 of 0; a blank one of them isn't a lost answer, so it needs no review for that. A sheet's rules come as a list, so parts that are dealt by sheet need no shuffle and one sort.
    """
    best = Window.partitionBy("sheet_id", "base").orderBy(F.desc("marks_awarded"), "qorder")
    listed = rules.groupBy("sheet_id").agg(F.collect_list(F.struct("base", "n", "m")).alias("rules"))
    rule = F.get(F.filter("rules", lambda r: r["base"] == F.col("base")), F.lit(0))
    ruled = result.join(listed, "sheet_id", "left").withColumns({"n": rule["n"], "m": rule["m"]}).drop("rules")
    every = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ruled.withColumns({"parts": F.count(F.lit(1)).over(every), "rank": F.row_number().over(best)})
    odd = F.col("m").isNotNull() & (F.col("parts") != F.col("m"))
    dropped = F.col("m").isNotNull() & ~odd & (F.col("rank") > F.col("n"))
    blank = F.trim(F.coalesce("answer", F.lit(""))).isin("", "[BLANK]")
    lost = dropped & blank & (F.col("capture_status") == "No answer captured")
    failed = F.concat(F.lit("Instruction Sanity Check Failed (Expected "), F.col("m"), F.lit(" parts, found "), F.col("parts"), F.lit(")"))
    return rows.withColumns({
        "optional_status": F.when(odd, failed).when(dropped & blank, "Not Attempted (Optional)").when(dropped, "Attempted but Dropped (Best of N logic)"),
        "marks_awarded": F.when(dropped, 0.0).otherwise(F.col("marks_awarded")), "marks_max": F.when(dropped, 0.0).otherwise(F.col("marks_max")),
        "needs_review": F.when(odd, True).when(lost, False).otherwise(F.col("needs_review")),
        "capture_status": F.when(lost, "Not Attempted (Optional)").otherwise(F.col("capture_status")),
    }).drop("n", "m", "parts", "rank")


def attempted_choice(item: DataFrame) -> DataFrame:
    """Adds expected to (answer, key_answer, choice_shared, choice_alternatives): the shared text and the one alternative whose label opens a line.

    The whole key where no label or several do, or where labels are missing or repeated.
    """
    opening = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(?:^|\n)\s*(?:\(\s*[A-Za-z]\s*\)|[A-Za-z]\s*[.):-])"), 0)
    written = F.transform(opening, lambda x: F.lower(F.regexp_extract(x, "([A-Za-z])", 1)))
    alternatives = F.coalesce("choice_alternatives", F.array().cast("array<struct<label:string,answer:string>>"))
    labels = F.transform(alternatives, lambda a: F.lower(F.trim(a["label"])))
    usable = (F.size(labels) >= 2) & ~F.exists(labels, lambda x: x == "") & (F.size(F.array_distinct(labels)) == F.size(labels))
    rows = item.withColumn("_hit", F.filter(alternatives, lambda a: F.array_contains(written, F.lower(F.trim(a["label"])))))
    shared = F.trim(F.coalesce("choice_shared", F.lit("")))
    one = F.concat(F.when(shared != "", F.concat(shared, F.lit("\n"))).otherwise(""), F.trim(F.get("_hit", F.lit(0))["answer"]))
    return rows.withColumn("expected", F.when(usable & (F.size("_hit") == 1), one).otherwise(F.col("key_answer"))).drop("_hit")


def display_question(question: Column, answer: Column) -> Column:
    """The question's text, empty where it only repeats the answer."""
    q, a = (F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n")) for c in (question, answer))
    return F.when((a != "") & (q == a), "").otherwise(q)


def totals_guard(result: DataFrame, key_total: DataFrame) -> DataFrame:
    """Sheets whose recorded maximum is above the key's total."""
    sums = result.groupBy("sheet_id", "exam_id").agg(F.sum("marks_max").alias("recorded"))
    return sums.join(key_total, "exam_id").where(F.col("recorded") > F.col("key_total") + 1e-6)


def pending_items(universe: DataFrame, done: DataFrame) -> DataFrame:
    return universe.join(done.select("sheet_id", "base"), ["sheet_id", "base"], "left_anti")


def failed_replies(item: DataFrame, reply: DataFrame) -> DataFrame:
    """Items (sheet_id, base, marks_max) without any reply that could be read: no marks, low confidence, for review."""
    return item.join(reply, ["sheet_id", "base"], "left_anti").select("sheet_id", "base", F.lit(0.0).alias("marks_awarded"), "marks_max", F.lit("low").alias("confidence"), F.lit(True).alias("needs_review"))


def unassessed_diagrams(expected: DataFrame, features: DataFrame) -> DataFrame:
    """Questions with a diagram for which no usable features were found."""
    return expected.select("sheet_id", "base").distinct().join(features, ["sheet_id", "base"], "left_anti")
