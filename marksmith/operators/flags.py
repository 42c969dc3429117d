"""Flags of graded questions with what they say: labels, details, severity and order, and the summary of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .notes import NOTE_PHRASES
from .review import CODES, INFO, rank, severity

#: Labels of the codes, and what a flag says whose field says nothing.
LABELS = {
    "injection": "Possible attempt to influence the grader", "no_answer_captured": "No answer captured", "misplaced_answer": "Possible misplaced answer", "not_in_paper": "Not in the question paper",
    "key_integrity": "Answer key and question paper disagree", "illegible": "Illegible handwriting", "ocr_symbol_uncertain": "Symbols may be misread", "question_number_misread": "Question number may be misread",
    "ocr_ambiguous": "Unclear symbol in the handwriting", "mixed_answer": "Answer may merge two questions", "boundary": "May continue the previous answer", "orientation": "Page orientation uncertain",
    "marks_capped": "Awarded above the maximum; capped", "optional_status": "Optional-question check failed", "uncertain_choice": "Possible internal choice", "incomplete_reply": "The grader's reply was cut off",
    "recovered": "Answer recovered by the system", "recovered_from": "Recovered from another question's slot", "rehomed": "Matched to another question", "grading_spread": "Graders disagreed on the mark",
    "low_confidence": "The AI was unsure", "needs_review": "Flagged for review",
}
DETAILS = {
    "illegible": "The handwriting was hard to read, so some of this answer may have been transcribed wrongly or missed. Check it against the sheet.",
    "uncertain_choice": "This looks like an 'answer any one' question, but the structure could not be confirmed. Check that the right alternative was graded.",
    "incomplete_reply": "The grader's reply was cut off and the mark was recovered from the partial response. Confirm the mark is right.",
    "low_confidence": "The AI reported low confidence in this grade.",
    "needs_review": "This answer was flagged for review, but no specific reason was recorded. Check it against the sheet.",
    "injection": "This answer contains text that looks like an attempt to influence the AI grader. The instruction was ignored and only the academic content graded.",
    "no_answer_captured": "Nothing was captured for this question. It may be blank, or its page may be missing or unreadable in the scan — check the sheet before accepting a zero.",
    "off_topic": "What was captured here does not appear to answer this question — most likely the scan assigned it to the wrong question. Check the sheet.",
}
NUMBER_MISREAD, CHECK_FAILED = "not one of the exam's question numbers", "sanity check failed"
#: Text columns that say what their code's flag says.
SAYING = {"mixed_answer": "mixed_warning", "recovered": "recovery_warning", "boundary": "boundary_warning", "orientation": "orientation_warning", "marks_capped": "calculation_warning", "grading_spread": "grading_spread"}
TEXTS = (*SAYING.values(), "injection_warning", "capture_status", "symbol_warning", "optional_status", "recovered_from", "justification", "confidence")
TRUTHS = ("injection", "off_topic", "bad_handwriting", "choice_uncertain", "incomplete_reply", "needs_review")
LISTS = ("rehomed_to", "review_notes")
FLAG = "array<struct<code:string,label:string,detail:string,severity:string,rank:int>>"
SEVERITIES = ("danger", "warning", "info")


def _filled(result: DataFrame) -> DataFrame:
    """All of the columns that flags are read from; those that aren't there are empty."""
    have = result.columns
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("") for c in TEXTS}
    truth = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in have else F.lit(False) for c in TRUTHS}
    listed = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>") for c in LISTS}
    return result.select("*", *[v.alias(f"_{k}") for k, v in (text | truth | listed).items()])


def with_flags(result: DataFrame) -> DataFrame:
    """result with flags (FLAG), by rank, each code once with the first detail that isn't empty.

    Read from the columns in TEXTS, TRUTHS and LISTS that there are; fields count before notes, notes by their phrases. low_confidence counts only beside flags of
    information, needs_review only when there is no other, so no question has a flag without words.
    """
    flag = lambda code, detail: F.struct(F.lit(rank(code)).cast("int").alias("rank"), F.lit(code).alias("code"), detail.alias("detail"))
    said = lambda c: F.col(f"_{c}")
    default = lambda code: F.lit(DETAILS[code])
    capture = F.lower(said("capture_status"))
    warned = F.when(said("injection_warning") != "", F.concat(default("injection"), F.lit(" It wrote: “"), said("injection_warning"), F.lit("”"))).otherwise(default("injection"))
    misread = F.contains(said("symbol_warning"), F.lit(NUMBER_MISREAD))
    homes = F.filter(F.transform(said("rehomed_to"), lambda x: F.trim(x)), lambda x: x != "")
    fields = [
        F.when(said("injection"), flag("injection", warned)),
        F.when(capture.startswith("no answer captured"), flag("no_answer_captured", default("no_answer_captured"))).when(F.contains(capture, F.lit("misplaced")), flag("misplaced_answer", said("capture_status"))),
        F.when(said("off_topic"), flag("misplaced_answer", default("off_topic"))),
        F.when(said("bad_handwriting"), flag("illegible", default("illegible"))),
        F.when(misread, flag("question_number_misread", said("symbol_warning"))).when(said("symbol_warning") != "", flag("ocr_symbol_uncertain", said("symbol_warning"))),
        *[F.when(said(column) != "", flag(code, said(column))) for code, column in SAYING.items()],
        F.when(F.contains(F.lower(said("optional_status")), F.lit(CHECK_FAILED)), flag("optional_status", said("optional_status"))),
        F.when(said("recovered_from") != "", flag("recovered_from", F.concat(F.lit("The question number was misread, so this answer was recovered here from the "), said("recovered_from"), F.lit(" slot.")))),
        F.when(F.size(homes) > 0, flag("rehomed", F.concat(F.lit("This looks like an answer to "), F.array_join(homes, ", "), F.lit("; it was matched there and graded on that question.")))),
    ]
    bracketed = F.regexp_extract_all(said("justification"), F.lit(r"\[([^\[\]]+)\]"), 1)
    notes = F.filter(F.transform(F.concat(said("review_notes"), bracketed), lambda n: F.trim(n)), lambda n: n != "")
    noted = F.array_compact(F.transform(notes, lambda n: F.coalesce(*[F.when(F.contains(n, F.lit(phrase)), flag(k, n)) for k, phrase in NOTE_PHRASES])))
    last = [F.when(said("choice_uncertain"), flag("uncertain_choice", default("uncertain_choice"))), F.when(said("incomplete_reply"), flag("incomplete_reply", default("incomplete_reply")))]
    rows = _filled(result).withColumn("_found", F.concat(F.array_compact(F.array(*fields)), noted, F.array_compact(F.array(*last))))
    explained = F.exists("_found", lambda x: ~x["code"].isin(*INFO))
    low = F.when((F.lower(said("confidence")) == "low") & ~explained, F.array(flag("low_confidence", default("low_confidence"))))
    nothing = F.array().cast("array<struct<rank:int,code:string,detail:string>>")
    rows = rows.withColumn("_found", F.concat("_found", F.coalesce(low, nothing)))
    rows = rows.withColumn("_found", F.when((F.size("_found") == 0) & said("needs_review"), F.array(flag("needs_review", default("needs_review")))).otherwise(F.col("_found")))
    at = lambda values, r: F.element_at(F.array(*[F.lit(v) for v in values]), r % 1000 + 1)  # noqa: E731  # a rank ends in its code's place
    labels, kinds = [LABELS[c] for c in CODES], [SEVERITIES[severity(c)] for c in CODES]

    def first(r: Column) -> Column:
        details = F.filter("_found", lambda x: (x["rank"] == r) & (x["detail"] != ""))
        return F.struct(at(CODES, r).alias("code"), at(labels, r).alias("label"), F.get(details, F.lit(0))["detail"].alias("detail"), at(kinds, r).alias("severity"), r.alias("rank"))

    ranks = F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["rank"])))
    return rows.withColumn("flags", F.transform(ranks, first).cast(FLAG)).select(*result.columns, "flags")


def flag_summary(flagged: DataFrame, key: str, order: str = "qorder") -> DataFrame:
    """(key, code, label, severity, detail, rank, qids) of each paper: the flags of its questions that need attention (needs_review or injection), with the first detail in the paper's order and each question once, in that order.

    flagged (key, order, qid, needs_review, injection, flags) as with_flags() gives them.
    """
    rows = flagged.where(F.coalesce("needs_review", F.lit(False)) | F.coalesce("injection", F.lit(False))).select(key, order, "qid", F.explode("flags").alias("f"))
    named = F.when(F.coalesce("f.detail", F.lit("")) != "", F.struct(order, "qid"))
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, "qid"))), lambda x: x["qid"]))
    return rows.groupBy(key, F.col("f.code").alias("code"), F.col("f.label").alias("label"), F.col("f.severity").alias("severity"), F.col("f.rank").alias("rank")).agg(
        F.coalesce(F.min_by("f.detail", named), F.lit("")).alias("detail"), F.array_join(ordered, ",").alias("qids")
    )
