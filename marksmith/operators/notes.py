"""Warnings beside a mark: side flags by question, notes, diagrams, model replies and re-marked questions. No rule here but
those on diagrams and replies changes a mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import quantize

#: What the warnings say.
MIXED = "This answer was assembled from two places in the scan that share its question number, so it may contain another question's answer mixed in (a misread question number). Verify which parts belong here."
MIXED_NOTE = "[Mixed-answer check: this slot may merge two questions' answers (a misread number) -- verify the split.]"
AMBIGUOUS = "OCR flagged an ambiguous/unclear symbol in the student's answer; verify the reading."
RECONCILED = "Maximum marks corrected from the question paper; verify and award any missing sub-part marks."
INCOMPLETE = "Recovered from an incomplete grader reply -- verify this mark against the sheet."
MISPLACED = "Possible misplaced answer (segmentation) -- verify against the sheet"
MULTIPART = "Diagram within a multi-part answer; verify the mark split manually."

#: Codes of notes by a phrase in them; the first that holds counts.
NOTE_PHRASES = (
    ("not_in_paper", "is not present in the question paper"), ("key_integrity", "was MISSING from the answer key"),
    ("key_integrity", "the key parse likely dropped one or more parts"), ("key_integrity", "but the paper marks it"),
    ("key_integrity", "but the question paper marks it"), ("key_integrity", "a part may be missing; verify"),
    ("ocr_ambiguous", "OCR flagged an ambiguous"), ("mixed_answer", "Mixed-answer check:"), ("boundary", "Boundary check:"),
)


def apply_side_flags(result: DataFrame, mixed: DataFrame, reason: DataFrame) -> DataFrame:
    """result (sheet_id, base, needs_review, justification) with the warnings of its question, each of which asks for review.

    mixed (sheet_id, base); reason (sheet_id, base, kind, note) with kind recovery, diagram or symbol.
    """
    wide = reason.where("note <> ''").groupBy("sheet_id", "base").agg(*[F.max(F.when(F.col("kind") == k, F.col("note"))).alias(f"{k}_warning") for k in ("recovery", "diagram", "symbol")])
    rows = result.join(mixed.select("sheet_id", "base", F.lit(MIXED).alias("mixed_warning")).distinct(), ["sheet_id", "base"], "left").join(wide, ["sheet_id", "base"], "left")
    warned = F.coalesce("mixed_warning", "recovery_warning", "diagram_warning", "symbol_warning").isNotNull()
    noted = F.trim(F.concat_ws(" ", F.rtrim(F.coalesce("justification", F.lit(""))), F.when(F.col("mixed_warning").isNotNull(), MIXED_NOTE)))
    return rows.withColumns({"needs_review": F.col("needs_review") | warned, "justification": noted})


def apply_notes(result: DataFrame) -> DataFrame:
    """result (answer, justification, needs_review, reconciled, reconcile_note, key_warning) with review_notes, each in brackets behind the justification once."""
    unclear = F.col("answer").rlike(r"(?i)\[(?:ambiguous|smudged|illegible|unreadable)\b")
    notes = F.array_compact(F.array(
        F.when(unclear, AMBIGUOUS), F.when(F.col("reconciled"), F.coalesce(F.nullif("reconcile_note", F.lit("")), F.lit(RECONCILED))), F.nullif("key_warning", F.lit("")),
    ))
    rows = result.withColumn("review_notes", notes)
    add = lambda text, n: F.when(F.contains(text, n), text).otherwise(F.trim(F.concat(text, F.lit(" ["), n, F.lit("]"))))
    said = F.aggregate("review_notes", F.rtrim(F.coalesce("justification", F.lit(""))), add)
    return rows.withColumns({"justification": said, "needs_review": F.col("needs_review") | (F.size("review_notes") > 0)})


def classify_notes(result: DataFrame) -> DataFrame:
    """(sheet_id, base, code, note): the notes and bracketed spans of the justification that hold a known phrase; the first note of each code."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    spans = F.transform(F.regexp_extract_all(F.coalesce("justification", F.lit("")), F.lit(r"\[([^\[\]]+)\]"), 1), squeezed)
    notes = F.array_distinct(F.concat(F.transform("review_notes", squeezed), spans))
    code = F.coalesce(*[F.when(F.contains("note", F.lit(phrase)), F.lit(k)) for k, phrase in NOTE_PHRASES])
    rows = result.select("sheet_id", "base", F.posexplode(notes).alias("pos", "note")).withColumn("code", code).where("code IS NOT NULL")
    return rows.groupBy("sheet_id", "base", "code").agg(F.min_by("note", "pos").alias("note"))


def attach_flags(result: DataFrame, flag: DataFrame, overwrite: bool = False) -> DataFrame:
    """result (sheet_id, base, flags array) with the flags derived anew (sheet_id, base, code, rank) where it has none, or everywhere."""
    codes = flag.groupBy("sheet_id", "base").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("derived"))
    rows = result.join(codes, ["sheet_id", "base"], "left").withColumn("derived", F.coalesce("derived", F.array().cast("array<string>")))
    return rows.withColumn("flags", F.col("derived") if overwrite else F.coalesce("flags", "derived")).drop("derived")


def audit_reason(draft: DataFrame, mode: str = "cascade", least: float = 0.8) -> DataFrame:
    """Why a diagram's draft (readable, confidence, marks_awarded, marks_max as read) is audited; null where it stands."""
    if mode in ("always", "never"):
        return draft.withColumn("audit_reason", F.lit("always") if mode == "always" else F.lit(None).cast("string"))
    number = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")).try_cast("double")
    confidence, marks, most = number("confidence"), number("marks_awarded"), F.coalesce(number("marks_max"), F.lit(0.0))
    reason = (
        F.when(~F.col("readable"), "unparseable_draft").when(confidence.isNull(), "non_numeric_confidence").when(confidence < least, "low_confidence")
        .when(marks.isNull(), "non_numeric_mark").when((most > 0) & (marks <= 0), "zero_mark")
    )
    return draft.withColumn("audit_reason", reason)


def final_verdict(draft: DataFrame, audit: DataFrame, least: float = 0.8) -> DataFrame:
    """The verdict on each diagram: draft (sheet_id, qid, confidence, marks_awarded, marks_max, audit_reason), audit (sheet_id, qid, confidence, marks_awarded).

    A draft without reason stands; one whose audit gave nothing keeps its mark and goes to review.
    """
    found = audit.select("sheet_id", "qid", F.col("confidence").alias("a_confidence"), F.col("marks_awarded").alias("a_marks"), F.lit(True).alias("answered"))
    rows = draft.join(found, ["sheet_id", "qid"], "left")
    asked, answered = F.col("audit_reason").isNotNull(), F.coalesce("answered", F.lit(False))
    taken = asked & answered
    confidence = F.coalesce(F.when(taken, F.col("a_confidence")).otherwise(F.col("confidence")).try_cast("double"), F.lit(1.0))
    mark = quantize(F.when(taken, F.col("a_marks")).otherwise(F.col("marks_awarded")), F.col("marks_max"))
    return rows.select(
        "sheet_id", "qid", mark.alias("marks_awarded"), confidence.alias("confidence"), F.when(~asked, "no").when(answered, "yes").otherwise("failed").alias("audited"), "audit_reason",
        F.when(asked & ~answered, True).otherwise(confidence < least).alias("needs_review"),
    )


def merge_diagrams(result: DataFrame, verdict: DataFrame, best_of: bool = True) -> DataFrame:
    """Marks of questions (sheet_id, qid, marks_awarded, marks_max, confidence, needs_review) with a diagram verdict (sheet_id, qid, vorder, marks_awarded, confidence, needs_review).

    A verdict on a sub-part counts for its parent, the last one where there are several, and asks for review. The better of
    the written and the drawn mark counts, or the drawn one always without ``best_of``.
    """
    ids = result.select("sheet_id", "qid")
    own = verdict.join(ids, ["sheet_id", "qid"], "left_semi").withColumn("of_part", F.lit(False))
    parts = verdict.join(ids, ["sheet_id", "qid"], "left_anti").withColumn("qid", F.substring_index("qid", ".", 1)).withColumn("of_part", F.lit(True))
    last = own.unionByName(parts).groupBy("sheet_id", "qid").agg(F.max_by(F.struct("marks_awarded", "confidence", "needs_review"), "vorder").alias("d"), F.bool_or("of_part").alias("of_part"))
    rows = result.join(last, ["sheet_id", "qid"], "left")
    drawn, text = quantize(F.col("d.marks_awarded"), F.col("marks_max")), quantize(F.col("marks_awarded"), F.col("marks_max"))
    has = F.col("d").isNotNull()
    written = F.lit(best_of) & (text > drawn)
    source = F.when(has & written, "written answer").when(has & F.lit(best_of) & (drawn > text), "diagram")
    band = F.when(F.col("d.confidence") >= 0.8, "High").when(F.col("d.confidence") >= 0.5, "Medium").otherwise("Low")
    return rows.select(
        "sheet_id", "qid", F.when(has, F.when(written, text).otherwise(drawn)).otherwise(F.col("marks_awarded")).alias("marks_awarded"), "marks_max", source.alias("marks_source"),
        F.when(has & ~written, band).otherwise(F.col("confidence")).alias("confidence"),
        F.when(has, F.col("d.needs_review") | F.col("of_part")).otherwise(F.col("needs_review")).alias("needs_review"), F.when(has & F.col("of_part"), MULTIPART).alias("calculation_warning"),
    )


def finalize_replies(reply: DataFrame, item: DataFrame) -> DataFrame:
    """Results of parsed replies (sheet_id, base, marks_awarded, confidence, justification, feedback, off_topic, needs_review as read) to items
    (sheet_id, base, answer, key_answer, marks_max, is_bad_handwriting): missing fields filled, the key's maximum, marks on the grid."""
    rows = reply.join(item, ["sheet_id", "base"])
    incomplete = F.col("justification").isNull() | F.col("feedback").isNull()
    awarded = F.coalesce(F.col("marks_awarded").try_cast("double"), F.lit(0.0))
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).startswith("y"), F.lit(False))
    capped, off = awarded > F.col("marks_max"), yes("off_topic")
    return rows.select(
        "sheet_id", "base", "answer", F.col("key_answer").alias("correct_answer"), quantize(F.col("marks_awarded"), F.col("marks_max")).alias("marks_awarded"), "marks_max",
        F.coalesce("confidence", F.when(incomplete, "Low").otherwise("Medium")).alias("confidence"), F.coalesce("justification", F.lit(INCOMPLETE)).alias("justification"),
        F.coalesce("feedback", F.lit("")).alias("feedback"), incomplete.alias("incomplete_reply"), capped.alias("marks_capped"), F.when(off, MISPLACED).alias("capture_status"),
        (yes("needs_review") | incomplete | capped | off | F.col("is_bad_handwriting")).alias("needs_review"),
    )


def merge_regrade(state: DataFrame, edited: DataFrame, reply: DataFrame) -> DataFrame:
    """state (review_id, qid, answer, mark, marks_max, machine_mark, needs_review) after a teacher's new readings (review_id, qid, answer).

    A reading that says the same keeps its mark and needs no review any more; another one takes the mark of its reply
    (review_id, qid, mark), if there is one, as the machine's new mark, the old one being kept beside it.
    """
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = state.join(edited.select("review_id", "qid", F.col("answer").alias("new_answer")), ["review_id", "qid"], "left")
    rows = rows.join(reply.select("review_id", "qid", F.col("mark").alias("new_mark")), ["review_id", "qid"], "left")
    touched = F.col("new_answer").isNotNull()
    same = touched & (squeezed("new_answer") == squeezed("answer"))
    marked = touched & ~same & F.col("new_mark").isNotNull()
    mark = quantize(F.col("new_mark"), F.col("marks_max"))
    return rows.select(
        "review_id", "qid", F.when(touched & ~same, F.col("new_answer")).otherwise(F.col("answer")).alias("answer"), F.when(marked, mark).otherwise(F.col("mark")).alias("mark"), "marks_max",
        F.when(marked, mark).otherwise(F.col("machine_mark")).alias("machine_mark"), F.when(marked, F.col("mark")).alias("mark_before"),
        F.when(same, False).otherwise(F.col("needs_review")).alias("needs_review"), touched.alias("reviewed"),
    )
