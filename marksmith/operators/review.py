"""Review: flags with reasons, teacher decisions, effective state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import quantize

#: Flag codes in rank order, by severity.
DANGER = ("injection",)
WARNING = (
    "no_answer_captured", "misplaced_answer", "question_number_misread", "not_in_paper", "key_integrity", "illegible", "ocr_symbol_uncertain", "ocr_ambiguous",
    "mixed_answer", "boundary", "orientation", "marks_capped", "optional_status", "uncertain_choice", "incomplete_reply",
)
INFO = ("recovered", "recovered_from", "rehomed", "grading_spread", "low_confidence")
LAST = ("needs_review",)
CODES = (*DANGER, *WARNING, *INFO, *LAST)


def severity(code: str) -> int:
    return 0 if code in DANGER else 2 if code in INFO else 1


def rank(code: str) -> int:
    return severity(code) * 1000 + CODES.index(code)


def derive_flags(result: DataFrame, conditions: dict) -> DataFrame:
    """One row per flag (sheet_id, base, code, severity, rank).

    ``conditions`` maps codes to Boolean columns. low_confidence counts only when nothing above info
    holds, needs_review only when no other flag does; both are conditions like the others.
    """
    held = [F.when(c, F.struct(F.lit(k).alias("code"), F.lit(severity(k)).alias("severity"), F.lit(rank(k)).alias("rank"))) for k, c in conditions.items() if k not in ("low_confidence", "needs_review")]
    first = result.withColumn("flags", F.array_compact(F.array(*held)))
    low = F.struct(F.lit("low_confidence").alias("code"), F.lit(2).alias("severity"), F.lit(rank("low_confidence")).alias("rank"))
    todo = F.struct(F.lit("needs_review").alias("code"), F.lit(1).alias("severity"), F.lit(rank("needs_review")).alias("rank"))
    second = first.withColumn("flags", F.when(conditions["low_confidence"] & ~F.exists("flags", lambda x: x["severity"] < 2), F.array_append("flags", low)).otherwise(F.col("flags")))
    third = second.withColumn("flags", F.when(conditions["needs_review"] & (F.size("flags") == 0), F.array_append("flags", todo)).otherwise(F.col("flags")))
    return third.select("sheet_id", "exam_id", "base", F.explode("flags").alias("f")).select("sheet_id", "exam_id", "base", "f.code", "f.severity", "f.rank")


def summarise_flags(result_flag: DataFrame, key: str) -> DataFrame:
    """Per ``key`` and code: how many flags, the rank, the smallest and largest question, and each question once, in order."""
    bases = F.array_join(F.array_sort(F.collect_set("base")).cast("array<string>"), ",")
    return result_flag.groupBy(key, "code").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.min("base").alias("first_base"), F.max("base").alias("last_base"), bases.alias("bases")
    )


def last_decisions(decision: DataFrame) -> DataFrame:
    return decision.groupBy("review_id", "base").agg(F.max_by(F.struct("decision", "corrected_marks", "seq"), "seq").alias("d")).select("review_id", "base", "d.decision", "d.corrected_marks", "d.seq")


def apply_decisions(state: DataFrame, decision: DataFrame) -> DataFrame:
    """state (review_id, base, machine_mark, marks_max) with its mark after the last decision: a rejection sets the teacher's, anything else the machine's."""
    joined = state.join(last_decisions(decision), ["review_id", "base"], "left")
    rejected = F.coalesce(F.col("decision") == "reject", F.lit(False))
    mark = F.when(rejected, quantize(F.col("corrected_marks"), F.col("marks_max"))).otherwise(F.col("machine_mark"))
    return joined.select("review_id", "base", "machine_mark", "marks_max", mark.alias("mark"), rejected.alias("rejected"), F.col("decision").isNotNull().alias("reviewed"))


def review_totals(applied: DataFrame) -> DataFrame:
    return applied.groupBy("review_id").agg(
        F.sum("mark").alias("total"), F.sum("marks_max").alias("total_max"), F.count_if("rejected").alias("rejected"), F.count_if("reviewed").alias("reviewed"), F.count(F.lit(1)).alias("questions")
    )


def rejected_rows(applied: DataFrame) -> DataFrame:
    """The rows that a teacher rejected: review_id, base, the machine's mark and the teacher's."""
    return applied.where("rejected").select("review_id", "base", "machine_mark", F.col("mark").alias("teacher_mark"))


def review_progress(result: DataFrame) -> DataFrame:
    return result.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("needs_review") & ~F.col("bad_handwriting")).alias("needs_review"), F.count_if("injection").alias("injection")
    )


def current_state(snapshot: DataFrame, edited: DataFrame, key: str, value: str) -> DataFrame:
    """The edited copy's value where there is one, else the snapshot's."""
    e = edited.select(key, F.col(value).alias("edited_value"))
    return snapshot.join(e, key, "left").withColumns({value: F.coalesce("edited_value", value), "is_edited": F.col("edited_value").isNotNull()}).drop("edited_value")


def effective_state(snapshot: DataFrame, working: DataFrame) -> DataFrame:
    """What counts of each run (run_id, qid, question, ..): its working copy if it has one, as a whole, else its snapshot; with is_edited.

    Both have the same columns. A question's text that a working copy lacks comes from the snapshot's question of the same id; nothing else is filled in.
    """
    edited = working.select("run_id").distinct()
    shown = snapshot.where("trim(question) <> ''").groupBy("run_id", "qid").agg(F.first("question").alias("_question"))
    copies = working.join(shown, ["run_id", "qid"], "left").withColumn("question", F.coalesce(F.nullif("question", F.lit("")), "_question")).select(snapshot.columns)
    pristine = snapshot.join(edited, "run_id", "left_anti").select(snapshot.columns)
    return copies.withColumn("is_edited", F.lit(True)).unionByName(pristine.withColumn("is_edited", F.lit(False)))


def superseded_reports(runs: DataFrame, replacement: DataFrame) -> DataFrame:
    """(run_id, report_path, report_removed) of the runs (run_id, report_path) that leave the current view, replaced by another, successful one (old_run, new_run, succeeded).

    Their report goes only where the new run is known to have written another one: reports bear the pupil's name, so two runs may share the file.
    """
    gone = replacement.where("succeeded AND old_run <> new_run").groupBy(F.col("old_run").alias("run_id")).agg(F.max("new_run").alias("new_run"))
    new = runs.select(F.col("run_id").alias("new_run"), F.col("report_path").alias("new_path"))
    rows = runs.join(gone, "run_id").join(new, "new_run", "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.select("run_id", "report_path", (given("report_path") & given("new_path") & (F.col("report_path") != F.coalesce("new_path", F.lit("")))).alias("report_removed"))


def working_copy(snapshot: DataFrame, existing: DataFrame) -> DataFrame:
    """The edited copies, and for runs without one the snapshot; the machine's mark is stamped once (run_id, base, mark, machine_mark)."""
    fresh = snapshot.join(existing.select("run_id").distinct(), "run_id", "left_anti")
    both = existing.select("run_id", "base", "mark", "machine_mark").unionByName(fresh.select("run_id", "base", "mark", F.lit(None).cast("double").alias("machine_mark")))
    return both.withColumn("machine_mark", F.coalesce("machine_mark", "mark"))


def apply_corrections(state: DataFrame, decision: DataFrame) -> DataFrame:
    """As apply_decisions, but only rejections count."""
    return apply_decisions(state, decision.where("decision = 'reject'"))


def saved_evaluations(run: DataFrame) -> DataFrame:
    """One row a run (run_id, is_edited, given, read_name, saved_at): the edited copy before the snapshot, the latest of each; newest first."""
    best = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("is_edited"), F.desc("saved_at")))
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("given", "read_name")], F.lit("Unknown"))
    return run.withColumn("k", best).where("k = 1").select("run_id", name.alias("name"), "is_edited", "saved_at").orderBy(F.desc("saved_at"), "run_id")


def supersede(runs: DataFrame, replacement: DataFrame) -> DataFrame:
    """Runs that no other, successful run replaced (old_run, new_run, succeeded)."""
    gone = replacement.where("succeeded AND old_run <> new_run").select(F.col("old_run").alias("run_id"))
    return runs.join(gone, "run_id", "left_anti")
