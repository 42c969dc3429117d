"""Further registered queries: pages, re-reads, key gates, working copies and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.marks import quantize
from ..operators import grading, integrity, pages, recovery, reports, review
from . import queries as base
from .queries import query

_KEY, _PAPER = base._KEY, base._PAPER
_MARKED = "marked AS (SELECT sheet_id, exam_id, base, least(floor(raw_mark / 0.5 + 0.5 + 1e-9) * 0.5, marks_max) AS mark, marks_max, confidence, off_topic FROM result)"


def _marked(result):
    return result.select("sheet_id", "exam_id", "base", quantize(F.col("raw_mark"), F.col("marks_max")).alias("mark"), "marks_max", "confidence", "off_topic")


@query(
    "a3_choices_or_detect",
    ("choice_sidecar", "key_entry"),
    f"""WITH {_KEY}, own AS (SELECT DISTINCT exam_id, base FROM choice_sidecar),
    d AS (SELECT exam_id, base FROM key WHERE regexp_full_match(sub, '\\([^)]*\\)') GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT marks) = 1)
    SELECT exam_id, base, FALSE AS uncertain FROM own UNION ALL SELECT exam_id, base, TRUE FROM d WHERE exam_id NOT IN (SELECT exam_id FROM own)""",
)
def a3(sidecar, key_entry):
    return integrity.choices_or_detect(sidecar, integrity.detect_choices(integrity.canonical_key(key_entry)))


@query(
    "a12_pending_by_hash",
    ("page_text",),
    "SELECT page FROM page_text t WHERE NOT EXISTS (SELECT 1 FROM page_text c WHERE c.page % 3 = 0 AND coalesce(c.text, '') = coalesce(t.text, ''))",
)
def a12(page_text):
    found = page_text.select("page", F.coalesce("text", F.lit("")).alias("text"))
    cache = found.where("page % 3 = 0").select(F.sha2(F.concat_ws("\0", F.lit("1"), F.lit("large"), F.col("text")), 256).alias("cache_key")).distinct()
    return reports.pending_by_hash(found, cache, "1", "large").select("page")


@query(
    "c20_commit_reread",
    ("answer",),
    """WITH n AS (SELECT sheet_id, base, length(coalesce(answer, '')) AS was,
              CASE WHEN sheet_id % 5 = 0 AND base = 1 THEN least(length(coalesce(answer, '')), 3) ELSE length(coalesce(answer, '')) + CASE WHEN base % 2 = 0 THEN 5 ELSE 0 END END AS now FROM answer)
    SELECT sheet_id, bool_or(now < was) AS rejected, CASE WHEN bool_or(now < was) THEN '' ELSE coalesce(string_agg(CAST(base AS VARCHAR), ',' ORDER BY base) FILTER (WHERE now > was), '') END AS grown FROM n GROUP BY 1""",
)
def c20(answer):
    text = F.coalesce("answer", F.lit(""))
    again = F.when(F.expr("sheet_id % 5 = 0 AND base = 1"), F.substring(text, 1, 3)).when(F.expr("base % 2 = 0"), F.concat(text, F.lit(" more"))).otherwise(text)
    return recovery.commit_reread(answer, answer.withColumn("answer", again))


@query(
    "d13_mirror_pages",
    ("page_question",),
    "SELECT sheet_id, base, page_no FROM page_question UNION SELECT sheet_id, base + 10, page_no FROM page_question WHERE base % 3 = 1",
)
def d13(page_question):
    return pages.mirror_pages(page_question, page_question.where("base % 3 = 1").select("sheet_id", "base", (F.col("base") + 10).alias("new_base")).distinct())


@query("d14_merge_flags", ("cost_event",), "SELECT run_id AS sheet_id, CAST(1 + event_id % 7 AS INT) AS base, arg_min(stage, event_id) AS reason FROM cost_event GROUP BY 1, 2")
def d14(cost_event):
    return recovery.merge_flags(cost_event.select(F.col("run_id").alias("sheet_id"), F.expr("CAST(1 + event_id % 7 AS INT)").alias("base"), F.col("event_id").alias("layer"), F.col("stage").alias("reason")))


@query(
    "e2_text_volume",
    ("page_text",),
    """SELECT doc, page, CASE WHEN chars = 0 THEN 'error' ELSE 'warning' END AS severity, chars
    FROM (SELECT doc, page, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10))) AS chars FROM page_text) t WHERE chars < 200""",
)
def e2(page_text):
    return integrity.check_text_volume(page_text)


@query(
    "e17_align_key",
    ("answer", "paper_entry"),
    """WITH a AS (SELECT sheet_id, exam_id, CASE WHEN base % 2 = 1 THEN qid || '.1' ELSE qid END AS qid, qid AS stem FROM answer),
    al AS (SELECT sheet_id, a.exam_id, a.qid, stem, p.marks FROM a JOIN paper_entry p ON p.exam_id = a.exam_id AND p.qid = a.stem)
    SELECT sheet_id, exam_id, qid, marks, TRUE AS answered FROM al
    UNION ALL SELECT s.sheet_id, p.exam_id, p.qid, p.marks, FALSE FROM (SELECT DISTINCT sheet_id, exam_id FROM a) s JOIN paper_entry p USING (exam_id)
    WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.sheet_id = s.sheet_id AND al.stem = p.qid)""",
)
def e17(answer, paper_entry):
    asked = answer.select("sheet_id", "exam_id", F.when(F.expr("base % 2 = 1"), F.concat("qid", F.lit(".1"))).otherwise(F.col("qid")).alias("qid"))
    return integrity.align_key(asked, paper_entry.select("exam_id", "qid", "marks"))


_FOUND = "f AS (SELECT exam_id, 'Q' || base AS qid, CASE WHEN p0 % 2 = 0 THEN 'found ' || p0 ELSE 'the whole text of the question no. ' || p0 END AS found FROM key_base)"


@query(
    "e26_merge_backfill",
    ("paper_entry", "key_base"),
    f"""WITH {_FOUND}, b AS (SELECT exam_id, qid, question, found, CASE WHEN question IS NULL THEN 'installed' WHEN length(trim(question)) < 40 AND coalesce(length(trim(found)), 0) > length(trim(question)) THEN 'replaced'
        WHEN length(trim(question)) < 40 THEN 'still_thin' ELSE 'kept' END AS action FROM paper_entry FULL JOIN f USING (exam_id, qid))
    SELECT exam_id, qid, CASE WHEN action IN ('installed', 'replaced') THEN found ELSE question END AS question, action FROM b""",
)
def e26(paper_entry, key_base):
    found = F.when(F.expr("p0 % 2 = 0"), F.expr("'found ' || p0")).otherwise(F.expr("'the whole text of the question no. ' || p0"))
    return integrity.merge_backfill(paper_entry, key_base.select("exam_id", F.expr("'Q' || base").alias("qid"), found.alias("question")))


@query(
    "e27_gate",
    ("key_entry", "paper_delivered"),
    """WITH s AS (SELECT exam_id, count(*) AS total, count(*) FILTER (WHERE coalesce(marks, 0) <= 0) AS missing FROM key_entry GROUP BY 1),
    i AS (SELECT exam_id, missing * 2 >= total AS err FROM s WHERE missing > 0 UNION ALL
          SELECT DISTINCT exam_id, FALSE FROM key_entry WHERE marks > 0 AND marks * 2 <> floor(marks * 2) UNION ALL
          SELECT exam_id, TRUE FROM s WHERE exam_id NOT IN (SELECT exam_id FROM paper_delivered))
    SELECT s.exam_id, count(err) AS issues, coalesce(bool_or(err), FALSE) AS blocked FROM s LEFT JOIN i USING (exam_id) GROUP BY 1""",
)
def e27(key_entry, paper_delivered):
    return integrity.gate(integrity.check_entries(key_entry), key_entry.select("exam_id").distinct(), paper_delivered)


@query(
    "e28_marks_mode",
    ("key_entry", "choice_member", "paper_entry"),
    f"""WITH {base._CHECKED}, t AS (SELECT exam_id, bool_or(class <> 'equal') OR abs(coalesce(sum(key_marks), 0) - coalesce(sum(paper_marks), 0)) > 1e-6 AS mismatch FROM chk GROUP BY 1)
    SELECT exam_id, CASE WHEN exam_id % 5 = 0 THEN 'trust_key' WHEN NOT mismatch THEN 'raise' WHEN exam_id % 3 = 0 THEN 'align_to_paper' WHEN exam_id % 3 = 1 THEN 'trust_key' ELSE 'raise' END AS mode FROM t""",
)
def e28(*tables):
    found = base.e10(*tables).select("exam_id", "mismatch")
    source = F.when(F.expr("exam_id % 3 = 0"), "paper").when(F.expr("exam_id % 3 = 1"), "key")
    return integrity.marks_mode(found, tables[0].select("exam_id").distinct().select("exam_id", source.alias("source"), F.expr("exam_id % 5 = 0").alias("edited")))


@query("f9_failed_replies", ("result",), "SELECT sheet_id, base, CAST(0 AS DOUBLE) AS marks_awarded, marks_max, 'low' AS confidence, TRUE AS needs_review FROM result WHERE answer_chars % 4 = 0")
def f9(result):
    return grading.failed_replies(result, result.where("answer_chars % 4 <> 0"))


@query(
    "f18_orientation",
    ("page_question",),
    """SELECT sheet_id, base, max(CASE WHEN (sheet_id + page_no) % 7 = 0 THEN 'uncertain' ELSE 'rotated' END) AS action
    FROM page_question WHERE (sheet_id + page_no) % 7 = 0 OR (sheet_id + page_no) % 3 = 0 GROUP BY 1, 2""",
)
def f18(page_question):
    action = F.expr("CASE WHEN (sheet_id + page_no) % 7 = 0 THEN 'uncertain' WHEN (sheet_id + page_no) % 3 = 0 THEN 'rotated' END")
    return pages.apply_orientation(page_question, page_question.select("sheet_id", "page_no", action.alias("action")).where("action IS NOT NULL").distinct())


_DRAWN = "drawn AS (SELECT sheet_id, base FROM answer WHERE contains(answer, '[DIAGRAM:'))"


@query(
    "f20_diagram_pages",
    ("answer", "page_question"),
    f"""WITH {_DRAWN} SELECT * FROM (SELECT sheet_id, base, page_no, row_number() OVER (PARTITION BY sheet_id, base ORDER BY page_no) AS place
    FROM page_question q WHERE EXISTS (SELECT 1 FROM drawn d WHERE d.sheet_id = q.sheet_id AND d.base = q.base)) t WHERE place <= 4""",
)
def f20(answer, page_question):
    return pages.diagram_pages(answer, page_question)


@query("f21_unassessed", ("answer", "result"), f"WITH {_DRAWN} SELECT sheet_id, base FROM drawn EXCEPT SELECT sheet_id, base FROM result WHERE confidence = 'High'")
def f21(answer, result):
    return grading.unassessed_diagrams(answer.where("contains(answer, '[DIAGRAM:')"), result.where("confidence = 'High'"))


@query("f26_evidence", ("page_question",), "SELECT sheet_id, base, string_agg('crop_' || page_no, ',' ORDER BY page_no) AS files FROM page_question GROUP BY 1, 2")
def f26(page_question):
    return pages.evidence_images(page_question.select("*", F.expr("'crop_' || page_no").alias("file")))


@query("g1_page_roles", ("page_question",), "SELECT sheet_id, base, page_no, CASE WHEN page_no = min(page_no) OVER (PARTITION BY sheet_id, base) THEN 'start' ELSE 'continuation' END AS role FROM page_question")
def g1(page_question):
    return pages.page_roles(page_question)


@query(
    "g3_bands",
    ("page_question",),
    "SELECT sheet_id, page_no, base, 40 + 100 * base AS top, coalesce(lead(40 + 100 * base) OVER (PARTITION BY sheet_id, page_no ORDER BY base), 1000) AS bottom FROM page_question",
)
def g3(page_question):
    return pages.bands(page_question.withColumn("y", F.expr("40 + 100 * base")))


@query(
    "g3_continuation_bands",
    ("page_question",),
    """WITH r AS (SELECT *, page_no = min(page_no) OVER (PARTITION BY sheet_id, base) AS starts FROM page_question), a AS (SELECT sheet_id, page_no, base, 40 + 100 * base AS top FROM r WHERE starts),
    f AS (SELECT sheet_id, page_no, min(top) AS y FROM a GROUP BY 1, 2), c AS (SELECT sheet_id, page_no, min(base) AS base FROM r WHERE NOT starts GROUP BY 1, 2)
    SELECT sheet_id, page_no, base, top, coalesce(lead(top) OVER (PARTITION BY sheet_id, page_no ORDER BY base), 1000) AS bottom FROM a
    UNION ALL SELECT sheet_id, page_no, base, 0, coalesce(y, 1000) FROM c LEFT JOIN f USING (sheet_id, page_no)""",
)
def g3_continuation(page_question):
    roles = pages.page_roles(page_question)
    return pages.continuation_bands(roles.where("role = 'start'").withColumn("y", F.expr("40 + 100 * base")), roles.where("role = 'continuation'"))


@query(
    "a12_hits",
    ("page_text",),
    "SELECT t.page, length(coalesce(t.text, '')) AS parsed FROM page_text t WHERE EXISTS (SELECT 1 FROM page_text c WHERE c.page % 3 = 0 AND coalesce(c.text, '') = coalesce(t.text, ''))",
)
def a12_hits(page_text):
    found = page_text.select("page", F.coalesce("text", F.lit("")).alias("text"))
    key = F.sha2(F.concat_ws("\0", F.lit("1"), F.lit("large"), F.col("text")), 256)
    cache = found.where("page % 3 = 0").groupBy(key.alias("cache_key")).agg(F.max(F.length("text")).alias("parsed"))
    return reports.hits_by_hash(found, cache, "1", "large").select("page", "parsed")


@query("c20_targeted_reread", ("answer",), "SELECT sheet_id, FALSE AS rejected, coalesce(string_agg(CAST(base AS VARCHAR), ',' ORDER BY base) FILTER (WHERE base % 2 = 0 AND base % 3 = 0), '') AS grown FROM answer GROUP BY 1")
def c20_targeted(answer):
    again = F.when(F.expr("base % 2 = 0"), F.concat(F.coalesce("answer", F.lit("")), F.lit(" more"))).otherwise(F.coalesce("answer", F.lit("")))
    return recovery.commit_reread(answer, answer.withColumn("answer", again), answer.where("base % 3 = 0").select("sheet_id", "base"))


@query("h5_working_copy", ("result",), f"WITH {_MARKED} SELECT sheet_id AS run_id, base, CASE WHEN sheet_id % 4 = 0 AND base % 2 = 0 THEN marks_max ELSE mark END AS mark, mark AS machine_mark FROM marked m WHERE sheet_id % 4 <> 0 OR base % 2 = 0 OR NOT EXISTS (SELECT 1 FROM marked o WHERE o.sheet_id = m.sheet_id AND o.base % 2 = 0)")
def h5(result):
    marked = _marked(result).withColumnRenamed("sheet_id", "run_id")
    existing = marked.where("run_id % 4 = 0 AND base % 2 = 0").select("run_id", "base", F.col("marks_max").alias("mark"), F.col("mark").alias("machine_mark"))
    return review.working_copy(marked, existing)


_STATE = f"""{_MARKED}, d AS (SELECT review_id, base, arg_max(corrected_marks, seq) AS corrected FROM decision WHERE decision = 'reject' GROUP BY 1, 2)"""


@query(
    "h8_apply_corrections",
    ("result", "decision"),
    f"""WITH {_STATE} SELECT sheet_id AS review_id, m.base, mark AS machine_mark, marks_max, CASE WHEN d.review_id IS NULL THEN mark ELSE least(floor(greatest(corrected, 0) / 0.5 + 0.5 + 1e-9) * 0.5, marks_max) END AS mark,
    d.review_id IS NOT NULL AS rejected, d.review_id IS NOT NULL AS reviewed FROM marked m LEFT JOIN d ON d.review_id = m.sheet_id AND d.base = m.base""",
)
def h8(result, decision):
    state = _marked(result).select(F.col("sheet_id").alias("review_id"), "base", F.col("mark").alias("machine_mark"), "marks_max")
    return review.apply_corrections(state, decision)


@query(
    "h10_saved_evaluations",
    ("cost_event",),
    """WITH r AS (SELECT run_id, stage = 'purchase' AS is_edited, CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Given ' || run_id END AS given, CASE WHEN event_id % 2 = 0 THEN 'Read ' || run_id END AS read_name, event_id AS saved_at FROM cost_event)
    SELECT run_id, coalesce(nullif(trim(given), ''), nullif(trim(read_name), ''), 'Unknown') AS name, is_edited, saved_at
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY is_edited DESC, saved_at DESC) AS k FROM r) t WHERE k = 1""",
)
def h10(cost_event):
    given = F.expr("CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'Given ' || run_id END")
    run = cost_event.select("run_id", F.expr("stage = 'purchase'").alias("is_edited"), given.alias("given"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'Read ' || run_id END").alias("read_name"), F.col("event_id").alias("saved_at"))
    return review.saved_evaluations(run)


@query("h11_supersede", ("sheet",), "SELECT sheet_id AS run_id, student FROM sheet WHERE NOT (sheet_id % 3 = 0 AND sheet_id % 2 = 0 AND sheet_id % 4 <> 0)")
def h11(sheet):
    replaced = sheet.where("sheet_id % 3 = 0").select(F.col("sheet_id").alias("old_run"), F.expr("sheet_id + sheet_id % 4").alias("new_run"), F.expr("sheet_id % 2 = 0").alias("succeeded"))
    return review.supersede(sheet.select(F.col("sheet_id").alias("run_id"), "student"), replaced)


@query("i3_timing_by_stage", ("stage_timing",), "SELECT run_id, stage, sum(seconds) AS seconds, count(*) AS times FROM stage_timing GROUP BY ROLLUP (run_id, stage) HAVING run_id IS NOT NULL")
def i3(timing):
    return reports.timing_by_stage(timing)


@query(
    "i4_stage_overruns",
    ("stage_timing",),
    """SELECT * FROM (SELECT run_id, stage, seconds, event_id, CAST(CASE stage WHEN 'click' THEN 500 WHEN 'view' THEN 800 ELSE 1200 END AS DOUBLE) AS ceiling FROM stage_timing) t WHERE seconds > ceiling""",
)
def i4(timing):
    ceilings = timing.where("stage IN ('click', 'view')").select("stage").distinct().withColumn("ceiling", F.when(F.col("stage") == "click", 500.0).otherwise(800.0))
    return reports.stage_overruns(timing, ceilings)


@query(
    "i5_batch_summary",
    ("sheet", "result"),
    f"""WITH {_MARKED}, m AS (SELECT sheet_id, round(sum(mark), 2) AS awarded, round(sum(marks_max), 2) AS maximum FROM marked WHERE sheet_id IN (SELECT sheet_id FROM sheet WHERE NOT run_failed) GROUP BY 1)
    SELECT sheet_id, student, awarded, maximum, CASE WHEN awarded IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN sheet_id % 3 <> 0 THEN CAST(sheet_id AS DOUBLE) END AS cost FROM sheet LEFT JOIN m USING (sheet_id)""",
)
def i5(sheet, result):
    spent = F.when(F.expr("sheet_id % 3 = 0"), "unknown").otherwise(F.concat(F.lit("$"), F.col("sheet_id").cast("string")))
    return reports.batch_summary(sheet, _marked(result).join(sheet.where("NOT run_failed"), "sheet_id", "left_semi"), sheet.select("sheet_id", spent.alias("spent")))


@query(
    "i10_agreement",
    ("result",),
    f"""WITH {_MARKED}, t AS (SELECT *, CASE WHEN base % 3 = 0 THEN greatest(mark - 0.5, 0) ELSE mark END AS teacher FROM marked)
    SELECT confidence, count(*) AS questions, sum(mark) AS total, sum(teacher) AS teacher_total, round(avg(abs(mark - teacher)), 6) AS mean_error, round(avg(CASE WHEN mark = teacher THEN 1.0 ELSE 0.0 END), 6) AS equal FROM t GROUP BY 1""",
)
def i10(result):
    marked = _marked(result)
    teacher = F.when(F.expr("base % 3 = 0"), F.greatest(F.col("mark") - 0.5, F.lit(0.0))).otherwise(F.col("mark"))
    return reports.agreement(marked, marked.select("sheet_id", "base", teacher.alias("teacher_mark")), "confidence")


@query(
    "i11_escalation_mix",
    ("result",),
    f"""WITH {_MARKED} SELECT CASE WHEN confidence = 'Low' THEN 'low_confidence' WHEN off_topic THEN 'off_topic' WHEN mark <= 0 THEN 'substantive_zero' ELSE 'none' END AS reason, count(*) AS n,
    round(avg(CASE WHEN base % 2 = 0 THEN marks_max ELSE mark END - mark), 6) AS drift FROM marked GROUP BY 1""",
)
def i11(result):
    reason = F.when(F.col("confidence") == "Low", "low_confidence").when(F.col("off_topic"), "off_topic").when(F.col("mark") <= 0, "substantive_zero").otherwise("none")
    deep = F.when(F.expr("base % 2 = 0"), F.col("marks_max")).otherwise(F.col("mark"))
    return reports.escalation_mix(_marked(result).select(reason.alias("reason"), F.col("mark").alias("fast_mark"), deep.alias("deep_mark")))
