"""Key against paper: marks, choices, gaps, sections and reconciliation. Keys carry exam_id, so one job serves all exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_under, sub_part, with_qid
from ..functions.marks import is_valid_mark

TOLERANCE = 1e-6


def canonical_key(key_entry: DataFrame) -> DataFrame:
    """key_entry with qid, base and sub, null marks as 0."""
    return with_qid(key_entry, "label").withColumn("marks", F.coalesce(F.col("marks").try_cast("double"), F.lit(0.0)))


def check_entries(entry: DataFrame, exams: DataFrame | None = None) -> DataFrame:
    """Missing marks (an error from half of the entries on) and marks off the half-mark grid: exam_id, severity, code, n.

    Of ``exams`` (exam_id), if given, those without any entry are an error.
    """
    usable = F.coalesce(F.col("marks").try_cast("double"), F.lit(0.0))
    found = entry.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(usable <= 0).alias("missing"), F.count_if((usable > 0) & ~is_valid_mark(usable)).alias("off_grid")
    )
    rows = F.array(
        F.struct(F.when(F.col("missing") * 2 >= F.col("total"), "error").otherwise("warning").alias("severity"), F.lit("marks_missing").alias("code"), F.col("missing").alias("n")),
        F.struct(F.lit("warning").alias("severity"), F.lit("marks_off_grid").alias("code"), F.col("off_grid").alias("n")),
    )
    issues = found.select("exam_id", F.inline(rows)).where("n > 0")
    if exams is None:
        return issues
    empty = exams.select("exam_id").distinct().join(entry, "exam_id", "left_anti")
    return issues.unionByName(empty.select("exam_id", F.lit("error").alias("severity"), F.lit("no_questions").alias("code"), F.lit(0).cast("long").alias("n")))


def paper_marks(paper_entry: DataFrame) -> DataFrame:
    return with_qid(paper_entry, "qid").groupBy("exam_id", "base").agg(F.max("marks").alias("marks"))


def paper_question(paper_entry: DataFrame) -> DataFrame:
    """Question text of a base: the stem before sub-parts, then the longer, then the first."""
    rank = F.struct(~F.col("has_sub"), F.length("question"), -F.col("qorder"))
    return with_qid(paper_entry, "qid").groupBy("exam_id", "base").agg(F.max_by("question", rank).alias("question"))


def key_leaves(key_entry: DataFrame) -> DataFrame:
    return canonical_key(key_entry).where("marks > 0").select("exam_id", "base", "sub", "qid", "marks", "qorder")


def effective_marks(leaves: DataFrame, members: DataFrame) -> DataFrame:
    """Marks of a base with a choice: leaves under no member, plus the best member's; a plain sum below two resolved members."""
    member = members.select("exam_id", "base", "pos", sub_part(F.col("member")).alias("member_sub"))
    owned = leaves.join(member, ["exam_id", "base"], "left").where(F.col("member_sub").isNull() | is_under(F.col("sub"), F.col("member_sub")))
    owner = owned.where("member_sub IS NOT NULL").groupBy("exam_id", "base", "qid").agg(F.min("pos").alias("pos"))
    sums = leaves.join(owner, ["exam_id", "base", "qid"], "left").groupBy("exam_id", "base", "pos").agg(F.sum("marks").alias("marks"))
    return sums.groupBy("exam_id", "base").agg(
        F.when(
            F.count("pos") >= 2,
            F.coalesce(F.sum(F.when(F.col("pos").isNull(), F.col("marks"))), F.lit(0.0)) + F.max(F.when(F.col("pos").isNotNull(), F.col("marks"))),
        ).otherwise(F.sum("marks")).alias("marks")
    )


def lost_choices(leaves: DataFrame, members: DataFrame) -> DataFrame:
    """Bases with two or more top alternatives in exams that have no choice group at all."""
    top = F.regexp_extract("sub", "^(\\([^)]*\\)|\\.[A-Za-z0-9]+)", 1)
    none = leaves.join(members.select("exam_id").distinct(), "exam_id", "left_anti")
    return none.where(top != "").groupBy("exam_id", "base").agg(F.countDistinct(top).alias("alternatives")).where("alternatives >= 2")


def cross_check(key_marks: DataFrame, paper: DataFrame) -> DataFrame:
    """Per base: missing from the key, unknown to the paper, under or over the paper's marks, or equal."""
    k, p = key_marks.select("exam_id", "base", F.col("marks").alias("key_marks")), paper.select("exam_id", "base", F.col("marks").alias("paper_marks"))
    kind = (
        F.when(F.col("key_marks").isNull(), "missing").when(F.col("paper_marks").isNull(), "unknown")
        .when(F.col("paper_marks") - F.col("key_marks") > TOLERANCE, "under").when(F.col("key_marks") - F.col("paper_marks") > TOLERANCE, "over").otherwise("equal")
    )
    return k.join(p, ["exam_id", "base"], "full").withColumn("class", kind)


def cross_check_issues(checked: DataFrame, shown: int = 12) -> DataFrame:
    """exam_id, class, n and the first bases of each class but equal, and total_mismatch; nothing for exams whose paper has no marks."""
    whole = Window.partitionBy("exam_id")
    of_paper = checked.withColumn("known", F.count("paper_marks").over(whole)).where("known > 0")
    found = of_paper.where("class <> 'equal'").groupBy("exam_id", "class").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("base")).alias("bases"))
    totals = of_paper.groupBy("exam_id").agg(F.abs(F.coalesce(F.sum("key_marks"), F.lit(0.0)) - F.coalesce(F.sum("paper_marks"), F.lit(0.0))).alias("apart"))
    total = totals.where(F.col("apart") > TOLERANCE).select("exam_id", F.lit("total_mismatch").alias("class"), F.lit(1).cast("long").alias("n"), F.lit("").alias("bases"))
    return found.select("exam_id", "class", "n", F.array_join(F.slice("bases", 1, shown).cast("array<string>"), ",").alias("bases")).unionByName(total)


def marks_mismatch(checked: DataFrame, shown: int = 60) -> DataFrame:
    """Per exam: both totals, how many questions differ and the first of them, whether anything differs, and which source to trust."""
    differing = F.array_sort(F.collect_list(F.when(F.col("class") != "equal", F.col("base"))))
    sums = checked.groupBy("exam_id").agg(
        F.coalesce(F.sum("key_marks"), F.lit(0.0)).alias("key_total"), F.coalesce(F.sum("paper_marks"), F.lit(0.0)).alias("paper_total"),
        F.count_if(F.col("class") != "equal").alias("differing"), differing.alias("which"), F.count("paper_marks").alias("known"),
    )
    return sums.select(
        "exam_id", "key_total", "paper_total", "differing",
        ((F.col("differing") > 0) | (F.abs(F.col("key_total") - F.col("paper_total")) > TOLERANCE)).alias("mismatch"),
        F.when(F.col("known") == 0, "answer_key").otherwise("question_paper").alias("recommended"),
        F.array_join(F.transform(F.slice("which", 1, shown), lambda b: F.concat(F.lit("Q"), b)), ",").alias("questions"),
    )


def numbering_gaps(paper_entry: DataFrame) -> DataFrame:
    """Runs of numbers (exam_id, kind, lo, hi) that no question has: leading, before the smallest, and internal ones."""
    bases = with_qid(paper_entry, "qid").where("base IS NOT NULL").select("exam_id", "base").distinct()
    order = Window.partitionBy("exam_id").orderBy("base")
    before = F.coalesce(F.lag("base").over(order), F.lit(0))
    gaps = bases.select("exam_id", "base", before.alias("before")).where("base - before > 1")
    kind = F.when(F.col("before") == 0, "leading").otherwise("internal")
    return gaps.select("exam_id", kind.alias("kind"), (F.col("before") + 1).alias("lo"), (F.col("base") - 1).alias("hi"))


def expected_questions(section_map: DataFrame, exam_text: DataFrame | None = None) -> DataFrame:
    """(exam_id, top): the sections' end, or else the N of "contains N questions" in the exam's text."""
    top = section_map.groupBy("exam_id").agg(F.max("to_q").alias("top"))
    if exam_text is None:
        return top
    said = F.regexp_extract("text", r"(?i)contains\s+([0-9]+)\s+questions", 1).try_cast("int")
    rest = exam_text.select("exam_id", said.alias("top")).where("top IS NOT NULL").join(top, "exam_id", "left_anti")
    return top.unionByName(rest.groupBy("exam_id").agg(F.max("top").alias("top")))


def missing_ranges(paper_entry: DataFrame, section_map: DataFrame, exam_text: DataFrame | None = None) -> DataFrame:
    """Runs (lo, hi) of numbers from 1 to the expected end that no question has, found from neighbours."""
    expected = expected_questions(section_map, exam_text)
    bases = with_qid(paper_entry, "qid").where("base > 0").select("exam_id", "base").distinct()
    inside = bases.join(expected, "exam_id").where("base <= top").select("exam_id", "base")
    ends = expected.select("exam_id", F.explode(F.array(F.lit(0), F.col("top") + 1)).alias("base"))
    after = F.lead("base").over(Window.partitionBy("exam_id").orderBy("base"))
    gaps = inside.unionByName(ends).withColumn("after", after).where("after - base > 1")
    return gaps.select("exam_id", (F.col("base") + 1).alias("lo"), (F.col("after") - 1).alias("hi"))


def detect_choices(key: DataFrame) -> DataFrame:
    """Sibling sub-parts (x) of equal marks are taken for a choice: exam_id, base, members. All of them are uncertain."""
    sibling = key.where(F.col("sub").rlike("^\\([^)]*\\)$"))
    return sibling.groupBy("exam_id", "base").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("marks").alias("kinds")).where("members >= 2 AND kinds = 1").drop("kinds")


def choice_members(key: DataFrame) -> DataFrame:
    """(exam_id, base, group_no, parent, members, required) of the groups that detect_choices() finds, their ids in key order; one of them is to be answered."""
    found = detect_choices(key).select("exam_id", "base")
    siblings = key.where(F.col("sub").rlike("^\\([^)]*\\)$")).join(found, ["exam_id", "base"], "left_semi")
    members = F.transform(F.array_sort(F.collect_list(F.struct("qorder", "qid"))), lambda x: x["qid"])
    groups = siblings.groupBy("exam_id", "base").agg(members.alias("members"))
    number = F.row_number().over(Window.partitionBy("exam_id").orderBy("base")) - 1
    return groups.select("exam_id", "base", number.alias("group_no"), F.concat(F.lit("Q"), F.col("base").cast("string")).alias("parent"), "members", F.lit(1).alias("required"))


def inline_choices(key: DataFrame) -> DataFrame:
    """(exam_id, qid): entries outside detected groups with a standalone OR, in capitals, in their question or answer; uncertain as well."""
    sibling = F.col("sub").rlike("^\\([^)]*\\)$")
    grouped = detect_choices(key).select("exam_id", "base", F.lit(True).alias("grouped"))
    text = F.concat_ws("\n", "question", "answer")
    rows = key.join(grouped, ["exam_id", "base"], "left").where(~(F.coalesce("grouped", F.lit(False)) & sibling))
    return rows.where(text.rlike(r"(?:^|\s)OR(?:\s|$)")).select("exam_id", "qid")


def overlay_questions(key: DataFrame, paper_entry: DataFrame) -> DataFrame:
    """Question text for key entries: of the exact id (the last), else of the base (the first); only non-empty text."""
    paper = with_qid(paper_entry.withColumnRenamed("qid", "paper_id"), "paper_id").where("question <> ''")
    exact = paper.groupBy("exam_id", "qid").agg(F.max_by("question", "qorder").alias("exact"))
    by_base = paper.groupBy("exam_id", "base").agg(F.min_by("question", "qorder").alias("by_base"))
    return key.join(exact, ["exam_id", "qid"], "left").join(by_base, ["exam_id", "base"], "left").withColumn("question", F.coalesce("exact", "by_base")).drop("exact", "by_base")


def section_overlay(paper_entry: DataFrame, section_map: DataFrame) -> DataFrame:
    """The first section (by start) that holds the base sets its marks; exam_id, qid, old and new marks, changed."""
    paper = with_qid(paper_entry, "qid").select("exam_id", "qid", "base", "marks")
    inside = paper.join(section_map, "exam_id").where(F.col("base").between(F.col("from_q"), F.col("to_q")))
    first = inside.groupBy("exam_id", "qid").agg(F.min_by("section_marks", "from_q").alias("section_marks"))
    new = F.coalesce("section_marks", "marks")
    return paper.join(first, ["exam_id", "qid"], "left").select("exam_id", "qid", F.col("marks").alias("old_marks"), new.alias("marks"), (F.abs(new - F.col("marks")) > 1e-9).alias("changed"))


def thin_questions(paper_entry: DataFrame, section_map: DataFrame, marks: float = 3.0, chars: int = 40) -> DataFrame:
    paper = with_qid(paper_entry, "qid")
    first = paper.join(section_map, "exam_id").where(F.col("base").between(F.col("from_q"), F.col("to_q"))).groupBy("exam_id", "qid").agg(
        F.min_by("section_marks", "from_q").alias("section_marks"), F.max(F.length(F.trim("question"))).alias("chars")
    )
    return first.where((F.col("section_marks") >= marks) & (F.col("chars") < chars))


def reconcile_marks(key: DataFrame, paper: DataFrame, modes: DataFrame) -> DataFrame:
    """Key entries (exam_id, qid, base, marks) held against the paper's marks by base.

    ``modes`` has exam_id and mode: raise, align_to_paper or trust_key. Result: exam_id, qid, old_marks,
    marks, action. A single entry below the paper is raised, one above lowered in align mode only; several
    entries, and questions that the paper lacks, are flagged; questions that the key lacks are injected.
    """
    per_base = Window.partitionBy("exam_id", "base")
    entries = key.select("exam_id", "qid", "base", "marks").withColumns({"n": F.count(F.lit(1)).over(per_base), "key_sum": F.sum("marks").over(per_base)})
    joined = entries.join(paper.select("exam_id", "base", F.col("marks").alias("paper_marks")), ["exam_id", "base"], "full").join(modes, "exam_id", "left")
    short, over = F.col("paper_marks") - F.col("key_sum") > TOLERANCE, F.col("key_sum") - F.col("paper_marks") > TOLERANCE
    action = (
        F.when(F.coalesce("mode", F.lit("raise")) == "trust_key", F.when(F.col("qid").isNotNull(), "unchanged"))
        .when(F.col("qid").isNull(), "injected").when(F.col("paper_marks").isNull(), "flagged")
        .when(short, F.when(F.col("n") == 1, "adjusted").otherwise("flagged"))
        .when(over, F.when((F.col("n") == 1) & (F.col("mode") == "align_to_paper"), "adjusted").otherwise("flagged"))
        .otherwise("unchanged")
    )
    return joined.withColumn("action", action).where("action IS NOT NULL").select(
        "exam_id",
        F.coalesce("qid", F.concat(F.lit("Q"), F.col("base"))).alias("qid"),
        F.coalesce("marks", F.lit(0.0)).alias("old_marks"),
        F.when(F.col("action").isin("adjusted", "injected"), F.col("paper_marks")).otherwise(F.col("marks")).alias("marks"),
        "action",
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Per exam the key's total before and after reconciliation, and how many entries were adjusted, injected and flagged."""
    return reconciled.groupBy("exam_id").agg(
        F.sum("old_marks").alias("total_before"), F.sum("marks").alias("total_after"), *[F.count_if(F.col("action") == a).alias(a) for a in ("adjusted", "injected", "flagged")]
    )


def choices_or_detect(sidecar: DataFrame, detected: DataFrame) -> DataFrame:
    """Groups (exam_id, base): an exam's own where it has any, else the detected ones, which are uncertain."""
    own = sidecar.select("exam_id", "base").distinct()
    rest = detected.select("exam_id", "base").join(own.select("exam_id"), "exam_id", "left_anti")
    return own.withColumn("uncertain", F.lit(False)).unionByName(rest.withColumn("uncertain", F.lit(True)))


def check_text_volume(doc_text: DataFrame, least: int = 200) -> DataFrame:
    """Documents (doc, page, text) without text are errors, those with little are warnings."""
    chars = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")))
    severity = F.when(chars == 0, "error").when(chars < least, "warning")
    return doc_text.select("doc", "page", severity.alias("severity"), chars.alias("chars")).where("severity IS NOT NULL")


def align_key(answer: DataFrame, key: DataFrame) -> DataFrame:
    """Each answer's key entry, by its id or else by the part before the first dot; then the entries that no answer took.

    answer (sheet_id, exam_id, qid), key (exam_id, qid, marks); an entry whose id is the base of an aligned one isn't appended.
    """
    stem = F.substring_index("qid", ".", 1)
    asked = answer.select("sheet_id", "exam_id", "qid", stem.alias("stem"))
    exact = key.select("exam_id", "qid", F.col("marks").alias("own"))
    by_stem = key.select("exam_id", F.col("qid").alias("stem"), F.col("marks").alias("of_stem"))
    aligned = asked.join(exact, ["exam_id", "qid"], "left").join(by_stem, ["exam_id", "stem"], "left").where("own IS NOT NULL OR of_stem IS NOT NULL")
    taken = aligned.select("sheet_id", F.explode(F.array("qid", "stem")).alias("qid"))
    every = answer.select("sheet_id", "exam_id").distinct().join(key, "exam_id").select("sheet_id", "exam_id", "qid", "marks")
    rest = every.join(taken, ["sheet_id", "qid"], "left_anti").select("sheet_id", "exam_id", "qid", "marks", F.lit(False).alias("answered"))
    return aligned.select("sheet_id", "exam_id", "qid", F.coalesce("own", "of_stem").alias("marks"), F.lit(True).alias("answered")).unionByName(rest)


def merge_backfill(paper_entry: DataFrame, recovered: DataFrame, thin: int = 40) -> DataFrame:
    """Missing questions are installed; thin ones are replaced, by longer texts only (exam_id, qid, question)."""
    old, new = (F.length(F.trim(F.coalesce(c, F.lit("")))) for c in ("question", "found"))
    both = paper_entry.select("exam_id", "qid", "question").join(recovered.select("exam_id", "qid", F.col("question").alias("found")), ["exam_id", "qid"], "full")
    action = F.when(F.col("question").isNull(), "installed").when((old < thin) & (new > old), "replaced").when(old < thin, "still_thin").otherwise("kept")
    return both.withColumn("action", action).select("exam_id", "qid", F.when(F.col("action").isin("installed", "replaced"), F.col("found")).otherwise(F.col("question")).alias("question"), "action")


def gate(issue: DataFrame, exams: DataFrame, paper_entry: DataFrame) -> DataFrame:
    """Per exam: its issues (exam_id, severity, code), a missing paper counted as an error, and whether any error blocks it."""
    without = exams.join(paper_entry, "exam_id", "left_anti").select("exam_id", F.lit("error").alias("severity"), F.lit("no_paper").alias("code"))
    found = issue.select("exam_id", "severity", "code").unionByName(without)
    counted = found.groupBy("exam_id").agg(F.count(F.lit(1)).alias("issues"), F.bool_or(F.col("severity") == "error").alias("blocked"))
    return exams.join(counted, "exam_id", "left").select("exam_id", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def marks_mode(mismatch: DataFrame, choice: DataFrame) -> DataFrame:
    """The mode of each exam (exam_id, mismatch) after the teacher's choice (exam_id, source, edited); an edit confirms the key."""
    by_source = F.when(F.col("source") == "paper", "align_to_paper").when(F.col("source") == "key", "trust_key").otherwise("raise")
    mode = F.when(F.coalesce("edited", F.lit(False)), "trust_key").when(F.col("mismatch"), by_source).otherwise("raise")
    return mismatch.join(choice, "exam_id", "left").select("exam_id", mode.alias("mode"))
