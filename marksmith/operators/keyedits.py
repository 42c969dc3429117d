"""The teacher's view of a key's marks: breakdown, suggested choices, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_number, canonical_id, is_under, sub_part, sub_tokens
from ..functions.marks import quantize
from .integrity import TOLERANCE, effective_marks


def suggest_choices(leaves: DataFrame, members: DataFrame, paper: DataFrame) -> DataFrame:
    """Bases without a group whose marks, with the top alternatives taken for a choice, come down exactly to the paper's.

    (exam_id, base, paper, current_sum, members): members in order, joined by commas.
    """
    open_bases = leaves.join(members.select("exam_id", "base").distinct(), ["exam_id", "base"], "left_anti")
    topped = open_bases.withColumn("top", F.get(sub_tokens(F.col("sub")), F.lit(0)))
    alternatives = topped.where("top IS NOT NULL").select("exam_id", "base", F.concat(F.lit("Q"), "base", "top").alias("member")).distinct()
    ranked = alternatives.withColumn("pos", F.row_number().over(Window.partitionBy("exam_id", "base").orderBy("member")))
    listed = alternatives.groupBy("exam_id", "base").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"), F.count(F.lit(1)).alias("n"))
    collapsed = effective_marks(open_bases, ranked).withColumnRenamed("marks", "collapsed")
    now = open_bases.groupBy("exam_id", "base").agg(F.sum("marks").alias("current_sum"))
    joined = now.join(collapsed, ["exam_id", "base"]).join(listed.where("n >= 2"), ["exam_id", "base"]).join(paper.withColumnRenamed("marks", "paper"), ["exam_id", "base"])
    inflated = (F.col("current_sum") - F.col("paper") > TOLERANCE) & (F.col("current_sum") - F.col("collapsed") > TOLERANCE)
    return joined.where(inflated & (F.abs(F.col("collapsed") - F.col("paper")) <= TOLERANCE)).select("exam_id", "base", "paper", "current_sum", "members")


def marks_breakdown(key: DataFrame, members: DataFrame, paper: DataFrame, question: DataFrame) -> DataFrame:
    """One row per key entry: its marks, the paper's and its question, the choice group that it is in, and the answer's beginning.

    members (exam_id, base, group_no, pos, member): the group of a member that is the entry itself comes before that of
    the first member that it stands under.
    """
    member = members.select("exam_id", "base", "group_no", "pos", sub_part(F.col("member")).alias("member_sub"))
    exact = F.col("sub") == F.col("member_sub")
    owned = key.select("exam_id", "base", "qid", "sub").join(member, ["exam_id", "base"]).where(is_under(F.col("sub"), F.col("member_sub")))
    group = owned.groupBy("exam_id", "qid").agg(F.min_by("group_no", F.struct(~exact, F.col("group_no"), F.col("pos"))).alias("group_no"))
    rows = key.join(group, ["exam_id", "qid"], "left").join(paper.withColumnRenamed("marks", "paper_marks"), ["exam_id", "base"], "left")
    rows = rows.join(question.withColumnRenamed("question", "paper_question"), ["exam_id", "base"], "left")
    return rows.select(
        "exam_id", "qid", "base", F.col("marks").alias("key_marks"), "paper_marks", F.substring(F.coalesce("paper_question", F.lit("")), 1, 300).alias("question"),
        "group_no", F.substring(F.coalesce("answer", F.lit("")), 1, 80).alias("answer_preview"),
    )


NOTE = "Added by the teacher; no expected answer was provided, so grade the student's response to this question manually."


def apply_key_edits(key: DataFrame, edits: DataFrame) -> DataFrame:
    """A key (exam_id, qid, marks, answer) after edits (exam_id, seq, action, label, marks, answer).

    remove takes an entry away, marks sets those of an entry that is there (on the half-mark grid), add puts in an entry
    under its canonical id, the last one counting; one without an answer is to be marked by hand.
    """
    mark = F.col("new_marks").try_cast("double")
    asked = edits.select("exam_id", "seq", "action", "label", F.col("marks").alias("new_marks"), F.trim(F.coalesce("answer", F.lit(""))).alias("new_answer"))
    removed = asked.where("action = 'remove'").select("exam_id", F.col("label").alias("qid"))
    left = key.select("exam_id", "qid", "marks", "answer").join(removed, ["exam_id", "qid"], "left_anti")
    set_marks = asked.where(F.expr("action = 'marks'") & mark.isNotNull()).groupBy("exam_id", F.col("label").alias("qid")).agg(F.max_by(quantize(F.col("new_marks")), "seq").alias("set_to"))
    changed = left.join(set_marks, ["exam_id", "qid"], "left").select("exam_id", "qid", F.coalesce("set_to", "marks").alias("marks"), "answer")
    added = asked.where("action = 'add' AND trim(label) <> ''").withColumn("qid", canonical_id(F.trim("label"))).groupBy("exam_id", "qid").agg(
        F.max_by(quantize(F.col("new_marks")), "seq").alias("marks"), F.max_by("new_answer", "seq").alias("answer")
    )
    old = changed.join(added, ["exam_id", "qid"], "left_anti").withColumn("teacher_added", F.lit(False))
    both = old.unionByName(added.withColumn("teacher_added", F.lit(True)))
    by_hand = F.col("teacher_added") & (F.col("answer") == "")
    return both.withColumns({"key_parse_missing": by_hand, "reconcile_note": F.when(by_hand, NOTE)})


#: Within one event the teacher's changes count in this order.
_ACTIONS = ("remove", "marks", "add")


def since_reset(edits: DataFrame) -> DataFrame:
    """The rows of an edit log (exam_id, seq, action, ..) that come after the last reset of their exam."""
    last = edits.where("action = 'reset'").groupBy("exam_id").agg(F.max("seq").alias("_reset"))
    return edits.where("action <> 'reset'").join(last, "exam_id", "left").where("_reset IS NULL OR seq > _reset").drop("_reset")


def replay_edits(key: DataFrame, choice_group: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, choice groups) after a log of edits: key (exam_id, qid, marks, answer) and choice_group (exam_id, group_no, parent, members) as they were parsed.

    edits (exam_id, seq, action, label, marks, answer, groups): events in order of seq, each with any number of rows. remove takes an entry away, marks sets those of an entry that is there at that time
    (on the half-mark grid), add puts one in under its canonical id, in place of an earlier one; groups (an array of groups of ids) takes the place of all the exam's groups,
    and the last one counts; reset goes back to what was parsed. Each entry's events are folded in order, so an exam with many edits isn't one group.
    """
    log = since_reset(edits)
    id_ = F.when(F.col("action") == "add", canonical_id(F.trim("label"))).otherwise(F.col("label"))
    rank = F.array_position(F.array(*[F.lit(a) for a in _ACTIONS]), F.col("action"))
    event = F.struct("seq", rank.alias("rank"), "action", quantize(F.col("marks")).alias("marks"), F.col("marks").try_cast("double").isNotNull().alias("valid"), F.trim(F.coalesce("answer", F.lit(""))).alias("answer"))
    events = log.where(F.col("action").isin(*_ACTIONS) & (F.trim("label") != "")).groupBy("exam_id", id_.alias("qid")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    parsed = key.select("exam_id", "qid", F.struct(F.lit(True).alias("there"), F.col("marks").cast("double").alias("marks"), "answer", F.lit(False).alias("added")).alias("start"))
    absent = F.struct(F.lit(False).alias("there"), F.lit(None).cast("double").alias("marks"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("added"))

    def step(acc, e):
        gone = F.struct(F.lit(False).alias("there"), acc["marks"].alias("marks"), acc["answer"].alias("answer"), F.lit(False).alias("added"))
        marked = F.struct(acc["there"].alias("there"), e["marks"].alias("marks"), acc["answer"].alias("answer"), acc["added"].alias("added"))
        put = F.struct(F.lit(True).alias("there"), F.when(e["valid"], e["marks"]).otherwise(F.lit(0.0)).alias("marks"), e["answer"].alias("answer"), F.lit(True).alias("added"))
        return F.when(e["action"] == "remove", gone).when(e["action"] == "add", put).when(acc["there"] & e["valid"], marked).otherwise(acc)

    both = parsed.join(events, ["exam_id", "qid"], "full").withColumns({"start": F.coalesce("start", absent), "events": F.coalesce("events", F.expr("array()").cast(events.schema["events"].dataType))})
    folded = both.withColumn("s", F.aggregate("events", F.col("start"), step)).where("s.there")
    by_hand = F.col("teacher_added") & (F.col("answer") == "")
    new_key = folded.select("exam_id", "qid", "s.marks", "s.answer", F.col("s.added").alias("teacher_added")).withColumns({"key_parse_missing": by_hand, "reconcile_note": F.when(by_hand, NOTE)})
    chosen = log.where("action = 'groups'").groupBy("exam_id").agg(F.max_by("groups", "seq").alias("groups"))
    listed = chosen.select("exam_id", F.posexplode(F.filter("groups", lambda g: F.size(g) > 0)).alias("group_no", "members"))
    kept = choice_group.select("exam_id", "group_no", "parent", "members").join(chosen.select("exam_id"), "exam_id", "left_anti")
    return new_key, kept.unionByName(collapse_members(listed))


def marks_choice(edits: DataFrame) -> DataFrame:
    """(exam_id, source, edited) from an edit log: whether anything was edited since the last reset, and the last source that was chosen since (action source, label paper or key)."""
    log = since_reset(edits)
    source = F.max_by("label", F.when(F.col("action") == "source", F.col("seq")))
    exams = edits.select("exam_id").distinct()
    found = log.groupBy("exam_id").agg(source.alias("source"), F.bool_or(F.col("action") != "source").alias("edited"))
    return exams.join(found, "exam_id", "left").select("exam_id", "source", F.coalesce("edited", F.lit(False)).alias("edited"))


def collapse_members(selection: DataFrame) -> DataFrame:
    """(exam_id, group_no, parent, members) of the entries that a teacher ticked (exam_id, group_no, members).

    The alternatives are the beginnings at the shallowest depth, of one to four pieces, at which two differ; members stay
    as they are where an id has no number or they never part.
    """
    first_seen = lambda depth: F.array_distinct(
        F.transform("members", lambda m: F.concat(F.lit("Q"), base_number(m), F.array_join(F.slice(sub_tokens(sub_part(m)), 1, depth), "")))
    )
    odd = F.exists("members", lambda m: base_number(m).isNull()) | (F.size("members") < 2)
    collapsed = F.when(odd, F.col("members"))
    for depth in (1, 2, 3, 4):
        collapsed = collapsed.when(F.size(first_seen(depth)) >= 2, first_seen(depth))
    base = base_number(F.get("members", F.lit(0)))
    return selection.select("exam_id", "group_no", F.when(base.isNotNull(), F.concat(F.lit("Q"), base)).alias("parent"), collapsed.otherwise(F.col("members")).alias("members"))
