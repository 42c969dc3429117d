"""Which way up a page was read best: scores of its readings at several rotations, and the rules that choose among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import base_number

#: Rotations in the order in which they are tried, and the rules' margins.
TRIED = (180, 90, 270)
LEAST_OUT_OF_SET, SKIP_WORDS, WORD_GAIN, LEAST_WORDS, LEGIBILITY_GAIN = 2, 12, 4, 6, 0.15
PAGE = ("sheet_id", "page_no")


def page_quality(reading: DataFrame, question_set: DataFrame, wordlist: DataFrame) -> DataFrame:
    """Scores of readings (sheet_id, exam_id, page_no, rotation, text): in_set, out_of_set, legibility, dict_words and readability.

    Tags count by the exam's question set (exam_id, base), none without one; words by the list (word), both after tags are taken out.
    """
    each = (*PAGE, "rotation")
    text = F.coalesce("text", F.lit(""))
    tags = F.regexp_extract_all(text, F.lit(r"\[START_Q:[ \t]*([^\]\n]*)\]"), 1)
    body = F.regexp_replace(text, r"\[[^\]]*\]", " ")
    compact = F.regexp_replace(body, r"\s+", "")
    letters = F.length(F.regexp_replace(compact, r"[^\p{L}\p{N}]", ""))
    words = F.size(F.regexp_extract_all(body, F.lit("[A-Za-z]{2,}"), 0))
    legibility = F.when(F.length(compact) > 0, words * letters / F.length(compact)).otherwise(0.0)
    rows = reading.select(*each, "exam_id", legibility.alias("legibility"))
    tag = reading.select(*each, "exam_id", F.explode(tags).alias("tag")).withColumn("base", base_number(F.col("tag"))).where("base IS NOT NULL")
    exams = question_set.select("exam_id").distinct()
    known = question_set.select("exam_id", "base", F.lit(True).alias("known")).distinct()
    counted = tag.join(exams, "exam_id", "left_semi").join(known, ["exam_id", "base"], "left").groupBy(*each).agg(F.count("known").alias("in_set"), F.count_if(F.col("known").isNull()).alias("out_of_set"))
    listed = wordlist.select(F.lower("word").alias("word")).distinct()
    token = reading.select(*each, F.explode(F.regexp_extract_all(F.lower(body), F.lit("[a-z]{3,}"), 0)).alias("word"))
    found = token.groupBy(*each, "word").agg(F.count(F.lit(1)).alias("n")).join(listed, "word", "left_semi").groupBy(*each).agg(F.sum("n").alias("dict_words"))
    full = rows.join(counted, list(each), "left").join(found, list(each), "left").fillna(0, ["in_set", "out_of_set", "dict_words"])
    return full.select(*each, "in_set", "out_of_set", "legibility", "dict_words", (F.col("dict_words") + 4.0 * F.col("in_set") - 3.0 * F.col("out_of_set")).alias("score"))


def rotation_vote(score: DataFrame) -> DataFrame:
    """(sheet_id, rotation): for sheets with enough tags outside the set, the rotation under which the pages that have such tags read best.

    Rotations are tried in order, 0 being what was scanned; the first one without any tag outside is taken at once, else
    the best by tags inside less those outside. It stands only if the whole sheet has fewer outside than before.
    """
    scanned = score.where("rotation = 0")
    flagged = scanned.where("out_of_set > 0").select(*PAGE)
    sheet = score.groupBy("sheet_id", "rotation").agg(F.sum("out_of_set").alias("all_out"))
    votes = score.join(flagged, list(PAGE), "left_semi").groupBy("sheet_id", "rotation").agg(F.sum(F.col("in_set") - F.col("out_of_set")).alias("s"), F.sum("out_of_set").alias("out"))
    order = F.array_position(F.array(*[F.lit(r) for r in TRIED]), F.col("rotation"))
    tried = F.array_sort(F.collect_list(F.struct(order.alias("o"), "rotation", "s", "out")))
    rows = votes.groupBy("sheet_id").agg(tried.alias("tried")).withColumn("before", F.filter("tried", lambda t: t["rotation"] == 0)[0]["s"])
    start = F.struct(F.col("before").alias("s"), F.lit(0).alias("rotation"), F.lit(False).alias("stop"))
    def step(best, t):
        better, clean = t["s"] > best["s"], (t["out"] == 0) & (t["s"] > 0)
        won = F.struct(F.greatest(t["s"], best["s"]).alias("s"), F.when(clean | better, t["rotation"]).otherwise(best["rotation"]).alias("rotation"), clean.alias("stop"))
        return F.when(best["stop"] | (t["rotation"] == 0), best).otherwise(won)

    chosen = rows.select("sheet_id", F.aggregate("tried", start, step)["rotation"].alias("rotation"))
    was = sheet.where("rotation = 0").select("sheet_id", F.col("all_out").alias("before_out"))
    kept = chosen.where("rotation <> 0").join(sheet, ["sheet_id", "rotation"]).join(was, "sheet_id")
    return kept.where((F.col("before_out") >= LEAST_OUT_OF_SET) & (F.col("all_out") < F.col("before_out"))).select("sheet_id", "rotation")


def rotation_autofix(score: DataFrame) -> DataFrame:
    """(sheet_id, page_no, rotation, action) of pages that don't read well as scanned: rotated where one reading clearly wins, uncertain
    where none is readable and numbers are garbled. Other pages aren't in the result."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("score"), F.desc("dict_words"), F.desc("in_set"), "rotation")
    whole = Window.partitionBy(*PAGE)
    scanned = F.max(F.when(F.col("rotation") == 0, F.struct("dict_words", "in_set", "out_of_set"))).over(whole)
    ranked = score.withColumns({"k": F.row_number().over(order), "next": F.lead("score").over(order), "cur": scanned}).where("k = 1 AND cur IS NOT NULL")
    checked = ranked.where(~((F.col("cur.dict_words") >= SKIP_WORDS) & (F.col("cur.out_of_set") == 0)))
    gain = (F.col("dict_words") >= F.col("cur.dict_words") + WORD_GAIN) & (F.col("dict_words") >= LEAST_WORDS)
    wins = (F.col("rotation") != 0) & ((F.col("in_set") > F.col("cur.in_set")) | gain)
    wins = wins & (F.col("score") >= F.coalesce("next", F.lit(0.0)) + WORD_GAIN) & (F.col("out_of_set") <= F.col("cur.out_of_set"))
    action = F.when(wins, "rotated").when((F.col("dict_words") < LEAST_WORDS) & (F.col("cur.out_of_set") > 0), "uncertain")
    return checked.withColumn("action", action).where("action IS NOT NULL").select(*PAGE, F.when(wins, F.col("rotation")).otherwise(0).alias("rotation"), "action")


def rotation_probe(score: DataFrame, suspect: DataFrame, voted: DataFrame | None = None) -> DataFrame:
    """(sheet_id, page_no, rotation, action, reason) of suspects: pages with tags outside the set, and landscape ones (suspect: sheet_id, page_no).

    From how the page was read (0, or as its sheet was ``voted``), landscape pages are tried a quarter turn either way, others
    at all turns. A turn is taken if tags outside don't rise and tags inside do, or legibility does by a margin; the
    most legible of those. Pages of garbled numbers that no turn helps are uncertain.
    """
    now = F.lit(0)
    rows = score
    if voted is not None:
        rows, now = score.join(voted.select("sheet_id", F.col("rotation").alias("turned")), "sheet_id", "left"), F.coalesce("turned", F.lit(0))
    rows = rows.withColumn("now", now).join(suspect.select(*PAGE, F.lit(True).alias("landscape")).distinct(), list(PAGE), "left")
    base = rows.where("rotation = now").select(*PAGE, F.col("in_set").alias("in0"), F.col("out_of_set").alias("out0"), F.col("legibility").alias("leg0"))
    reason = F.when(F.col("out0") > 0, "out-of-set").when(F.col("landscape"), "landscape")
    turn = (F.col("rotation") - F.col("now") + 360) % 360
    tried = rows.join(base, list(PAGE)).withColumns({"reason": reason, "turn": turn}).where("reason IS NOT NULL")
    allowed = (F.col("turn") > 0) & ((F.col("reason") != "landscape") | F.col("turn").isin(90, 270))
    clearer = (F.col("legibility") > F.col("leg0")) & (F.col("legibility") >= F.col("leg0") * (1 + LEGIBILITY_GAIN))
    passes = allowed & (F.col("legibility") > 0) & (F.col("out_of_set") <= F.col("out0")) & ((F.col("in_set") > F.col("in0")) | clearer)
    first = F.when(F.col("reason") == "landscape", F.when(F.col("turn") == 90, 2).otherwise(1)).otherwise(F.when(F.col("turn") == 180, 3).when(F.col("turn") == 270, 2).otherwise(1))
    best = tried.groupBy(*PAGE, "reason", "out0", "now").agg(F.max(F.when(passes, F.struct("legibility", first.alias("first"), "rotation"))).alias("b"))
    action = F.when(F.col("b").isNotNull(), "rotated").when(F.col("out0") > 0, "uncertain")
    return best.withColumn("action", action).where("action IS NOT NULL").select(*PAGE, F.coalesce("b.rotation", "now").alias("rotation"), "action", "reason")


def orient(score: DataFrame, suspect: DataFrame, autofix: bool = True) -> DataFrame:
    """(sheet_id, page_no, rotation, action): the fix of single pages where it is on, else the vote of sheets and then the probe of pages."""
    if autofix:
        return rotation_autofix(score)
    voted = rotation_vote(score)
    probed = rotation_probe(score, suspect, voted).drop("reason")
    rest = score.select(*PAGE).distinct().join(voted, "sheet_id").join(probed, list(PAGE), "left_anti")
    return probed.unionByName(rest.select(*PAGE, "rotation", F.lit("voted").alias("action")))
