"""Questions and the pages that they stand on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Orientation actions, the stronger last.
ACTIONS = ("rotated", "uncertain")


def mirror_pages(page_question: DataFrame, split_map: DataFrame) -> DataFrame:
    """page_question (sheet_id, base, page_no) with every page of its source for each new question (sheet_id, base, new_base)."""
    inherited = page_question.join(split_map, ["sheet_id", "base"]).select("sheet_id", F.col("new_base").alias("base"), "page_no")
    return page_question.select("sheet_id", "base", "page_no").unionByName(inherited).distinct()


def page_roles(page_question: DataFrame) -> DataFrame:
    """A question starts on its first page; later ones continue it."""
    first = F.min("page_no").over(Window.partitionBy("sheet_id", "base"))
    return page_question.withColumn("role", F.when(F.col("page_no") == first, "start").otherwise("continuation"))


def bands(page_anchor: DataFrame, bottom: int = 1000) -> DataFrame:
    """From each anchor (sheet_id, page_no, base, y) to the next one of its page, the last to the page's bottom."""
    down = Window.partitionBy("sheet_id", "page_no").orderBy("y", "base")
    return page_anchor.select("sheet_id", "page_no", "base", F.col("y").alias("top"), F.coalesce(F.lead("y").over(down), F.lit(bottom)).alias("bottom"))


def continuation_bands(page_anchor: DataFrame, continuing: DataFrame, bottom: int = 1000) -> DataFrame:
    """Bands of a page's anchors, and above the first the one of the question (sheet_id, page_no, base) that goes on there, the first of several."""
    first = page_anchor.groupBy("sheet_id", "page_no").agg(F.min("y").alias("y"))
    goes_on = continuing.groupBy("sheet_id", "page_no").agg(F.min("base").alias("base")).join(first, ["sheet_id", "page_no"], "left")
    above = goes_on.select("sheet_id", "page_no", "base", F.lit(0).alias("top"), F.coalesce("y", F.lit(bottom)).alias("bottom"))
    return above.unionByName(bands(page_anchor, bottom))


def diagram_pages(answer: DataFrame, page_question: DataFrame, most: int = 4) -> DataFrame:
    """The first pages of each question whose answer has a diagram."""
    drawn = answer.where(F.contains("answer", F.lit("[DIAGRAM:"))).select("sheet_id", "base")
    place = F.row_number().over(Window.partitionBy("sheet_id", "base").orderBy("page_no"))
    return page_question.join(drawn, ["sheet_id", "base"], "left_semi").select("sheet_id", "base", "page_no", place.alias("place")).where(F.col("place") <= most)


def apply_orientation(page_question: DataFrame, orientation_flag: DataFrame) -> DataFrame:
    """The strongest action (sheet_id, page_no, action) over each question's pages."""
    strength = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    return page_question.join(orientation_flag, ["sheet_id", "page_no"]).groupBy("sheet_id", "base").agg(F.max_by("action", strength).alias("action"))


def evidence_images(crop: DataFrame) -> DataFrame:
    """Per question the files (sheet_id, base, page_no, file) in page order, each once."""
    ordered = F.array_sort(F.collect_set(F.struct("page_no", "file")))
    return crop.groupBy("sheet_id", "base").agg(F.array_join(F.transform(ordered, lambda x: x["file"]), ",").alias("files"))


def evidence_by_id(crop: DataFrame, sheet_key: DataFrame) -> DataFrame:
    """(sheet_id, qid, files) of crops (sheet_id, qid, page_no, file), in page order, each once.

    A sub-part's crops go to its parent, the id before the first dot, where the sheet's key (sheet_id, qid) has that one and not the sub-part.
    """
    parent = F.split_part("qid", F.lit("."), F.lit(1)).alias("parent")
    # an id and its parent have the same parent, so sheet and parent part all of this: the two sides meet once, and the groups need no further shuffle
    known = sheet_key.select("sheet_id", parent, "qid").groupBy("sheet_id", "parent").agg(F.collect_set("qid").alias("ids"))
    first = crop.where("file <> ''").select("sheet_id", parent, "qid", "page_no", "file").join(known, ["sheet_id", "parent"], "left")
    target = F.when(~F.array_contains("ids", F.col("qid")) & F.array_contains("ids", F.col("parent")), F.col("parent")).otherwise(F.col("qid"))
    rows = first.select("sheet_id", "parent", target.alias("qid"), F.struct("file", F.col("page_no").isNull().alias("unknown"), "page_no").alias("at"))
    by_id = rows.groupBy("sheet_id", "parent", "qid").agg(F.array_sort(F.collect_set("at")).alias("at"))
    once = F.filter("at", lambda x, k: (k == 0) | (F.get("at", k - 1)["file"] != x["file"]))  # a file's first page
    files = F.transform(F.array_sort(F.transform(once, lambda x: F.struct(x["page_no"].alias("page_no"), x["file"].alias("file")))), lambda x: x["file"])
    return by_id.select("sheet_id", "qid", F.array_join(files, ",").alias("files"))
