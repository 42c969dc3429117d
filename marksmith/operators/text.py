"""Page text: boilerplate, look-ahead, tagged chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[ \t\r\n]+"


def line_key(line: Column) -> Column:
    """Lower case, white space collapsed, page numbers as #."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), SPACE, " "), "page [0-9]+", "page #")


def _lines(page_text: DataFrame) -> DataFrame:
    return page_text.select("doc", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def boilerplate_lines(page_text: DataFrame, repeats: int = 3, shortest: int = 15, longest: int = 200) -> DataFrame:
    """(doc, key, pages): lines that at least ``repeats`` pages of a document share."""
    lines = _lines(page_text).where(F.length(F.trim("line")).between(shortest, longest)).select("doc", "page", line_key(F.col("line")).alias("key")).distinct()
    return lines.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= repeats)


def strip_boilerplate(page_text: DataFrame, keys: DataFrame) -> DataFrame:
    """page_text without the lines of ``keys``; three or more line ends become two, ends are trimmed."""
    kept = _lines(page_text).withColumn("key", line_key(F.col("line"))).join(keys.select("doc", "key"), ["doc", "key"], "left_anti")
    joined = kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    clean = F.trim(F.regexp_replace("text", "\n{3,}", "\n\n"), F.lit(" \t\r\n"))
    return page_text.select("doc", "page").join(joined, ["doc", "page"], "left").select("doc", "page", F.coalesce(clean, F.lit("")).alias("text"))


def with_lookahead(page_text: DataFrame, n: int = 1200) -> DataFrame:
    """(doc, page, lookahead): each page that isn't empty, with the first ``n`` characters of the next such page.

    Only those first characters are moved, and a document's pages are dealt by runs of page numbers.
    """
    return _next_heads(page_text.where(F.trim("text") != "").select("doc", "page", F.substring("text", 1, n).alias("head")))


def clean_lookahead(page_text: DataFrame, n: int = 1200, span: int = 4096) -> DataFrame:
    """(doc, page, lookahead): for each page with text besides boilerplate, the first ``n`` characters of the next such page, without boilerplate.

    Only those first characters are moved, and a document's pages are dealt by runs of ``span`` page numbers;
    the last page of a run takes the first of the document's next one.
    """
    clean = strip_boilerplate(page_text, boilerplate_lines(page_text)).where("text <> ''")
    return _next_heads(clean.select("doc", "page", F.substring("text", 1, n).alias("head")), span)


def _next_heads(heads: DataFrame, span: int = 4096) -> DataFrame:
    """(doc, page, lookahead): the head of a document's next page; the last page of a run takes the first of the next run."""
    heads = heads.withColumn("run", F.floor(F.col("page") / span))
    firsts = heads.groupBy("doc", "run").agg(F.min_by("head", "page").alias("head"))
    behind = firsts.select("doc", "run", F.lead("head").over(Window.partitionBy("doc").orderBy("run")).alias("behind"))
    inside = heads.withColumn("lookahead", F.lead("head").over(Window.partitionBy("doc", "run").orderBy("page")))
    return inside.join(behind, ["doc", "run"]).select("doc", "page", F.coalesce("lookahead", "behind", F.lit("")).alias("lookahead"))


TAG = r"\[START_Q:[ \t]*([^\]\n]*)\]"


def split_chunks(page_reading: DataFrame) -> DataFrame:
    """(sheet_id, page_no, pos, tag, text): the text before the first tag at 0 with a null tag, then one chunk for each tag."""
    tags = F.regexp_extract_all("text", F.lit(TAG), 1)
    parts = F.split("text", r"\[START_Q:[^\]\n]*\]")
    noise = r"(?i)\s*\(?(?:contd\.?|continued|part\s*[0-9]*|pg\s*[0-9]*)\)?\s*"
    chunk = page_reading.select("sheet_id", "page_no", tags.alias("tags"), F.posexplode(parts).alias("pos", "text"))
    tag = F.when(F.col("pos") > 0, F.rtrim(F.trim(F.regexp_replace(F.get("tags", F.col("pos") - 1), noise, "")), F.lit("-.")))
    return chunk.select("sheet_id", "page_no", "pos", tag.alias("tag"), "text")


def clean_chunks(chunk: DataFrame) -> DataFrame:
    """Without END and BLANK PAGE tags and instruction or section lines; the handwriting tag becomes a column."""
    bad = F.contains("text", F.lit("[BAD_HANDWRITING]"))
    text = F.regexp_replace(F.regexp_replace("text", r"\[END_Q:[^\]]*\]|\[BAD_HANDWRITING\]", ""), r"(?i)\[BLANK[ _]PAGE\]", "")
    printed = lambda line: line.rlike(r"(?i)^\s*section\s*[-–—]?\s*[a-e]\s*$") | line.rlike(r"(?i)^\s*\[instruction\]\s*:")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~printed(line)), "\n")
    return chunk.withColumns({"is_bad_handwriting": bad, "text": F.trim(kept, F.lit(" \t\r\n"))})


def orphan_text(chunk: DataFrame) -> DataFrame:
    """Text of a sheet before any question is opened: (sheet_id, page_no, text)."""
    opened = F.min(F.when(F.col("tag").isNotNull(), F.col("page_no"))).over(Window.partitionBy("sheet_id"))
    rows = chunk.withColumn("opened", opened).where("tag IS NULL AND (opened IS NULL OR page_no <= opened)")
    return rows.where(F.trim("text") != "").select("sheet_id", "page_no", F.trim("text").alias("text"))


def page_scores(chunk: DataFrame, top: int) -> DataFrame:
    """Tags of a page inside and outside the question numbers 1 to ``top``, and its words of two letters or more."""
    number = F.regexp_extract("tag", "([0-9]+)", 1).try_cast("int")
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0))
    return chunk.groupBy("sheet_id", "page_no").agg(
        F.count_if(number.between(1, top)).alias("in_set"), F.count_if(number > top).alias("out_of_set"), F.sum(words).alias("words")
    )
