"""Combined scans to sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_sheets(page_verdict: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Runs of pages from each start page to the next; page 0 always starts. Needs review: no name, low confidence, or a forced first sheet."""
    pages = Window.partitionBy("batch_id").orderBy("page_index")
    forced = (F.col("page_index") == 0) & ~F.col("is_sheet_start")
    starts = page_verdict.withColumn("pages", F.count(F.lit(1)).over(Window.partitionBy("batch_id"))).where(F.col("is_sheet_start") | (F.col("page_index") == 0))
    number = F.row_number().over(pages)
    end = F.coalesce(F.lead("page_index").over(pages) - 1, F.col("pages") - 1)
    review = F.col("name").isNull() | F.coalesce(F.col("confidence") < threshold, F.lit(False)) | forced
    return starts.select(
        "batch_id", number.alias("sheet_no"), F.coalesce("name", F.concat(F.lit("Student "), number)).alias("name"),
        F.col("page_index").alias("start_page"), end.cast("int").alias("end_page"), (end - F.col("page_index") + 1).cast("int").alias("page_count"), review.alias("needs_review"),
    )


def dedup_names(sheets: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """The k-th sheet of a name becomes "name (k)"; the first keeps its name."""
    k = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return sheets.withColumn("display_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), k, F.lit(")"))))


def normalize_manifest(edits: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Edited ranges (batch_id, seq, name, start_page, end_page as text): unparsable ones go, the rest are clamped, sorted and numbered."""
    start, end = F.col("start_page").try_cast("int"), F.col("end_page").try_cast("int")
    kept = edits.withColumns({"s": start, "e": end}).where("s IS NOT NULL AND e IS NOT NULL").join(page_counts, "batch_id")
    first = F.least(F.greatest(F.col("s"), F.lit(1)), F.col("page_count"))
    clamped = kept.withColumn("start_page", first).withColumn("end_page", F.least(F.greatest(F.col("e"), F.col("start_page")), F.col("page_count")))
    number = F.row_number().over(Window.partitionBy("batch_id").orderBy("start_page", "seq"))
    return clamped.select("batch_id", number.alias("sheet_no"), "name", "start_page", "end_page")
