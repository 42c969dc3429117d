"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters range-partition the texts, each range is sorted, so equal texts lie next to each
other, and one pass over neighbours compares them in full. Splitters are the texts' first characters,
as their bytes compare, and a hash for texts that begin alike: the sample that the driver sees is small
however long the texts are, and a beginning that many texts share is split over ranges. The sorted rows
carry their ids, so a row learns its group from that one pass, and whole texts are shuffled once.

A text with more copies than a quarter of a range's rows would fill a range by itself. Such texts are
found first, by counting hashes of eight bytes; they number at most four to a range. A part number, from
the row's id and its input partition, goes into their sort key behind the text's hash, so that one text's
copies end in several ranges; each part is sorted and compared like any other run of neighbours, and the
parts' results, at most eight to a range, are put together.

Defined results: a null text counts as empty, and empty texts form one group. Texts may be of any length.
Rows that repeat both id and text count as rows of the group. A null id loses against any other id. An
empty table gives an empty table. Extra columns may have any names and types; ``drop_exact_duplicates``
returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, texts, written

#: A text is sorted in parts when it has more than this many copies, and more than a quarter of a range's rows.
LEAST_FREQUENT = 32
#: Characters of a text that a splitter holds.
HEAD_CHARS = 32


def frequent_texts(rows: DataFrame) -> DataFrame:
    """(tie, parts): the 64-bit hash of the texts with more than LEAST_FREQUENT rows and a quarter of a range's, and their parts.

    At most four for each shuffle partition, and twice as many parts, so the table may be broadcast. Two
    frequent texts of one hash are only treated alike; all decisions compare texts in full.
    """
    limit = max(LEAST_FREQUENT, rows.count() // (4 * shuffle_partitions(rows.sparkSession)))
    counted = rows.groupBy(F.xxhash64("text").alias("tie")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return counted.select("tie", F.ceil(F.col("n") / limit).alias("parts"))


def with_parts(rows: DataFrame) -> DataFrame:
    """The rows with their text's hash as ``tie``, and the ``parts`` that its copies are sorted in: 1 but for frequent texts."""
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    return keyed.join(F.broadcast(frequent_texts(rows)), "tie", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def content_sorted(rows: DataFrame, id_col: str) -> tuple[DataFrame, Window]:
    """Rows with tie and parts in ranges of their text, and the window of a run of equal neighbours there."""
    # the input partition parts rows that repeat an id, and is the same when a lost task runs again
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(id_col, F.spark_partition_id()), "parts")).otherwise(0)
    keyed = rows.withColumns({"head": F.substring("text", 1, HEAD_CHARS), "part": part})
    return keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), "head", "tie", "part"), Window.partitionBy("head", "tie", "part", "text")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest id of its text), group_size, kept, text_sha256."""
    ordered, run = content_sorted(with_parts(texts(docs, id_col, text_col)), "doc_id")
    in_run = F.max("doc_id").over(run).alias("run_keep"), F.count(F.lit(1)).over(run).alias("run_size")
    # ids and digests, no texts, so that the sort is done once
    rows = written(ordered.select("doc_id", *in_run, F.sha2("text", 256).alias("text_sha256"), "part", "parts"), "exact-runs")
    runs = rows.where("parts > 1").groupBy("text_sha256", "part").agg(F.first("run_keep").alias("run_keep"), F.first("run_size").alias("run_size"))
    # as many rows as there are frequent texts, which frequent_texts() bounds
    merged = runs.groupBy("text_sha256").agg(F.max("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
    keep_id = F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep"))
    found = rows.join(F.broadcast(merged), "text_sha256", "left").withColumns({"keep_id": keep_id, "group_size": F.coalesce("all_size", "run_size")})
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row per distinct text, that with the largest id; same columns.

    The surviving row travels with its text through the content sort, so no join follows; of a frequent text
    each part has a survivor, and the best of these stays. Of rows equal in id and text one stays, whichever
    comes first.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.toDF(*place.values()) if docs.columns else docs
    rows, key = named.withColumn("text", F.coalesce(F.col(place[text_col]), F.lit(""))), place[id_col]
    keyed = with_parts(rows)

    def survivors(some: DataFrame) -> DataFrame:
        ordered, run = content_sorted(some, key)
        return ordered.withColumn("rank", F.row_number().over(run.orderBy(F.col(key).desc_nulls_last()))).where("rank = 1")

    first = survivors(keyed.where("parts = 1")).select(*place.values())
    whole_row: Column = F.struct(*place.values())
    most = F.max_by(whole_row, F.struct(F.col(key).isNotNull(), F.col(key)))
    merged = survivors(keyed.where("parts > 1")).groupBy("text").agg(most.alias("row")).select("row.*")
    return first.unionByName(merged).toDF(*docs.columns)
