"""Readers of key, paper, page, reply and cost files, and writers of run results. Each job handles all files below a path."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RunStore

#: Entries of a key file that aren't questions.
NOT_QUESTIONS = ("_instructions_", "metadata")
ENTRY = "MAP<STRING, STRUCT<question: STRING, answer: STRING, marks: STRING, type: STRING>>"
COST = "run_id STRING, stage STRING, model STRING, input_tokens LONG, output_tokens LONG, billed DOUBLE, malformed STRING"


def write_packs(small: DataFrame, path: str) -> None:
    """Keeps small files (file: a path below the pack's, content binary) as rows of large ones, as many as ``small`` has partitions.

    To make, list and open a file takes tens of milliseconds whatever it holds, so a job that does so for each exam or run has no time for much else.
    """
    small.select("file", "content").write.parquet(path)


def _packed(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of what write_packs() kept, with ``path`` before the names."""
    return spark.read.schema("file STRING, content BINARY").parquet(path).withColumn("file", F.concat(F.lit(path.rstrip("/") + "/"), "file"))


def _whole_texts(spark: SparkSession, path: str, packed: bool) -> DataFrame:
    """(value, file) of the files at ``path``, or in the packs there."""
    if packed:
        return _packed(spark, path).select(F.decode("content", "UTF-8").alias("value"), "file")
    return spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_path"))


def _entries(spark: SparkSession, path: str, packed: bool) -> DataFrame:
    """(file, qid, entry) of JSON files that map ids to entries, bare or below "questions"; a file that is no JSON has none."""
    files = _whole_texts(spark, path, packed)
    inner = F.get_json_object("value", "$.questions")
    parsed = F.from_json(F.coalesce(inner, F.col("value")), ENTRY)
    return files.select("file", F.explode(parsed).alias("qid", "entry")).where(~F.col("qid").isin(*NOT_QUESTIONS) & F.col("entry").isNotNull())


def read_keys(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    return _entries(spark, path, packed).select("file", "qid", "entry.*")


CHOICES = "choice_groups ARRAY<STRUCT<parent: STRING, members: ARRAY<STRING>, required: STRING>>, inline_choice_ids ARRAY<STRING>"


def read_choices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(choice groups: file, group_no, parent, members, required; inline choices: file, qid) of key files.

    They lie in the metadata of a file that has its questions below "questions"; other files have none. A group without members is none; required is 1 where it isn't a number.
    """
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_path"))
    wrapped = files.where(F.get_json_object("value", "$.questions").isNotNull())
    meta = wrapped.select("file", F.from_json(F.get_json_object("value", "$.metadata"), CHOICES).alias("m"))
    each = meta.select("file", F.posexplode("m.choice_groups").alias("group_no", "g")).where(F.size("g.members") > 0)
    groups = each.select("file", "group_no", "g.parent", "g.members", F.coalesce(F.col("g.required").try_cast("int"), F.lit(1)).alias("required"))
    return groups, meta.select("file", F.explode("m.inline_choice_ids").alias("qid")).where("qid IS NOT NULL")


def read_papers(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """As read_keys, but without answers: a paper has none to give."""
    return read_keys(spark, path, packed).drop("answer")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_no, text); the page's number is the last run of digits in the file's name, so page_2 comes before page_10."""
    pages = spark.read.option("wholetext", True).text(path).select("value", "_metadata.file_path", "_metadata.file_name")
    number = F.regexp_extract("file_name", "([0-9]+)[^0-9]*$", 1).try_cast("int")
    return pages.select(F.col("file_path").alias("file"), number.alias("page_no"), F.col("value").alias("text"))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """Cost lines; blank ones are skipped, and one that is no JSON keeps its text in ``malformed``."""
    return spark.read.schema(COST).option("columnNameOfCorruptRecord", "malformed").json(path)


def file_manifest(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(file, sha256, bytes) of every file below ``path``, or in the packs there."""
    if packed:
        return _packed(spark, path).select("file", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def run_manifest(found: DataFrame, root: str) -> DataFrame:
    """(run_id, files, n_files, bytes, has_pdf, has_evidence) of files (file, sha256, bytes) below ``root``: a run is a folder there, its evidence what lies in its folder evidence.

    Files that lie in no run's folder belong to none. files has name (below the run's folder), sha256 and bytes, by name.
    """
    below = F.regexp_extract("file", f"{re.escape(root.rstrip('/'))}/(.+)$", 1)
    parts = found.withColumn("_b", below).withColumns({"run_id": F.regexp_extract("_b", "^([^/]+)/", 1), "name": F.regexp_extract("_b", "^[^/]+/(.+)$", 1)}).where("run_id <> ''")
    return parts.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "sha256", "bytes"))).alias("files"), F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"),
        F.bool_or(F.lower("name").endswith(".pdf")).alias("has_pdf"), F.bool_or(F.col("name").startswith("evidence/")).alias("has_evidence"),
    )


def replace_runs(result: DataFrame, path: str) -> None:
    """Writes the rows of each run in place of those that the run had; other runs stay. Several tables at once: runs.replace_run_tables()."""
    RunStore(result.sparkSession, path).commit(uuid.uuid4().hex, {"result": result}, result)


def read_runs(spark: SparkSession, path: str, table: str = "result") -> DataFrame:
    return RunStore(spark, path).read(table)


def destination(class_name: str, subject: str) -> list:
    """class_dir and subject_dir as columns: only safe characters, and names for unknown values."""
    safe = [F.trim(F.regexp_replace(F.trim(F.col(c)), "[^A-Za-z0-9_-]+", "_"), F.lit("_")) for c in (class_name, subject)]
    return [F.coalesce(F.nullif(s, F.lit("")), F.lit(f"unknown_{n}")).alias(f"{n}_dir") for n, s in zip(("class", "subject"), safe)]
