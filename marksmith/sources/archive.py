"""Model replies, rejected rows, snapshots and the archive's index as tables; each job handles all runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RunStore

#: A reply's fields and the columns that they become.
REPLY_FIELDS = {
    "Marks Awarded": "marks_awarded", "Confidence (Low/Medium/High)": "confidence", "Justification": "justification", "Feedback": "feedback",
    "Needs Review (Yes/No)": "needs_review", "Off-Topic (Yes/No)": "off_topic", "Prompt Injection Detected": "injection",
}
PAIRS = "map<string,string>"


#: A quoted text with its escapes, read once, and the rest of a reply up to the next bracket or quote.
_QUOTED, _TOKEN = r'"(?:[^"\\]++|\\.)*+"', r'(?s)"(?:[^"\\]++|\\.)*+"|[{}]|[^{}"]++|"'
_VALUE = rf'{_QUOTED}|-?[0-9]+(?:\.[0-9]+)?|true|false|null'


def leading_object(text: Column) -> Column:
    """The object that a text begins with, to the brace that closes it: braces within quoted texts don't count, escaped quotes don't end one. Null when none closes."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = acc["at"] + F.length(token)
        return F.when(acc["end"].isNotNull(), acc).otherwise(F.struct(at.alias("at"), depth.alias("depth"), F.when((token == "}") & (depth == 0), at).alias("end")))

    end = F.aggregate(tokens, start, step)["end"]
    alone = text.rlike(r"\A\{[^{}]*\}\z")  # no brace but the first and the last, which no quoted text can hold then
    return F.when(alone, text).when(text.startswith("{"), F.substring(text, F.lit(1), end))


def parse_replies(reply: DataFrame) -> DataFrame:
    """reply (.., raw) with one column a field and parse_status: clean, repaired, salvaged or failed.

    Text between the first and the last brace is tried as it is, then with stray backslashes doubled (repaired), then the object alone that it begins with, whatever prose follows
    (repaired), and at last its whole pairs of key and value (salvaged), quotes within values included. Fields that hold objects or lists keep their JSON.
    """
    block = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)(\{.*\})", 1)
    text = F.when(block != "", block).otherwise(F.coalesce("raw", F.lit("")))
    doubled = lambda t: F.regexp_replace(t, r'\\(?!["\\/bfnrtu])', r"\\\\")
    whole = F.regexp_extract_all("_text", F.lit(rf"{_QUOTED}\s*:\s*(?:{_VALUE})"), F.lit(0))
    salvaged = F.when(F.size(whole) > 0, F.concat(F.lit("{"), F.array_join(whole, ","), F.lit("}")))
    rows = reply.withColumn("_text", text).withColumn("_lead", leading_object(F.col("_text")))
    alone = F.when(F.col("_lead") == F.col("_text"), F.col("_text"))  # what follows an object isn't looked at by the parser
    tries = {"clean": [alone], "repaired": [doubled(alone), F.col("_lead"), doubled(F.col("_lead"))], "salvaged": [salvaged]}

    def read(t: Column, status: str) -> Column:
        """The pairs with their status, null where there are none; each text is parsed once, and only when the tries before it failed."""
        held = F.filter(F.array(F.from_json(t, PAIRS)), lambda m: F.size(m) > 0)
        return F.get(F.transform(held, lambda m: F.struct(F.lit(status).alias("status"), m.alias("m"))), F.lit(0))

    found = F.coalesce(*[read(t, status) for status, texts in tries.items() for t in texts])
    rows = rows.select("*", F.explode(F.array(found)).alias("_read"))  # or a later filter by the status would be moved before this and read the reply again
    rows = rows.withColumns({"parse_status": F.coalesce("_read.status", F.lit("failed")), "_m": F.col("_read.m")})
    return rows.select(*[c for c in reply.columns if c != "raw"], "parse_status", *[F.col("_m")[F.lit(f)].alias(c) for f, c in REPLY_FIELDS.items()])


def scan_completed(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, modified, snapshot) of the runs below ``path`` that have a result snapshot, <run>/review_state.json."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "review_state.json").text(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/review_state\\.json$", 1)
    return files.select(run.alias("run_id"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("snapshot"))


def write_rejected(rejected: DataFrame, reviews: DataFrame, path: str) -> None:
    """Puts the rejected rows of ``reviews`` (review_id) in place of what the table has of them; reviews without any lose theirs."""
    RunStore(reviews.sparkSession, path, ("review_id",)).commit(uuid.uuid4().hex, {"rejected": rejected}, reviews)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return RunStore(spark, path, ("review_id",)).read("rejected")


def upsert_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index (run_id, content_hash, archived_at, ..) with ``new`` rows in place of those of the same run and content; the last of several counts."""
    best = F.max_by(F.struct(*new.columns), "archived_at")
    last = new.groupBy("run_id", "content_hash").agg(best.alias("r")).select("r.*")
    return index.join(last, ["run_id", "content_hash"], "left_anti").select(*new.columns).unionByName(last)


def write_snapshot(result: DataFrame, path: str) -> None:
    """Writes runs' results once: runs that the table has already stay as they are, also when two jobs write at the same time."""
    RunStore(result.sparkSession, path).commit(uuid.uuid4().hex, {"result": result}, result, once=True)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return RunStore(spark, path).read("result")


def write_index(new: DataFrame, path: str) -> None:
    """Upserts the archive's index by (run_id, content_hash), the last of several counts; only the buckets of its keys are written."""
    store = RunStore(new.sparkSession, path, ("run_id", "content_hash"))
    last = new.groupBy("run_id", "content_hash").agg(F.max_by(F.struct(*new.columns), "archived_at").alias("r")).select("r.*")
    store.commit(uuid.uuid4().hex, {"index": last}, last)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return RunStore(spark, path, ("run_id", "content_hash")).read("index")


def index_lines(new: DataFrame) -> DataFrame:
    """(line): a CSV line of each archive event, in the order of the columns, for appending to a readable log."""
    return new.orderBy("archived_at", "run_id").select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in new.columns])).alias("line"))


def run_stamp(run: DataFrame) -> DataFrame:
    """(run_id, stamp): a run's models and switches (run_id, name, value), as JSON with its names in order."""
    ordered = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))
    return run.groupBy("run_id").agg(F.to_json(ordered).alias("stamp"))


def lookup_questions(bank: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): rows of ``bank`` (question_id, ..) that are requested (question_id), or of a requested paper (prefix_Q..), and ids not found."""
    prefix = lambda c: F.regexp_extract(c, r"^(.+?)_Q[0-9]+", 1)
    ids = requested.select("question_id").distinct()
    papers = ids.select(prefix("question_id").alias("prefix")).where("prefix <> ''").distinct()
    keyed = bank.withColumn("prefix", prefix("question_id"))
    of_paper = keyed.join(papers, "prefix", "left_semi").drop("prefix")
    exact = keyed.join(papers, "prefix", "left_anti").drop("prefix").join(ids, "question_id", "left_semi")
    return of_paper.unionByName(exact), ids.join(bank, "question_id", "left_anti")


def index_rows(manifest: DataFrame, summary: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The archive's index: manifest (run_id, content_hash, version, student, class, subject, archived_at) with each run's summary, and its full state as JSON if given."""
    rows = manifest.join(summary, "run_id", "left")
    if state is None:
        return rows
    item = F.struct(*[c for c in state.columns if c != "run_id"])
    whole = state.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("review_state"))
    return rows.join(whole, "run_id", "left")


def archive_listing(index: DataFrame) -> DataFrame:
    """Per tester, subject and pupil the marks as text, flag counts and version, newest first."""
    number = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    marks = F.concat(number("awarded"), F.lit("/"), number("maximum"))
    return index.select("tester", "subject", "student", marks.alias("marks"), "needs_review", "off_topic", "injection", "version", "archived_at").orderBy(F.desc("archived_at"), "student", "version")


def archived_result(index: DataFrame, run_id: int, item: str) -> DataFrame:
    """The full graded record of one run, from the latest version's review_state; ``item`` is the schema of a question."""
    latest = index.where(F.col("run_id") == run_id).groupBy("run_id").agg(F.max_by("review_state", "version").alias("s"))
    return latest.select("run_id", F.inline(F.from_json("s", f"array<struct<{item}>>")))
