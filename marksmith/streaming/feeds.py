"""Growing inputs as streams: cost lines, teacher decisions and finished sheets."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import price_calls
from ..sources.files import COST
from ..sources.runs import RunStore, write_bundles

DECISION = "review_id LONG, base INT, seq LONG, decision STRING, corrected_marks DOUBLE"
PROGRESS = "batch_id STRING, sheet_no INT, status STRING"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def cost_stream(spark: SparkSession, path: str, price: DataFrame) -> DataFrame:
    """Running calls, tokens and cost of each run and stage, for output mode update or complete. Late lines count like others."""
    priced = price_calls(_lines(spark, path, COST), price)
    return priced.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost")
    )


def decision_stream(spark: SparkSession, path: str) -> DataFrame:
    """The last decision, by seq, on each question; a later one replaces the earlier, in whatever order they arrive."""
    kept = F.max_by(F.struct("decision", "corrected_marks", "seq"), "seq").alias("d")
    return _lines(spark, path, DECISION).groupBy("review_id", "base").agg(kept).select("review_id", "base", "d.decision", "d.corrected_marks", "d.seq")


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """Finished and failed sheets of each batch; the counts only rise, whatever the order of completion."""
    done = _lines(spark, path, PROGRESS)
    return done.groupBy("batch_id").agg(F.count(F.lit(1)).alias("finished"), F.count_if(F.col("status") == "failed").alias("failed"))


def archive_stream(spark: SparkSession, path: str, schema: str, index_path: str, every: str = "300 seconds"):
    """A writer that archives each new or changed run of the JSON snapshots below ``path`` (run_id, content, archived_at) as bundles; see write_bundles().

    A batch is committed under its number and the name of its query, so one that was killed, wherever, is repeated without a second version. Call start() on the result.
    """
    name = hashlib.sha256(path.encode()).hexdigest()[:16]

    def archive(batch: DataFrame, number: int) -> None:
        write_bundles(RunStore(batch.sparkSession, index_path), f"{name}-{number}-{_state_of(batch)}", batch)

    return spark.readStream.schema(schema).json(path).writeStream.trigger(processingTime=every).foreachBatch(archive)


def _state_of(batch: DataFrame) -> str:
    """The id of the query that a batch belongs to: it stays with the query's checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def archived(spark: SparkSession, index_path: str) -> DataFrame:
    """(run_id, content_hash, version, archived_at, content, files) of all bundles."""
    return RunStore(spark, index_path).read("bundle", "run_id string, content_hash string, version int, archived_at string, content string, files array<struct<name:string,sha256:string,bytes:bigint>>")
