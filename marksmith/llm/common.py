"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that setting is unset, and the master is a single local process, a temporary
    folder takes its place; on a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a path that scratch_path() gave, before the application ends."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Documents that Spark hands to a Python worker at once, where the session has no setting of its own.
BATCH_DOCS = 1000


def small_batches(spark: SparkSession) -> None:
    """Documents are wide rows, so fewer of them make an Arrow batch than Spark's default of 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), null text as empty; other columns, whatever their names, are left out."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32(), "array<long>": pa.list_(pa.int64())}

#: Rows of one output batch of the Arrow operators.
OUTPUT_ROWS = 4096


def record_batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches; ``schema`` is a list of "name type" joined by commas."""
    fields = [x.split() for x in schema.split(",")]
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    for at in range(0, len(rows), OUTPUT_ROWS):
        part = list(zip(*rows[at : at + OUTPUT_ROWS]))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(part, arrow)], schema=arrow)
