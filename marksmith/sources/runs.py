"""Tables of runs that are replaced as a whole: hash-bucketed files, a log of commits, merge on read and compaction.

Rows are written below data/<table>/store_batch=<id>/store_bucket=<n>, so files grow with batches and buckets and not with runs, and a batch touches only the buckets of its keys. A
batch counts from the moment that its entry in the log exists; the entry is made in one step and names all tables of the batch, so a reader sees all of a batch or nothing. Of
the rows of a key those of the last batch that names it count: such a batch replaces everything that the key had, in every table of the store,
also where it brings no rows. compact() writes what counts into one batch in place of all before.

A batch has a name. One that is in the log already isn't written again, so a job or a stream's batch that is repeated after it was killed between writing and commit
leaves one version; what a killed attempt wrote is never read, and compact() deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKETS = 64
KEYS = "_keys"


class RunStore:
    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("run_id",), buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- the log ---

    def log(self) -> list[dict]:
        """The entries that count, oldest first: since the last compaction, with it."""
        folder = self._hadoop(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        entries: list[dict] = []
        for name in names:
            stream = self._fs.open(self._hadoop(f"{self.path}/log/{name}"))
            entry = json.loads(bytes(stream.readAllBytes()).decode()) | {"seq": int(name[:-5])}
            stream.close()
            entries = [entry] if entry.get("compacts") else [*entries, entry]
        return entries

    def publish(self, entry: dict, seq: int) -> bool:
        """Makes the log's entry ``seq``; False when another writer has made it first."""
        staged, target = self._hadoop(f"{self.path}/log/.{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/log/{seq:020d}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(staged, target):  # a rename is one step, which fails on a target that exists, but on local disks
            self._fs.delete(staged, False)
            return False
        return True

    # --- writing ---

    def stage(self, tables: dict[str, DataFrame], keys: DataFrame) -> dict:
        """Writes rows that don't count yet; returns the entry that makes them count."""
        attempt = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        every = tables | {KEYS: keys.select(self.keys).distinct()}
        for name, rows in every.items():
            dealt = rows.withColumn("store_bucket", bucket).repartition(self.buckets, "store_bucket")
            dealt.write.partitionBy("store_bucket").mode("overwrite").parquet(f"{self.path}/data/{name}/store_batch={attempt}")
        return {"data": attempt, "tables": {name: rows.schema.json() for name, rows in every.items()}}

    def commit(self, batch: str, tables: dict[str, DataFrame], keys: DataFrame, once: bool = False) -> bool:
        """Puts the rows of ``tables`` in place of all that ``keys`` have in the store; False if the batch is there already.

        ``once``: keys that the store has stay as they are. Should another writer commit meanwhile, new keys are looked for again.
        """
        while True:
            entries = self.log()
            if any(e["batch"] == batch or batch in e.get("held", ()) for e in entries):
                return False
            named, rows = keys.select(self.keys).distinct(), tables
            if once and entries:
                named = named.join(self._latest(entries).select(self.keys), self.keys, "left_anti")
                rows = {n: d.join(named, self.keys, "left_semi") for n, d in tables.items()}
            entry = self.stage(rows, named) | {"batch": batch}
            while not self.publish(entry, entries[-1]["seq"] + 1 if entries else 0):
                entries = self.log()
                if once:
                    break
            else:
                return True

    # --- reading ---

    def _read(self, name: str, entries: list[dict]) -> DataFrame | None:
        """The rows of all batches that count, with store_seq; None where no batch has the table."""
        of_table = [e for e in entries if name in e["tables"]]
        if not of_table:
            return None
        schema = StructType.fromJson(json.loads(of_table[-1]["tables"][name])).add("store_bucket", IntegerType()).add("store_batch", StringType())
        order = self.spark.createDataFrame([(e["data"], e["seq"]) for e in of_table], "store_batch string, store_seq long")  # as many rows as batches since the last compaction
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}").where(F.col("store_batch").isin([e["data"] for e in of_table]))
        return rows.join(F.broadcast(order), "store_batch").drop("store_batch", "store_bucket")

    def _latest(self, entries: list[dict]) -> DataFrame:
        return self._read(KEYS, entries).groupBy(self.keys).agg(F.max("store_seq").alias("store_seq"))

    def read(self, name: str, like: str | None = None) -> DataFrame:
        """The rows of a table that count. ``like``: the columns of a table that no batch has."""
        entries = self.log()
        found = self._read(name, entries)
        if found is None:
            if like is None:
                raise ValueError(f"no batch has the table {name}")
            return self.spark.createDataFrame([], like)
        return found.join(self._latest(entries), [*self.keys, "store_seq"], "left_semi").drop("store_seq")

    def compact(self) -> None:
        """Writes what counts into one batch, whose entry stands for all before, and deletes what no entry names. For times without other writers."""
        entries = self.log()
        if not entries:
            return
        names = {n for e in entries for n in e["tables"]} - {KEYS}
        entry = self.stage({n: self.read(n) for n in names}, self._latest(entries))
        entry |= {"batch": f"compaction-{uuid.uuid4().hex}", "compacts": True, "held": sorted({e["batch"] for e in entries} | {b for e in entries for b in e.get("held", ())})}
        if not self.publish(entry, entries[-1]["seq"] + 1):
            raise RuntimeError("another writer has committed meanwhile; compact again")
        for name in [*names, KEYS]:
            for status in self._fs.listStatus(self._hadoop(f"{self.path}/data/{name}")):
                if status.getPath().getName() != f"store_batch={entry['data']}":
                    self._fs.delete(status.getPath(), True)


def replace_run_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame], batch: str | None = None) -> bool:
    """Everything of the runs that any of ``tables`` (run_id, ..) names is dropped and their new rows take its place, as one step over all tables."""
    named = [t.select(F.col("run_id").cast("string").alias("run_id")) for t in tables.values()]
    keys = named[0]
    for other in named[1:]:
        keys = keys.unionByName(other)
    typed = {n: t.withColumn("run_id", F.col("run_id").cast("string")) for n, t in tables.items()}
    return RunStore(spark, path).commit(batch or uuid.uuid4().hex, typed, keys)


def write_bundles(store: RunStore, batch: str, state: DataFrame, file: DataFrame | None = None, when: Callable[[], None] = lambda: None) -> bool:
    """Archives runs' states as bundles: state (run_id, content, archived_at), file (run_id, name, sha256, bytes) of its other files, if any.

    A bundle is known by the hash of its content and files; a run whose last bundle is the same is passed over, another gets the next version. ``batch`` names the call: a
    repeated one adds nothing. ``when`` is called between writing and commit.
    """
    spark = store.spark
    last = state.groupBy("run_id").agg(F.max_by(F.struct("content", "archived_at"), "archived_at").alias("r")).select(F.col("run_id").cast("string").alias("run_id"), "r.*")
    listed = spark.createDataFrame([], "run_id string, files array<struct<name:string,sha256:string,bytes:bigint>>")
    if file is not None:
        each = F.struct("name", "sha256", F.col("bytes").cast("long").alias("bytes"))
        listed = file.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.array_sort(F.collect_list(each)).alias("files"))
    whole = last.join(listed, "run_id", "left").withColumn("files", F.coalesce("files", F.expr("array()").cast(listed.schema["files"].dataType)))
    whole = whole.withColumn("content_hash", F.sha2(F.array_join(F.concat(F.array("content"), F.transform("files", lambda f: F.concat_ws(":", f["name"], f["sha256"]))), "\0"), 256))
    entries = store.log()
    if any(e["batch"] == batch or batch in e.get("held", ()) for e in entries):
        return False
    kept = store.read("bundle", "run_id string, content string, archived_at string, files array<struct<name:string,sha256:string,bytes:bigint>>, content_hash string, version int")
    known = kept.groupBy("run_id").agg(F.max_by(F.struct("content_hash", "version"), "version").alias("k")).select("run_id", "k.*")
    old = known.select("run_id", F.col("content_hash").alias("old"), F.col("version").alias("old_version"))
    new = whole.join(old, "run_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("old"))).withColumn("version", F.coalesce("old_version", F.lit(0)) + 1)
    # a run's earlier versions are written again with its new one, so that one batch holds all of a run
    fresh = new.select(kept.columns)
    rows = kept.join(fresh.select("run_id"), "run_id", "left_semi").unionByName(fresh)
    entry = store.stage({"bundle": rows}, fresh) | {"batch": batch}
    when()
    if not store.publish(entry, entries[-1]["seq"] + 1 if entries else 0):
        return write_bundles(store, batch, state, file, when)
    return True
