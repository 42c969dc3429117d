"""A prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of turns that conversations begin with. A sequence is known by a chained hash of its
turns' digests (BLAKE2b, 128 bits), so that a node, however deep, is one small key, and no text is shuffled.

Totals of subtrees flow from children to parents. Nodes that more than ``heavy`` conversations begin with are the top of the
trie; that bound grows with the input, so that the top holds MAX_HEAVY nodes or fewer. What hangs below the top are shards: whole subtrees, each dealt to a task.
Spark sorts a task's nodes by reverse level order, spilling as it needs, and one pass over them takes
each node's messages from a priority queue and puts in one for its parent. The queue keeps
``QUEUE`` messages in memory and sorted runs of the others in an anonymous spill file that goes with the task; a task that is repeated on
another executor begins anew, as it reads nothing but its shuffled nodes. Then the same pass runs across the shards' roots, over the top of the trie, to
which Spark sums up the shards' totals first, so a parent with a third of all conversations below it gets one message a shard task at most.

``rebuild`` gives conversations a shared head: the first h turns of conversation c - c % 100 in place of their own, h = crc32(c) % 6.

Defined results: null roles and texts count as empty. Turns are ordered by turn, null first, then by a hash of role and text, so
that repeated rows are turns of their own, in a fixed order. Rows without conv_id belong to no conversation and are left
out. A conversation without turns ends at the root. Texts may be of any length. An empty table gives an empty table, not even a root.
Conversations may have any number of turns: their turns are read as a stream. Only the four columns named are
read, so extra columns may have any names and types.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batches, shuffle_partitions, written

#: Nodes of the top at most, and conversations of a shard that need no top.
MAX_HEAVY, LEAST_HEAVY = 20_000, 256
#: Messages that a task's priority queue keeps in memory, and ids that are joined into a piece of a node's list.
QUEUE, PIECE_IDS = 1 << 18, 4096
HEAD_EVERY, HEADS = 100, 6
ROOT = b"\0" * 16


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, digest, n_chars): each conversation's turns in order, without their texts."""
    c = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), "turn", *[F.coalesce(conversations[k], F.lit("")).alias(k) for k in ("role", "text")])
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    slim = c.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.length("text").cast("long").alias("n_chars"))
    return slim.withColumn("rank", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest)").cast("long")).drop("turn")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns: conv_id, depth from 1, digest, n_chars; all conversations: conv_id), from ``turns`` as turn_rows() gives them."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    conv = turns.select("conv_id").distinct().withColumns({"h": h, "anchor": F.col("conv_id") - F.col("conv_id") % HEAD_EVERY})
    first = turns.where((F.col("conv_id") % HEAD_EVERY == 0) & (F.col("rank") < HEADS))
    heads = first.groupBy(F.col("conv_id").alias("anchor")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "n_chars"))).alias("head"))  # five turns at most
    with_head = conv.join(heads, "anchor", "left").select("conv_id", "h", F.coalesce(F.filter("head", lambda x: x["rank"] <= F.col("h")), F.expr("array()")).alias("head"))
    shared = with_head.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.rank").alias("depth"), "t.digest", "t.n_chars")
    moved = with_head.select("conv_id", "h", F.size("head").cast("long").alias("m"))
    own = turns.join(moved, "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("m")).alias("depth"), "digest", "n_chars")
    return shared.unionByName(own), conv.select("conv_id")


PATHS = "conv_id long, depth long, node binary, parent binary, n_chars long, last boolean"


def paths(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth: its node there, that node's parent, and whether the conversation ends there."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, held = None, ROOT, None
        for batch in batches:
            rows = []
            for c, depth, digest, n_chars in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "depth", "digest", "n_chars")]):
                if held:
                    rows.append((*held, c != conv))
                parent = node if c == conv else ROOT
                conv, node = c, hashlib.blake2b(parent + digest, digest_size=16).digest()
                held = (c, depth, node, parent, n_chars)
            yield from record_batches(rows, PATHS)
        if held:
            yield from record_batches([(*held, True)], PATHS)

    ordered = turns.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.select("conv_id", "depth", "digest", "n_chars").mapInArrow(chained, PATHS)


class SpillingQueue:
    """A priority queue of tuples: beyond ``most`` in memory, those are written as a sorted run to an anonymous file, and runs are merged as they are read."""

    def __init__(self, most: int = QUEUE):
        self.heap: list[tuple] = []
        self.most, self.runs, self.spilled = most, [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            file = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, file)
            file.seek(0)
            self.heap, self.spilled = [], self.spilled + 1
            self._next(file)

    def _next(self, file) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), id(file), file))
        except EOFError:
            file.close()

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, file = heapq.heappop(self.runs)
            self._next(file)
            return item
        return heapq.heappop(self.heap)


TOTALS = "node binary, n_children long, n_leaves long, saved_tokens long"


def time_forward(nodes: DataFrame, most: int = QUEUE) -> DataFrame:
    """TOTALS of ``nodes`` (task, depth, node, parent, saved, children, leaves, below): sums over the subtrees among the nodes of a task.

    children, leaves and below are what a node has got already from shards that hang below it.
    """

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(most)
        columns = ("depth", "node", "parent", "saved", "children", "leaves", "below")
        for batch in batches:
            rows = []
            for depth, node, parent, saved, children, leaves, below in zip(*[batch.column(k).to_pylist() for k in columns]):
                total = saved + below
                # messages to nodes that aren't of this task stay behind as the pass goes on to lower depths
                while (head := queue.peek()) and head[:2] < (-depth, node):
                    queue.pop()
                while (head := queue.peek()) and head[:2] == (-depth, node):
                    _, _, _, more, sub = queue.pop()
                    children, leaves, total = children + 1, leaves + more, total + sub
                leaves = leaves if children else 1
                if parent is not None:
                    queue.push((1 - depth, parent, node, leaves, total))
                rows.append((node, children, leaves, total))
            yield from record_batches(rows, TOTALS)

    return nodes.sortWithinPartitions(F.desc("depth"), "node").select("depth", "node", "parent", "saved", "children", "leaves", "below").mapInArrow(forward, TOTALS)


def ends_hashes(ends: DataFrame, piece: int = PIECE_IDS) -> DataFrame:
    """(node, ends_sha256) from ``ends`` (node, conv_id): SHA-256 of the ids in order, comma-joined.

    Ids are dealt by ranges of (node, id), so that a node where a third of all conversations end is joined into pieces by many tasks. The hash itself
    goes over one node's pieces in order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            rows = []
            for node, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (node != now or len(held) >= piece):
                    rows.append((now, held[0], ",".join(map(str, held))))
                    held = []
                now = node
                held.append(c)
            yield from record_batches(rows, "node binary, first long, ids string")
        if held:
            yield from record_batches([(now, held[0], ",".join(map(str, held)))], "node binary, first long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            rows = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    rows.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(ids.encode())
            yield from record_batches(rows, "node binary, ends_sha256 string")
        if sha:
            yield from record_batches([(now, sha.hexdigest())], "node binary, ends_sha256 string")

    parts = shuffle_partitions(ends.sparkSession)
    joined = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id").mapInArrow(pieces, "node binary, first long, ids string")
    return joined.repartition(parts, "node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuilt: bool = True, least_heavy: int = LEAST_HEAVY, queue: int = QUEUE) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; ``rebuilt``: of conversations with shared heads."""
    spark = conversations.sparkSession
    turns = written(turn_rows(conversations), "turns")
    made, conv = rebuild(turns) if rebuilt else (turns.withColumnRenamed("rank", "depth"), turns.select("conv_id").distinct())
    path = written(paths(made), "paths")
    grouped = path.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.max("n_chars").alias("n_chars"))
    nodes = written(grouped.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars")), "nodes")
    n_convs, least, n_paths = [conv.agg(F.count(F.lit(1)), F.min("conv_id")).first()[k] for k in (0, 1)] + [path.count()]
    if not n_convs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # a node of the top takes over ``heavy`` of the paths' rows, so MAX_HEAVY bounds their number
    heavy = max(least_heavy, n_paths // MAX_HEAVY)
    root = spark.createDataFrame([(ROOT, 0, least, n_convs, None, 0, 0)], "node binary, depth long, conv_id long, n_convs long, parent binary, n_chars long, saved long")
    top = written(nodes.where(F.col("n_convs") > heavy).select(root.columns).unionByName(root), "top")
    light = nodes.where(F.col("n_convs") <= heavy)
    # the shard of a conversation's light nodes is the first of them
    top_keys = F.broadcast(top.select("node"))
    shard = path.join(top_keys, "node", "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "node")).alias("s")).select("conv_id", F.col("s.node").alias("shard"))
    nothing = {c: F.lit(0).cast("long") for c in ("children", "leaves", "below")}
    dealt = light.join(shard, "conv_id").withColumns(nothing).repartition(shuffle_partitions(spark), "shard")
    totals = written(time_forward(dealt, queue), "totals")
    below = light.join(totals, "node").join(F.broadcast(top.select(F.col("node").alias("parent"))), "parent", "left_semi")
    sums = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
    started = top.join(sums, "node", "left").na.fill(0, ["children", "leaves", "below"])
    top_totals = time_forward(started.coalesce(1), queue)
    turnless = conv.join(path.where("last").select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id")
    ends = ends_hashes(path.where("last").select("node", "conv_id").unionByName(turnless))
    # a parent outside the top has ``heavy`` children at most; those of the top are few enough to be sent to every task
    parent = lambda d: d.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kept = ["node", "depth", "parent", "conv_id", "n_convs"]
    under_top = light.select(kept).join(F.broadcast(parent(top)), "parent")
    others = light.select(kept).join(top_keys.withColumnRenamed("node", "parent"), "parent", "left_anti").join(parent(light), "parent")
    of_light = under_top.unionByName(others).join(totals, "node")
    of_top = top.select(kept).join(parent(top), "parent", "left").join(top_totals, "node").select(of_light.columns)
    none = hashlib.sha256(b"").hexdigest()
    return (
        of_light.unionByName(of_top).join(ends, "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )
