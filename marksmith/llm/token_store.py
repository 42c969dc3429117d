"""Token ids in a binary format: patched frame-of-reference blocks.

A segment holds whole documents, up to about ``SEGMENT_IDS`` ids. Its ids are cut into blocks of
``BLOCK`` ids. A block stores its minimum and the differences to it, packed at the width that holds
``PACKED_SHARE`` of them; the high bits of the others go to the block's exception list. Segment layout,
little-endian:

    magic "PFR1", n_ids u32, n_docs u32, n_blocks u32
    documents: id i64[n_docs], id is null u8[n_docs], n_tokens u32[n_docs]
    index:     block start u32[n_blocks + 1], minimum u32[n_blocks], width u8[n_blocks], exceptions u16[n_blocks]
    blocks:    width bit planes of BLOCK / 8 bytes, then exception positions u8, then their high bits u32

Documents are range-partitioned and sorted by id; a partition is a shard, its segments numbered in
order, and the table of segments lies in a Parquet table in the shared folder, which Spark commits and
which any file system can hold. A document's start is its place in the segment, plus the segments
before it in its shard, plus the shards before.

A document is read without the others of its segment: the index says where the blocks that hold its ids
begin, and only those are decoded (``unpack_range``, ``read_documents``).

Defined results: null and empty texts hold the end id alone. Null ids come first. Rows that repeat an
id are stored one behind the other, in a fixed order; ranges part them by their texts, and equal rows by where they
were read, so that no task gets all rows of one id, or all without. Texts may be of any length; a segment holds a document whole. An
empty table gives an empty table. Only the id and the text are read, so extra columns may have any names and types.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import tokenizer
from .common import record_batches, shuffle_partitions, texts, written

BLOCK, PACKED_SHARE, SEGMENT_IDS, END_ID = 256, 0.9, 1 << 18, 2
HEAD_CHARS = 32
MAGIC = b"PFR1"
SEGMENTS = "shard int, segment int, n_ids long, payload binary"


def pack_segment(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment's bytes from its ids (uint32), documents and their lengths."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows = padded.reshape(n_blocks, BLOCK)
    lowest = rows.min(axis=1) if n_blocks else np.zeros(0, dtype=np.uint32)
    above = rows - lowest[:, None]
    place = int(np.ceil(PACKED_SHARE * BLOCK)) - 1
    bound = np.partition(above, place, axis=1)[:, place].astype(np.int64)
    width = np.frexp(bound)[1].astype(np.uint8)  # bits of the bound
    high = above >> width[:, None]
    outlier = high > 0
    n_out = outlier.sum(axis=1).astype(np.uint16)
    planes = [np.packbits((above >> j & 1).astype(np.uint8), axis=1, bitorder="little") for j in range(int(width.max(initial=0)))]
    block_of, position = np.nonzero(outlier)
    position, values = position.astype(np.uint8), high[outlier]
    ends = n_out.cumsum(dtype=np.int64)
    stack = np.stack(planes, axis=1) if planes else np.zeros((n_blocks, 0, BLOCK // 8), dtype=np.uint8)
    parts, starts, at = [], [0], 0
    for k, (w, end, n) in enumerate(zip(width.tolist(), ends.tolist(), n_out.tolist())):
        part = stack[k, :w].tobytes() + position[end - n : end].tobytes() + values[end - n : end].tobytes()
        parts.append(part)
        at += len(part)
        starts.append(at)
    head = struct.pack("<4sIII", MAGIC, len(ids), len(lengths), n_blocks)
    documents = doc_ids.astype("<i8").tobytes() + doc_null.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes()
    index = np.asarray(starts, dtype="<u4").tobytes() + lowest.astype("<u4").tobytes() + width.tobytes() + n_out.astype("<u2").tobytes()
    return b"".join([head, documents, index, *parts])


class Segment:
    """A segment's head, documents and index; its blocks are decoded as they are asked for."""

    def __init__(self, data: bytes):
        magic, self.n_ids, n_docs, self.n_blocks = struct.unpack_from("<4sIII", data)
        if magic != MAGIC:
            raise ValueError("not a segment of this format")
        self.data, at = data, struct.calcsize("<4sIII")

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        self.doc_ids, self.doc_null, self.lengths = column("<i8", n_docs), column("u1", n_docs), column("<u4", n_docs)
        self.starts, self.lowest = column("<u4", self.n_blocks + 1), column("<u4", self.n_blocks)
        self.width, self.n_out = column("u1", self.n_blocks), column("<u2", self.n_blocks)
        self.body = at

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from ``first`` up to ``last``, padding included."""
        n, width = last - first, self.width[first:last]
        ids = np.zeros((n, BLOCK), dtype=np.uint32)
        planes = np.zeros((int(width.max(initial=0)), n, BLOCK // 8), dtype=np.uint8)
        patches = []
        for k, (start, w, out) in enumerate(zip((self.starts[first:last].astype(np.int64) + self.body).tolist(), width.tolist(), self.n_out[first:last].tolist())):
            size = w * BLOCK // 8
            planes[:w, k] = np.frombuffer(self.data, dtype=np.uint8, count=size, offset=start).reshape(w, BLOCK // 8)
            if out:
                position = np.frombuffer(self.data, dtype=np.uint8, count=out, offset=start + size)
                patches.append((k, position, np.frombuffer(self.data, dtype="<u4", count=out, offset=start + size + out) << np.uint32(w)))
        for j, plane in enumerate(planes):
            ids |= np.unpackbits(plane, axis=1, bitorder="little").astype(np.uint32) << np.uint32(j)
        for k, position, high in patches:
            ids[k, position] |= high
        ids += self.lowest[first:last, None]
        return ids.reshape(-1)


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, doc_null, lengths) from a segment's bytes."""
    segment = Segment(data)
    return segment.blocks(0, segment.n_blocks)[: segment.n_ids], segment.doc_ids, segment.doc_null, segment.lengths


def unpack_range(segment: Segment, start: int, length: int) -> np.ndarray:
    """``length`` ids from ``start`` on, from the blocks that hold them."""
    first, last = start // BLOCK, -(-(start + length) // BLOCK)
    return segment.blocks(first, last)[start - first * BLOCK :][:length]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents in order of id; returns the table of segments (shard, segment, n_ids, payload)."""
    end = int(end_id).to_bytes(4, "little")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number = tokenizer(path).encode, TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            ids = np.frombuffer(b"".join([x[2] for x in held]), dtype="<u4")
            payload = pack_segment(ids, np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.array([len(x[2]) // 4 for x in held]))
            row = [(shard, number, len(ids), payload)]
            held.clear()
            number, size = number + 1, 0
            return next(record_batches(row, SEGMENTS))

        for batch in batches:
            for doc, null, text in zip(*[batch.column(c).to_pylist() for c in ("id", "id_null", "text")]):
                data = encode(text) + end
                held.append((doc, null, data))
                size += len(data) // 4
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    rows = texts(docs, id_col, text_col)
    keys = {"head": F.substring("text", 1, HEAD_CHARS), "tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    order = ("doc_id", *keys)  # beyond the id, what parts rows that repeat it
    ordered = rows.withColumns(keys).repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    flat = ordered.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("id_null"), "text")
    return written(flat.mapInArrow(segments, SEGMENTS), "tokens")


def read_tokens(segments: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored segments (and its ids, uint32 bytes)."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, segment, payload in zip(batch["shard"], batch["segment"], batch["payload"]):
                ids, doc_ids, doc_null, lengths = unpack_segment(payload)
                data, ends = ids.astype("<u4").tobytes(), lengths.cumsum(dtype=np.int64)
                parts = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                rows = pd.DataFrame({
                    "shard": shard, "segment": segment, "id": doc_ids, "id_null": doc_null.astype(bool),
                    "within": ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(p) for p in parts],
                })
                yield rows.assign(ids=parts) if keep_ids else rows

    sizes = segments.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # a row for each partition of the writer
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("earlier", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(shards, F.col("shard") == F.col("s"))
        .select("shard", "segment", (F.col("earlier") + F.col("shard_start")).alias("base"))
    )
    schema = "shard int, segment int, id long, id_null boolean, within long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    found = segments.select("shard", "segment", "payload").mapInPandas(documents, schema).join(starts, ["shard", "segment"])
    return found.select(
        F.when(~F.col("id_null"), F.col("id")).alias("doc_id"), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * keep_ids)
    )


def read_documents(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids: uint32 bytes) of the stored documents whose id is in ``wanted`` (doc_id).

    Segments' heads are read for their documents' ids; of those that hold a wanted one, only the blocks with its ids are decoded.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, number, payload in zip(batch["shard"], batch["segment"], batch["payload"]):
                s = Segment(payload)
                ends = s.lengths.cumsum(dtype=np.int64)
                yield pd.DataFrame({"shard": shard, "segment": number, "id": s.doc_ids, "start": ends - s.lengths, "n": s.lengths.astype(np.int64)})[s.doc_null == 0]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload, places in zip(batch["payload"], batch["places"]):
                s = Segment(payload)
                rows = [(p["id"], p["n"], unpack_range(s, p["start"], p["n"]).astype("<u4").tobytes()) for p in places]
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids"])

    places = segments.select("shard", "segment", "payload").mapInPandas(listed, "shard int, segment int, id long, start long, n long")
    asked = places.join(wanted.select(wanted["doc_id"].cast("long").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_semi")
    by_segment = asked.groupBy("shard", "segment").agg(F.collect_list(F.struct("id", "start", "n")).alias("places"))  # at most a segment's documents
    return segments.join(by_segment, ["shard", "segment"]).select("payload", "places").mapInPandas(cut, "doc_id long, n_tokens long, ids binary")
