"""Packing tokenised documents into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what remains of each is placed, longest
first, in the open window that it fits tightest, found by a segment tree over remaining capacities.
Placement runs in blocks of about ``BLOCK_PIECES`` pieces dealt by a hash of the piece, so a task never
sees more than one block. Pieces that are equal in every way are numbered where they are made and dealt by
that number too, so many repeated rows don't meet in one block either. Only lengths and checksums are
shuffled, not ids, unless these are asked for.

Defined results: null and empty texts hold the end id alone and are packed like others. Texts may be of any
length. Rows that repeat an id, and those without one, are packed as documents of their own. An empty table
gives an empty table. Only the id and the text are read, so extra columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import tokenizer
from .common import record_batches, texts

WINDOW, END_ID, BLOCK_PIECES = 2048, 1, 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"
#: Bytes of text to a token, to estimate the number of pieces with.
BYTES_A_TOKEN = 3
#: Bytes of ids after which a task hands on its pieces.
HELD_BYTES = 4 << 20
#: Slots in which a task counts equal pieces.
SLOTS, FEW = 1 << 16, 16


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over 0..capacity counts those of each range."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of a window with the least room of ``need`` or more; None when there is none."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            # up to the first right-hand neighbour that holds a window, then down to its smallest room
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, in the order given; lengths are 1 to ``capacity``."""
    windows, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free, opened = OpenWindows(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room, window = free.take(need) or (capacity, opened)
        opened += window == opened
        windows[k], offsets[k] = window, capacity - room
        if room > need:
            free.put(room - need, window)
    return windows, offsets


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Each document's ids, the end id last, cut into full windows and a rest; with the ids themselves on demand.

    ``copy`` tells apart pieces that fall into one slot of a task by their id and checksum, ``FEW`` at a time: it is 0 but
    for rows that are repeated often, or in tasks of some hundred thousand rows.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, met, task = tokenizer(path).encode, [0] * SLOTS, TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = encode(text) + end
                for at in range(0, len(data), 4 * window):
                    part = data[at : at + 4 * window]
                    crc = zlib.crc32(part)
                    slot = (crc ^ hash(doc)) % SLOTS
                    met[slot] += 1
                    copy = 0 if met[slot] < FEW else (task << 24) + met[slot] // FEW
                    out.append((doc, at // 4, len(part) // 4, crc, len(data) // 4, copy) + ((part,) if keep_ids else ()))
                    held += len(part)
                    if held >= HELD_BYTES:
                        yield from record_batches(out, schema)
                        out, held = [], 0
            yield from record_batches(out, schema)

    schema = PIECES + ", ids binary" * keep_ids
    return texts(docs, id_col, text_col).mapInArrow(cut, schema)


def place_pieces(pieces: DataFrame, n_pieces: int, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset. ``n_pieces`` sets the number of blocks only."""
    blocks = max(1, -(-n_pieces // block_pieces))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        # rows stay where they are and only their places are worked out, so ids are neither copied nor made Python objects
        order = np.lexsort([rows.column(c).to_numpy() for c in ("ids_crc32", "doc_tokens", "start", "doc_id", "id_null")])
        lengths = rows.column("length").to_numpy()[order]
        full = lengths == window
        in_order, offset = np.zeros((2, len(order)), dtype=np.int64)
        in_order[full] = np.arange(full.sum())
        windows, offset[~full] = best_fit_decreasing(lengths[~full], window)
        in_order[~full] = windows + full.sum()
        sequence, offsets = np.empty((2, len(order)), dtype=np.int64)
        sequence[order], offsets[order] = (key[0].as_py() << 40) + in_order, offset
        return rows.select(kept).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    whole = pieces.withColumn("id_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    kept = [f.name for f in whole.schema if f.name != "copy"]
    schema = ", ".join(f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    keyed = whole.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(blocks)))
    placed = keyed.groupBy("block").applyInArrow(place, schema)
    return placed.withColumn("doc_id", F.when(~F.col("id_null"), F.col("doc_id"))).drop("id_null")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    docs_and_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0))).first()
    n_pieces = docs_and_bytes[0] + docs_and_bytes[1] // (BYTES_A_TOKEN * window)
    return place_pieces(token_pieces(docs, path, id_col, text_col, window, end_id, keep_ids), n_pieces, window)
