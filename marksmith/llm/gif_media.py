"""GIF columns: payloads stored as animated GIF, and a decoder to timed frames with colour histograms.

The decoder reads palettes, LZW code streams, transparency and disposal, and composes each frame on the
canvas. A code stands for an earlier stretch of the pixels that it is part of, so a stream is decoded without
a loop over its codes: lengths, and then the place that each pixel is copied from, are resolved by doubling
pointers. The writer stores bytes losslessly as pixels of a grey palette, ``WIDTH`` to a row and up to
``FRAME_ROWS`` rows to a frame, and a frame for each further part.

Defined results: null and empty texts are a payload of one row of zeros. Long payloads take more frames.
Rows that repeat an id, or whole rows, are stored and read one by one. An empty table gives an empty table.
Only the named columns are read, so extra columns may have any names. ``read_gif`` raises ValueError for
bytes that are no GIF, or one that is cut off or damaged; ``frames`` gives such a row the frames before the
damage and one last row whose status says what is wrong. A null medium has no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record_batches, texts, written

WIDTH, FRAME_ROWS, DELAY_CS, BINS = 64, 1024, 10, 16
CODES, CLEAR, END = 4096, 256, 257
GREY = bytes(b for b in range(256) for _ in range(3))


@lru_cache
def _widths(clear: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths in bits of the codes after a clear code, until the table is full and a few more; and where each begins."""
    width = np.frexp(np.minimum(clear + 1.0 + np.arange(CODES - clear + 2), CODES - 1))[1].astype(np.int64)
    return width, np.concatenate([[0], width.cumsum()])


def lzw_encode(data: bytes) -> bytes:
    """LZW with 8-bit symbols; a clear code goes out whenever the table is full."""
    codes = [CLEAR]
    lengths = []
    begin, prefix = 1, data[0] << 8
    rest = iter(memoryview(data)[1:])
    while True:
        # a table of (prefix, byte) to the code that stands for both, moved left by a byte
        table: dict[int, int] = {}
        emit, get = codes.append, table.get
        free, full = (CLEAR + 2) << 8, CODES << 8
        for byte in rest:
            code = get(prefix | byte)
            if code:
                prefix = code
                continue
            emit(prefix >> 8)
            if free == full:
                emit(CLEAR)
                prefix = byte << 8
                break
            table[prefix | byte] = free
            free += 256
            prefix = byte << 8
        else:
            break
        lengths.append(len(codes) - begin)
        begin = len(codes)
    codes += [prefix >> 8, END]
    lengths.append(len(codes) - begin)
    full = _widths(CLEAR)[0]
    width = np.concatenate([[9], *[full[:n] for n in lengths]])
    bit = np.concatenate([[0], width.cumsum()])
    byte, value = bit[:-1] >> 3, np.asarray(codes, dtype=np.int64) << (bit[:-1] & 7)
    size = int(bit[-1] + 7) >> 3
    # codes don't share bits, so what falls into a byte adds up
    total = sum(np.bincount(byte + k, weights=value >> 8 * k & 255, minlength=size + 2) for k in range(3))
    return total[:size].astype(np.uint8).tobytes()


def _resolved(pointer: np.ndarray) -> np.ndarray:
    """Where pointers to earlier places, or to themselves, end."""
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def _stretch(codes: np.ndarray, clear: int) -> np.ndarray:
    """The pixels of a run of codes behind a clear code.

    Code number i, but for the first, defines entry i - 1: what code i - 1 stands for and the pixel behind that. So an
    entry is a stretch of the pixels themselves, one longer than the code before it.
    """
    n = len(codes)
    place = np.arange(n)
    literal = codes < clear
    defined_by = np.where(literal, place, codes - (clear + 2))
    if n and ((defined_by >= place) & ~literal).any():
        raise ValueError("a code is used before it is defined")
    pointer, length = defined_by, (~literal).astype(np.int64)
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            break
        length, pointer = length + length[pointer], further
    length += 1
    start = length.cumsum() - length
    source = np.arange(int(length.sum())) + np.repeat(np.where(literal, 0, start[defined_by] - start), length)
    pixels = np.zeros(len(source), dtype=np.uint8)
    pixels[start[literal]] = codes[literal]
    return pixels[_resolved(source)]


def lzw_decode(data: bytes, symbol_bits: int, size: int) -> np.ndarray:
    """The first ``size`` pixels of a code stream."""
    if not 1 <= symbol_bits <= 8:
        raise ValueError("a code size that GIF doesn't have")
    clear = 1 << symbol_bits
    stop = clear + 1
    padded = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    widths, offsets = _widths(clear)
    at, have, done = 0, 0, 0  # bit, pixels, codes since the last clear code
    parts: list[np.ndarray] = []
    begun: list[np.ndarray] = []  # those codes
    while have < size:
        # the codes up to the next clear code, as far as the table still grows; then as many again at the full width
        wide = widths[done:] if done < len(widths) else np.full(len(widths), 12)
        here = offsets[done:-1] - offsets[done] if done < len(widths) else 12 * np.arange(len(widths))
        fits = int(np.searchsorted(here + wide, 8 * len(data) - at, side="right"))
        bit = here[:fits] + at
        byte = bit >> 3
        raw = padded[byte] | padded[byte + 1] << np.uint32(8) | padded[byte + 2] << np.uint32(16)
        codes = (raw >> (bit & 7).astype(np.uint32) & ((1 << wide[:fits]) - 1).astype(np.uint32)).astype(np.int64)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(special[0]) if len(special) else fits
        begun.append(codes[:n])
        done += n
        if fits and not len(special):
            at += int(here[n - 1] + wide[n - 1])
            continue
        parts.append(_stretch(np.concatenate(begun), clear))
        have += len(parts[-1])
        if not fits or codes[n] == stop:
            break
        at += int(here[n] + wide[n])
        begun, done = [], 0
    if have < size:
        raise ValueError("the code stream ends early")
    return np.concatenate(parts)[:size] if parts else np.zeros(0, dtype=np.uint8)


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def write_gif(payload: bytes) -> bytes:
    """A grey animation that holds the payload (a positive multiple of WIDTH bytes)."""
    step = WIDTH * FRAME_ROWS
    rows = min(len(payload) // WIDTH, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), GREY]
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0)]
        out += [b"\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # height x width x RGBA of the whole screen, as shown

    def histograms(self) -> np.ndarray:
        """Pixels of the screen by their red, green and blue, each in BINS equal bins."""
        flat = self.canvas.reshape(-1, 4)[:, :3] // (256 // BINS)
        return np.bincount((flat + np.arange(3, dtype=np.uint8) * BINS).ravel(), minlength=3 * BINS).reshape(3, BINS)


def read_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, each with the screen as it is shown; ValueError where the bytes are no GIF or damaged."""
    try:
        yield from _read_gif(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _read_gif(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flag: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flag & 7)
        colours = np.full((256, 4), 255, dtype=np.uint8)
        if len(data) < at + 3 * n:
            raise IndexError
        colours[:n, :3] = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
        return colours.view(np.uint32).ravel()

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = palette(flags) if flags & 0x80 else None
    canvas = np.zeros((high, wide), dtype=np.uint32)  # RGBA in four bytes
    time, delay, disposal, transparent = 0, 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = sub_blocks()
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, width, height, flag = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette(flag) if flag & 0x80 else shared
        if colours is None or left + width > wide or top + height > high:
            raise ValueError("a frame without colours, or outside the screen")
        bits = data[at]
        at += 1
        pixels = lzw_decode(sub_blocks(), bits, width * height).reshape(height, width)
        if flag & 0x40:  # interlaced: rows come in four passes
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
            pixels = pixels[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + height, left : left + width]
        if transparent is None:
            area[:] = colours[pixels]
        else:
            drawn = pixels != transparent
            area[drawn] = colours[pixels[drawn]]
        yield Frame(left, top, width, height, time, delay, disposal, transparent, canvas.copy().view(np.uint8).reshape(high, wide, 4))
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas[:] = before
        time += delay
        delay, disposal, transparent = 0, 0, None


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, its payload padded by zeros to a positive multiple of 64)."""
    data = text.encode()
    return len(data), data + bytes(-len(data) % WIDTH if data else WIDTH)


STORED = "doc_id long, n_bytes long, media binary"
FRAMES = (
    "doc_id long, frame int, status string, start_cs long, delay_cs int, width int, height int, disposal int, "
    "red array<long>, green array<long>, blue array<long>, pixels binary"
)
REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the GIF of each text, in a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, payload = payload_of(text.as_py())
                held.append((doc, n, write_gif(payload)))
                size += len(held[-1][2])
                if size > 4 << 20:
                    yield from record_batches(held, STORED)
                    held, size = [], 0
            yield from record_batches(held, STORED)

    return written(texts(docs, id_col, text_col).mapInArrow(run, STORED), "media")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of GIFs of any origin: when it is shown and how long, colour histograms and RGBA pixels of the screen.

    ``status`` is ok; where a file can't be read any further, its last row has the reason there and nulls behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                if not data.is_valid:
                    continue
                k = 0
                try:
                    for f in read_gif(data.as_py()):
                        row = (doc, k, "ok", f.start_cs, f.delay_cs, f.canvas.shape[1], f.canvas.shape[0], f.disposal, *f.histograms().tolist(), f.canvas.tobytes())
                        yield from record_batches([row], FRAMES)
                        k += 1
                except ValueError as e:
                    yield from record_batches([(doc, k, str(e), *[None] * 9)], FRAMES)

    return media.select(media[id_col].alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, FRAMES)


def read_back(media: DataFrame) -> DataFrame:
    """Per document of store(): its payload read from the frames as shown, with checksums and the colour histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                gif, parts, counts, time = data.as_py(), [], np.zeros((3, BINS), dtype=np.int64), 0
                for f in read_gif(gif):
                    parts.append(f.canvas[: f.height, :, 0].tobytes())
                    counts += f.histograms()
                    time = f.start_cs + f.delay_cs
                payload = b"".join(parts)
                feature = f"{len(parts)}x{time}:" + ";".join(",".join(map(str, c)) for c in counts.tolist())
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            yield from record_batches(out, REPORT)

    return media.mapInArrow(run, REPORT)
