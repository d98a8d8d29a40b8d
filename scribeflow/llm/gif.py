"""GIF: payloads as palette frames, decoded with timing, disposal and transparency.

The reader follows the format: screen, global and local palettes, LZW code
streams with growing code widths and clear codes, interlacing, graphic control
(delay, disposal, transparent index), and keeps each timed frame as a composited
RGB canvas with a colour histogram.  The writer stores a payload losslessly as
8-bit indices, 64 samples a row, up to ``FRAME_ROWS`` rows a frame, under a palette
of 256 colours (three bits of red and green, two of blue).

``stored`` makes a column of GIFs, ``with_frames`` reads one into a column of timed
frames with their histograms, ``frame_table`` has a row per frame with its canvas.

Defined cases: null and empty texts give one frame of 64 zero bytes; texts of any
length take as many frames as they need; repeated rows give repeated results; null
ids pass through; other columns are ignored; an empty table gives an empty result.
A broken stream raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
#: Decoded bytes after which a piece of rows ends.
PIECE_BYTES = 8 << 20
PALETTE = bytes(x for v in range(256) for x in (v & 0xE0, v << 3 & 0xE0, v << 6 & 0xC0))


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # (rows, columns), as stored
    delay_ms: int
    canvas: np.ndarray  # (screen rows, screen columns, 3), composited
    histogram: np.ndarray  # 64 bins: 2 bits of each colour


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """The code stream of some samples, first code a clear code."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    first = end + 1
    codes, table = [clear], {}
    emit, find = codes.append, table.get
    fresh = first
    own = data[0]
    for k in memoryview(data)[1:]:
        key = own << 8 | k
        code = find(key)
        if code is not None:
            own = code
            continue
        emit(own)
        if fresh < 4096:
            table[key] = fresh
            fresh += 1
        else:
            emit(clear)
            table.clear()
            fresh = first
        own = k
    emit(own)
    emit(end)
    return pack_codes(np.array(codes, np.uint16), min_bits)


def code_widths(n: int, min_bits: int) -> np.ndarray:
    """Bits of the first n codes behind a clear code."""
    room = np.arange(n) + (1 << min_bits) + 1
    room[:1] = 0
    return np.clip(np.ceil(np.log2(room + 1)).astype(np.int64), min_bits + 1, 12)


def pack_codes(codes: np.ndarray, min_bits: int) -> bytes:
    clears = np.flatnonzero(codes == 1 << min_bits)
    start = np.zeros(len(codes), np.int64)
    start[clears[clears + 1 < len(codes)] + 1] = clears[clears + 1 < len(codes)] + 1
    since = np.arange(len(codes)) - np.maximum.accumulate(start)
    width = code_widths(int(since.max()) + 1, min_bits)[since]
    bits = (codes[:, None] >> np.arange(12, dtype=np.uint16)) & np.uint16(1)
    return np.packbits(bits.astype(np.uint8)[np.arange(12)[None, :] < width[:, None]], bitorder="little").tobytes()


def unpack_codes(stream: bytes, min_bits: int) -> Iterator[np.ndarray]:
    """The codes between clear codes, up to the end code."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at = 8 * len(stream), 0
    # About one code for two bytes of a short stream; a full table has fewer than 4096.
    step = min(4096, max(64, len(stream)))
    while at < total:
        held: list[np.ndarray] = []
        known = 0
        while True:
            width = code_widths(known + step, min_bits)[known:]
            offset = at + np.cumsum(width) - width
            fits = offset + width <= total
            width, offset = width[fits], offset[fits]
            if not len(width):
                raise ValueError("code stream without an end code")
            byte = offset >> 3
            value = (data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)) >> (offset & 7).astype(np.uint32)
            value &= ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1)).astype(np.uint32)
            stop = np.flatnonzero((value == clear) | (value == end))
            if len(stop):
                at = int(offset[stop[0]] + width[stop[0]])
                yield np.concatenate([*held, value[: stop[0]]])
                if value[stop[0]] == end:
                    return
                break
            held.append(value)
            known += len(value)
            at = int(offset[-1] + width[-1])


def lzw_decode(stream: bytes, min_bits: int) -> bytes:
    """The samples of a code stream, all codes of it at once.

    The table entry of a code's number is the string of an earlier code and one sample
    more, which is what the output has from that code's place on.  So each code points
    to an earlier one; lengths add up along these pointers, and each sample is the one
    at the end of its chain.  Both are followed in doubling steps.
    """
    parts = [c.astype(np.int64) for c in unpack_codes(stream, min_bits) if len(c)]
    if not parts:
        return b""
    codes = np.concatenate(parts) if len(parts) > 1 else parts[0]
    size = np.array([len(p) for p in parts])
    begin = np.repeat(np.cumsum(size) - size, size)
    entry = codes - ((1 << min_bits) + 2)
    known = entry >= 0
    if (entry >= np.arange(len(codes)) - begin).any():
        raise ValueError("code beyond the table")
    # A root is its own parent.
    up = np.where(known, entry + begin, np.arange(len(codes)))
    steps, to = known.astype(np.int64), up
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        steps, to = steps + steps[to], further
    length = steps + 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    # Each sample's place in the entry's code; a root's sample is its own.
    source = np.arange(total) + np.repeat(np.where(known, start[up] - start, 0), length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    out = np.zeros(total, np.uint8)
    out[start[~known]] = codes[~known]
    return out[source].tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A payload, a positive multiple of ``width`` bytes, as frames of palette indices."""
    rows = len(payload) // width
    if not rows or len(payload) % width:
        raise ValueError(f"payload is no positive multiple of {width}")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), PALETTE]
    for top in range(0, rows, frame_rows):
        part = payload[top * width : (top + frame_rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colour bins, the top two bits of red, green and blue."""
    top = (canvas >> 6).astype(np.uint8)
    return np.bincount((top[..., 0] << 4 | top[..., 1] << 2 | top[..., 2]).ravel(), minlength=64)


def read_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composited in turn."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    columns, rows, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flag: int) -> np.ndarray:
        nonlocal at
        n = 3 << ((flag & 7) + 1)
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    shared = palette(flags) if flags & 0x80 else None
    ground = shared[back] if shared is not None and back < len(shared) else np.zeros(3, np.uint8)
    canvas = np.broadcast_to(ground, (rows, columns, 3)).copy()
    delay, disposal, clear_index = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            block = sub_blocks()
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", block)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(own) if own & 0x80 else shared
        min_bits = data[at]
        at += 1
        samples = np.frombuffer(lzw_decode(sub_blocks(), min_bits), np.uint8)
        if len(samples) < w * h:
            raise ValueError("frame is cut short")
        indices = samples[: w * h].reshape(h, w)
        if own & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(indices)
            plain[order] = indices
            indices = plain
        before = canvas.copy() if disposal == 3 else None
        high, wide = max(0, min(h, rows - top)), max(0, min(w, columns - left))
        area = canvas[top : top + high, left : left + wide]
        shown = colours[indices[:high, :wide]]
        if clear_index is None:
            area[...] = shown
        else:
            opaque = indices[:high, :wide] != clear_index
            area[opaque] = shown[opaque]
        yield Frame(left, top, indices, 10 * delay, canvas.copy(), histogram(canvas))
        if disposal == 2:
            canvas[top : top + h, left : left + w] = ground
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


FRAME = pa.struct(
    [("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("columns", pa.int32()), ("rows", pa.int32()), ("samples", pa.binary()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64()))]
)
FRAME_SQL = "struct<start_ms:bigint,delay_ms:int,left:int,top:int,columns:int,rows:int,samples:binary,rgb:binary,histogram:array<bigint>>"


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, image): each text as a GIF, padded by zeros to whole rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text", 4 << 20):
            sizes, images = [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                images.append(write_gif(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["id", "n_bytes", "image"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, image binary")


def framed(batches: Iterator[pa.RecordBatch], gif_col: str, rgb: bool, out: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column of timed frames, in pieces of bounded size.

    What an image holds is known only once it is decoded: a piece ends with the image
    that brings its decoded bytes over ``PIECE_BYTES``.
    """
    for b in slices(batches, gif_col, 4 << 20):
        images = b.column(b.schema.get_field_index(gif_col))
        first, size, rows = 0, 0, []
        for k in range(b.num_rows):
            data = images[k].as_py()
            own, start = [], 0
            for f in read_frames(data) if data else ():
                h, w = f.canvas.shape[:2]
                own.append({"start_ms": start, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "columns": w, "rows": h, "samples": f.indices.tobytes(), "rgb": f.canvas.tobytes() if rgb else None, "histogram": f.histogram})
                start += f.delay_ms
                size += f.indices.nbytes + 512 + (f.canvas.nbytes if rgb else 0)
            rows.append(own)
            if size > PIECE_BYTES or k + 1 == b.num_rows:
                part = b.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(FRAME))], names=[*b.schema.names, out])
                first, size, rows = k + 1, 0, []


def with_frames(df: DataFrame, gif_col: str = "image", rgb: bool = False, out: str = "frames") -> DataFrame:
    """Add an array of timed frames: place, palette indices as stored, histogram of the
    composited canvas and, with ``rgb``, the canvas.  A null image has no frames."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(f"array<{FRAME_SQL}>"))])
    return df.mapInArrow(lambda batches: framed(batches, gif_col, rgb, out), schema)


def frame_table(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """A row per frame of each GIF: its time, place, RGB canvas and histogram."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(gif_col).alias("image"))
    frames = with_frames(rows, "image", rgb=True).select("id", F.posexplode("frames").alias("frame", "f"))
    return frames.select("id", "frame", *[f"f.{k}" for k in ("start_ms", "delay_ms", "columns", "rows", "rgb", "histogram")])


def media_table(docs: DataFrame) -> DataFrame:
    """Digests of the payload as read back from the stored images, and features of their frames."""
    images = written(stored(docs), "images")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in framed(batches, "image", False, "frames"):
            rows, frames = [], b.column(5)
            for i, (size, media_bytes, media_sha) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                own = frames.values.slice(frames.offsets[i].as_py(), frames.offsets[i + 1].as_py() - frames.offsets[i].as_py())
                back = b"".join(own.field("samples").to_pylist())
                colours = np.sum([x.values.to_numpy() for x in own.field("histogram")], 0)
                told = f"frames={len(own)};ms={sum(own.field('delay_ms').to_pylist())};colours=" + ",".join(f"{k}:{v}" for k, v in enumerate(colours.tolist()) if v)
                rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), media_bytes, media_sha, told))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    told = images.select("id", "n_bytes", F.length("image").cast("long").alias("media_bytes"), F.sha2("image", 256).alias("media_sha256"), "image")
    return told.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
