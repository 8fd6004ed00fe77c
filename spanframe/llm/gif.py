"""Media columns: GIF files in a binary column, decoded to timed frames with colour histograms.

The decoder reads any GIF87a or GIF89a: it unpacks sub-blocks, decodes the LZW code stream (growing codes, clear codes,
full tables, codes for the entry just being made), undoes interlacing, applies the local or global palette, transparency
and the disposal rules, and gives every frame as the composed canvas with its delay. The encoder is greedy LZW.

Payloads: bytes become grey pixels, `WIDTH` to a row and `ROWS` rows to a frame, with a palette in which entry i is the
grey (i, i, i); reading back takes them from the composed canvas, so the palette and drawing rules are really applied.

Defined cases: null is an empty text; a payload is never empty (it is padded with blanks); damaged files, and files whose
header asks for a canvas of over `MOST_PIXELS`, raise ValueError in decode_gif and give a null frame list in read_frames;
columns with the name of an added one are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

WIDTH, ROWS = 192, 128
DELAY = 10  # hundredths of a second
#: Pixels of the largest canvas that is decoded (four bytes each): a short file can ask for 16 GB.
MOST_PIXELS = 1 << 24
_GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


@dataclass
class Frame:
    """A composed canvas (rows, columns, RGBA) after drawing, the rectangle drawn, and its timing."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]
    delay: int
    disposal: int


# LZW ----------------------------------------------------------------------------------------------


@lru_cache(16)
def _widths(bits: int) -> np.ndarray:
    """Width of each code after a clear code, as far as the table grows; later codes have twelve bits."""
    free = (1 << bits) + 1 + np.arange((1 << 12) - (1 << bits))  # entries once the code is read: the first adds none
    return np.minimum(np.maximum(np.frexp(free.astype(float))[1], bits + 1), 12).astype(np.int64)


def _bit_starts(widths: np.ndarray) -> np.ndarray:
    return np.cumsum(widths) - widths


def lzw_encode(pixels: bytes, bits: int = 8) -> bytes:
    """Greedy LZW: the longest known string, code by code; a full table is cleared. Codes are packed at once."""
    clear = 1 << bits
    runs: list[list[int]] = []  # the codes between clear codes
    # pixels above the twelve bits of a code: together they are a key whose low bits spread well
    rest = iter((np.frombuffer(pixels, np.uint8).astype(np.int32) << 12).tolist())
    prefix = next(rest, -1) >> 12
    while prefix >= 0:
        table: dict[int, int] = {}
        known, codes, free = table.get, [], clear + 2
        put = codes.append
        runs.append(codes)
        for p in rest:
            if code := known(key := prefix | p):
                prefix = code
                continue
            put(prefix)
            prefix = p >> 12
            if free == 4096:
                break
            table[key] = free
            free += 1
        else:
            put(prefix)
            prefix = -1
    flat, width, schedule, before = [], [], _widths(bits), 0
    for codes in runs or [[]]:
        flat += [[clear], np.array(codes, np.int64)]
        width += [_run_widths(schedule, before + 1)[before:], _run_widths(schedule, len(codes))]
        before = len(codes)
    return _pack(np.concatenate([*flat, [clear + 1]]).astype(np.int64), np.concatenate([*width, _run_widths(schedule, before + 1)[before:]]))


def _run_widths(schedule: np.ndarray, n: int) -> np.ndarray:
    return schedule[:n] if n <= len(schedule) else np.concatenate([schedule, np.full(n - len(schedule), 12)])


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of 3 to 12 bits, least bit first."""
    bits = (codes[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def _codes(data: np.ndarray, start: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The codes at bit offsets of data, which has two spare bytes at its end."""
    byte = start >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return word >> (start & 7) & ((1 << widths) - 1)


def _strings(codes: np.ndarray, clear: int, most: int | None) -> np.ndarray:
    """The pixels of the codes between two clear codes; cut off once there are `most`.

    Dictionary entry e is what the e-th code stands for and the first pixel of the next one. So a code's string is that of
    an earlier code (its parent) and one pixel more, and all strings are written from their ends, parent after parent.
    """
    entry = codes - (clear + 2)
    own = np.arange(len(codes))
    if (entry >= own).any() or (entry >= 4096 - (clear + 2)).any():
        raise ValueError("LZW code out of range")
    parent = np.where(entry >= 0, entry, own)
    root, size = parent, (entry >= 0).astype(np.int64)
    while (root[root] != root).any():
        size += size[root]
        root = root[root]
    size += 1
    end = np.cumsum(size)
    if most is not None and len(end) and end[-1] > most:
        n = int(np.searchsorted(end, most)) + 1
        codes, entry, parent, root, size, end = codes[:n], entry[:n], parent[:n], root[:n], size[:n], end[:n]
    first = codes[root]
    last = np.where(entry >= 0, first[np.clip(entry + 1, 0, len(codes) - 1)], codes).astype(np.uint8)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    at, now = end - 1, np.arange(len(codes))
    while len(now):
        out[at] = last[now]
        more = np.flatnonzero(entry[now] >= 0)
        at, now = at[more] - 1, parent[now[more]]
    return out


def lzw_decode(data: bytes, bits: int, most: int | None = None) -> np.ndarray:
    """Palette indices of a code stream, little more than `most`; ValueError if it is damaged.

    Widths depend on the number of codes since the last clear code alone, so the codes up to the next one are cut out at
    once, and go through the dictionary together.
    """
    if not 1 < bits < 9:
        raise ValueError("LZW code size out of range")
    clear, schedule = 1 << bits, _widths(bits)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    end, at, size, run, out = 8 * len(data), 0, 0, [], []
    while True:
        done = sum(map(len, run))
        widths = _run_widths(schedule, done + 4096)[done:]
        start = at + _bit_starts(widths)
        fits = int(np.searchsorted(start + widths, end, "right"))
        codes = _codes(raw, start[:fits], widths[:fits])
        halt = np.flatnonzero((codes == clear) | (codes == clear + 1))
        halt = int(halt[0]) if len(halt) else fits
        run.append(codes[:halt])
        if halt == fits == len(widths):  # a long run with a full table
            at = int(start[-1] + widths[-1])
            continue
        out.append(_strings(np.concatenate(run), clear, None if most is None else most - size))
        size += len(out[-1])
        if halt == fits or codes[halt] != clear or (most is not None and size >= most):  # without a stop code: what there is
            return np.concatenate(out)
        at, run = int(start[halt] + widths[halt]), []


# Files --------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    full = len(data) // 255
    out = np.empty((full, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(frames: list[dict], size: tuple[int, int], palette: bytes = _GREY) -> bytes:
    """frames: pixels (2-d array of indices), and optionally x, y, delay, disposal, transparent, palette, interlace."""
    bits = max((len(palette) // 3 - 1).bit_length(), 1)
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF0 | bits - 1, 0, 0), palette.ljust(3 << bits, b"\0")]
    for f in frames:
        pixels, clear = np.asarray(f["pixels"], np.uint8), f.get("transparent")
        h, w = pixels.shape
        flags = f.get("disposal", 1) << 2 | (clear is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.get("delay", DELAY), clear or 0, 0))
        own, ownbits = f.get("palette"), bits
        if own:
            ownbits = max((len(own) // 3 - 1).bit_length(), 1)
        out.append(struct.pack("<BHHHHB", 0x2C, f.get("x", 0), f.get("y", 0), w, h, (0x80 | ownbits - 1 if own else 0) | 0x40 * bool(f.get("interlace"))))
        if own:
            out.append(own.ljust(3 << ownbits, b"\0"))
        if f.get("interlace"):
            pixels = pixels[_interlaced(h)]
        code = max(ownbits, 2)
        out.append(bytes([code]) + _blocks(lzw_encode(pixels.tobytes(), code)))
    return b"".join(out) + b";"


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> list[Frame]:
    """All frames in order, each with a canvas of its own; ValueError if the file is damaged."""
    return [replace(f, canvas=f.canvas.copy()) for f in frames_of(data)]


def frames_of(data: bytes) -> Iterator[Frame]:
    """The frames in order, one canvas for all of them: it is drawn on when the next frame is asked for."""
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise ValueError("damaged GIF") from e


def _frames(data: bytes):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        found = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return found

    def blocks() -> bytes:
        nonlocal at
        out = []
        while n := data[at]:
            if at + 1 + n > len(data):
                raise ValueError("damaged GIF")
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(out)

    if flags & 0x80:
        shared = palette(flags)
    if width * height > MOST_PIXELS:
        raise ValueError("canvas too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, clear, delay = 0, None, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            block = blocks()
            if label == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", block)
                disposal, clear = flags >> 2 & 7, index if flags & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("damaged GIF")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(flags) if flags & 0x80 else shared
        bits = data[at]
        at += 1
        if colours is None or x + w > width or y + h > height:
            raise ValueError("damaged GIF")
        index = lzw_decode(blocks(), bits, w * h)
        if len(index) < w * h:
            raise ValueError("damaged GIF")
        index = index[: w * h].reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(index)
            straight[_interlaced(h)] = index
            index = straight
        before = canvas[y : y + h, x : x + w].copy() if disposal == 3 else None
        rgba = np.full((256, 4), 255, np.uint8)
        rgba[: len(colours), :3] = colours
        drawn = rgba[index]
        if clear is not None:
            drawn = np.where((index == clear)[..., None], canvas[y : y + h, x : x + w], drawn)
        canvas[y : y + h, x : x + w] = drawn
        yield Frame(canvas, (x, y, w, h), delay, disposal)
        if disposal == 2:
            canvas[y : y + h, x : x + w] = 0
        elif disposal == 3:
            canvas[y : y + h, x : x + w] = before
        disposal, clear, delay = 0, None, 0


def histogram(rgba: np.ndarray) -> list[int]:
    """Counts of the visible pixels in eight ranges of red, green and blue."""
    seen = rgba.reshape(-1, 4)
    if (alpha := seen[:, 3]).size and not alpha.all():
        seen = seen[alpha > 0]
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c] >> 5, minlength=8)]


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(-(-len(text) // WIDTH), 1) * WIDTH, b" ")


def payload_gif(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_gif([{"pixels": rows[i : i + ROWS]} for i in range(0, len(rows), ROWS)], (WIDTH, min(len(rows), ROWS)))


def gif_payload(media: bytes) -> tuple[bytes, int, int, list[int]]:
    """The payload of a file, its frames, their time, and the colour histogram over all of them; frame by frame."""
    parts, time, counts = [], 0, np.zeros(24, np.int64)
    for f in frames_of(media):
        x, y, w, h = f.box
        parts.append(f.canvas[y : y + h, x : x + w, 0].tobytes())
        time += f.delay
        counts += histogram(f.canvas)
    return b"".join(parts), len(parts), time, counts.tolist()


# DataFrames ---------------------------------------------------------------------------------------


def _map(df: DataFrame, source: str, added: list[tuple[str, T.DataType]], row):
    """df with columns computed from the bytes of `source`, one row at a time within Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema, kept = C.out_schema(df, added)
    schema = to_arrow_schema(spark_schema)

    def run(batches):
        for batch in C.split_batches(batches, source):
            col = batch.column(batch.schema.get_field_index(source))
            data, offs = C.buffers(col)
            raw, offs = data.tobytes(), offs.tolist()
            valid = col.is_valid().to_pylist()
            new = [row(raw[a:b] if ok else None) for a, b, ok in zip(offs, offs[1:], valid, strict=False)]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            cols += [pa.array([r[i] for r in new], schema.field(len(kept) + i).type) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, spark_schema)


def store_gif(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with n_bytes and a binary column `out` of GIF files that hold the texts."""
    return _map(df, text, [("n_bytes", T.LongType()), (out, T.BinaryType())], lambda t: (len(t or b""), payload_gif(payload_of(t or b""))))


FRAME = T.ArrayType(T.StructType([T.StructField("delay_cs", T.IntegerType()), T.StructField("disposal", T.IntegerType()), T.StructField("box", T.ArrayType(T.IntegerType())), T.StructField("histogram", T.ArrayType(T.IntegerType()))]))


def read_frames(df: DataFrame, media: str = "media") -> DataFrame:
    """df with frames: delay, disposal, drawn box and colour histogram of each frame; null for null or damaged files."""

    def row(data):
        try:
            return ([{"delay_cs": f.delay, "disposal": f.disposal, "box": list(f.box), "histogram": histogram(f.canvas)} for f in frames_of(data or b"")],)
        except ValueError:
            return (None,)

    return _map(df, media, [("frames", FRAME)], row)


def read_payload(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, read from the stored files.

    feature: frames, total time and the colour histogram over all frames.
    """

    def row(data):
        payload, frames, time, counts = gif_payload(data)
        feature = f"{frames}/{time}/" + ",".join(map(str, counts))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature

    added = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return _map(df, media, added, row)


def op4_gif(spark, sf_dir: str) -> DataFrame:
    stored = store_gif(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = read_payload(stored.select("doc_id", "n_bytes", "media"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op4_gif": op4_gif}
ORACLES: dict[str, str] = {}
