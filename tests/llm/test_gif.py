import hashlib
import zlib

import numpy as np
import pytest

from spanframe.llm import gif as G


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 24576, 24577, 300_000])
def test_payload_round_trip(n):
    payload = G.payload_of(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    assert len(payload) % 192 == 0 and payload
    assert G.gif_payload(G.payload_gif(payload))[0] == payload


def plain_decode(data, bits):
    """Code by code with a table of strings, as the format's description has it."""
    clear, stop = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, out, before = base[:], bits + 1, b"", None
    stream, at = int.from_bytes(data, "little"), 0
    while True:
        code = stream >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, before = base[:], bits + 1, None
            continue
        if code == stop:
            return out
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        before = entry


@pytest.mark.parametrize("kinds", [2, 4, 256])
def test_lzw(kinds):
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 300, 5000, 70_000):
        x = rng.integers(0, kinds, n, dtype=np.uint8)
        for y in (x, np.tile(x[:7], n)[:n], np.zeros(n, np.uint8)):  # repeats give codes for the entry being made
            for bits in (2 if kinds <= 4 else 8, 8):
                coded = G.lzw_encode(y.tobytes(), bits)
                assert G.lzw_decode(coded, bits).tobytes() == y.tobytes()
                if n <= 5000:
                    assert plain_decode(coded, bits) == y.tobytes()


def test_lzw_is_bounded_and_late_clears_are_read():
    zeros = G.lzw_encode(bytes(100_000))
    assert 900 <= len(G.lzw_decode(zeros, 8, 900)) < 1500
    # a full table that is never cleared: literals in 12 bits for ever
    x = np.random.default_rng(1).integers(0, 256, 12_000).astype(np.int64)
    codes = np.concatenate([[256], x, [257]])
    widths = np.concatenate([[9], G._run_widths(G._widths(8), len(x)), [12]])
    assert (G.lzw_decode(G._pack(codes, widths), 8) == x).all()
    for bad in (b"", b"\xff\xff\xff"):
        try:
            assert not len(G.lzw_decode(bad, 8))
        except ValueError:
            pass


def test_prose_gets_smaller():
    prose = G.payload_of(b" ".join([b"the quick brown fox jumps over a lazy dog and runs away from here"] * 30))
    assert len(G.payload_gif(prose)) < len(prose)


def test_canvas_is_bounded():
    import struct

    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    with pytest.raises(ValueError):
        G.decode_gif(huge)


def test_palettes_disposal_transparency_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9, 7, 7, 7])
    full = np.ones((9, 4), np.uint8)
    part = np.array([[2, 0], [0, 2]], np.uint8)
    frames = G.decode_gif(
        G.encode_gif(
            [
                {"pixels": full, "delay": 5, "disposal": 1, "interlace": True},
                {"pixels": part, "x": 1, "y": 1, "transparent": 0, "disposal": 3, "delay": 7},
                {"pixels": np.array([[1]], np.uint8), "palette": own, "x": 3, "y": 8, "disposal": 2},
                {"pixels": np.array([[3]], np.uint8), "disposal": 0},
            ],
            (4, 9),
            palette,
        )
    )
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert [f.delay for f in frames] == [5, 7, 10, 10] and (frames[0].canvas == red).all()
    assert frames[1].canvas[1, 1].tolist() == green and frames[1].canvas[1, 2].tolist() == red
    assert frames[2].canvas[1, 1].tolist() == red and frames[2].canvas[8, 3].tolist() == [7, 7, 7, 255]  # what was before came back
    assert frames[3].canvas[8, 3].tolist() == [0, 0, 0, 0] and frames[3].canvas[0, 0].tolist() == blue
    assert sum(G.histogram(frames[3].canvas)[:8]) == 35  # the cleared pixel is not seen
    rows = np.arange(9)
    rows[G._interlaced(9)] = np.arange(9)
    assert sorted(rows) == list(range(9))


def test_damaged_files():
    good = G.payload_gif(G.payload_of(b"text" * 100))
    for bad in (b"", b"GIF89a", good[:50], good[:-200], b"PNG" + good, good[:800] + b"\xff" * 20):
        with pytest.raises(ValueError):
            G.decode_gif(bad)


def test_columns(spark, tmp_path):
    texts = ["abc", "abc", "", None, "é" * 500, "z" * 60_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, MEDIA string")
    G.store_gif(df).drop("text").write.parquet(str(tmp_path / "media"))
    stored = spark.read.parquet(str(tmp_path / "media"))
    rows = {r.doc_id: r for r in G.read_payload(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(-(-len(raw) // 192), 1) * 192 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[0][1:] == rows[1][1:] and rows[0].media_sha256 != rows[4].media_sha256
    frames = {r.doc_id: r.frames for r in G.read_frames(stored).collect()}
    assert [len(frames[i]) for i in (0, 5)] == [1, 3] and sum(frames[0][0].histogram[:8]) == 192
    broken = spark.createDataFrame([(bytearray(b"no"),), (None,)], "media binary")
    assert [r.frames for r in G.read_frames(broken).collect()] == [None, None]
    assert G.store_gif(spark.createDataFrame([], "doc_id long, text string")).count() == 0
