import gzip
import hashlib
import random

import pytest

from spanframe.llm import warc as W


def test_chunked_framing():
    for n in (0, 1, 1499, 1500, 1501, 9000):
        data = bytes(i % 251 for i in range(n))
        assert W.unchunk(W.chunked(data)) == data
    assert W.unchunk(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n", b"3\r\nabcX0\r\n\r\n"):
        with pytest.raises(ValueError):
            W.unchunk(bad)


def test_reassembly():
    pieces = [(1, None, b"ab"), (2, None, b"cd"), (3, 5, b"e")]
    random.Random(1).shuffle(pieces)
    assert W.reassemble(pieces) == (b"abcde", "ok")
    assert W.reassemble([(1, None, b"ab"), (3, 5, b"e")])[0] is None
    assert W.reassemble([(1, None, b"ab"), (2, None, b"cd")])[0] is None
    assert W.reassemble([(1, None, b"ab"), (2, 9, b"cd")]) == (None, "wrong total length")
    assert W.reassemble([(1, None, b"ab"), (1, 4, b"cd")])[0] is None


@pytest.mark.parametrize("size", [0, 10, 1500, 1501, 4000, 50_000])
def test_records_parse_back(size):
    payload = bytes(random.Random(size).randrange(256) for _ in range(size))
    records = W.page_records(7, "http://x\r\nWARC-Type: evil", payload, None, False)
    for data in (b"".join(records), b"".join(map(gzip.compress, records))):
        parsed = list(W.parse(data))
        assert len(parsed) == len(records)
        headers = parsed[0][0]
        if len(records) > 1:
            block, status = W.reassemble([(int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, b) for h, b in reversed(parsed)])
        else:
            block, status = parsed[0][1], "ok"
        row = W.finish(headers, block, True, status)
        assert row[0] == 7 and row[2:5] == (size, hashlib.sha1(payload).hexdigest(), "response") and row[6] == payload
    with pytest.raises(ValueError):
        list(W.parse(records[0][:-3]))


@pytest.mark.parametrize("compress,archive", [(False, 1 << 23), (True, 20_000)])
def test_pages(spark, compress, archive):
    long, short = "é" * 3000, "s" * 999
    rows = [(1, "a", long), (2, "b", long), (9, None, long), (9, "z", long), (3, "c", short), (4, "d", short), (5, "e", None), (6, "f", "x" * 1000), (7, "g", "y" * 40_000), (-8, "h", "x" * 1000), (None, "n", "q" * 2000), (None, "n", "q" * 2000)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, revisit string").repartition(3)
    archives = W.write_archives(W.assign_revisits(df), compress=compress, archive=archive)
    assert archive > 1 << 20 or archives.count() > 3
    got = W.read_archives(archives).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    count = {}
    for r in got:
        count.setdefault((r.page_id, r.record_type, r.refers_to), []).append(r)
    want = {(1, "revisit", 9): 1, (2, "revisit", 9): 1, (9, "response", None): 1, (9, "revisit", 9): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (-8, "revisit", 6): 1}
    assert {k: len(v) for k, v in count.items() if k[0] is not None} == want
    raw = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(raw[r.page_id]), hashlib.sha1(raw[r.page_id]).hexdigest())
        assert r.record_type == "revisit" or bytes(r.payload) == raw[r.page_id]


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(W.assign_revisits(df))).count() == 0


def test_damaged_records_are_rows_and_the_others_are_read(spark):
    good = [b"".join(W.page_records(i, f"u{i}", bytes([65 + i]) * n, None, False)) for i, n in enumerate([10, 2000, 30_000, 50])]
    long = W.page_records(7, "u7", b"q" * 9000, None, False)
    wrong = good[0].replace(b"AAAAA", b"AAxAA")  # digest
    cut = good[1][: len(good[1]) // 2]
    archives = [
        good[0] + cut + good[3],
        b"no record at all" + good[2],
        b"".join(map(gzip.compress, [good[0]])) + gzip.compress(good[1])[:60] + gzip.compress(good[3]),
        wrong + long[0] + long[2],
        good[3].replace(b"Content-Length: ", b"Content-Length: x", 1),
        None,
    ]
    df = spark.createDataFrame([(f"a{i}", None if x is None else bytearray(x)) for i, x in enumerate(archives)], "name string, data binary")
    got = W.read_archives(df).collect()
    ok = sorted(r.page_id for r in got if r.status == "ok")
    assert ok == [0, 0, 2, 3, 3]
    bad = sorted((r.status, -1 if r.page_id is None else r.page_id) for r in got if r.status != "ok")
    assert bad == [("damaged", -1), ("damaged", -1), ("damaged", 1), ("damaged", 3), ("digest differs", 0), ("segments missing", 7)]
    assert all(r.payload is None and r.payload_bytes is None for r in got if r.status != "ok")
