import hashlib
import random
from collections import Counter

import pytest

from spanframe.llm import suffix as S


def brute(texts, span):
    count = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_deep_shallow_sorts():
    rnd = random.Random(5)
    for _ in range(100):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 30))]
        strings += [rnd.choice(strings) + b"x" * rnd.randint(0, 3) for _ in range(5)] + [b"y" * 50 + bytes([c]) for c in rnd.sample(range(256), 5)]
        order, lcp = S.deep_shallow(strings)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
        assert [int(x) for x in lcp[1:]] == [S.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_matches_brute_force(spark, hot):
    rnd = random.Random(7)
    span, gram = 40, 10
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(30)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passages, texts = [make(rnd.randint(10, 40)) for _ in range(6)], [None, "", "x" * 39, "x" * 40, "x" * 41]
    for _ in range(120):
        r = rnd.random()
        if r < 0.15:
            texts.append(rnd.choice(texts))
        elif r < 0.25:
            texts.append("ab " * rnd.randint(1, 60))
        elif r < 0.4:
            t = list(rnd.choice(texts) or "-")
            t[rnd.randrange(len(t))] = "#"
            texts.append("".join(t))
        elif r < 0.75:
            texts.append(make(rnd.randint(0, 20)) + rnd.choice(passages) + make(rnd.randint(0, 20)) + rnd.choice(["", *passages]))
        else:
            texts.append(make(rnd.randint(0, 60)))
    df = spark.createDataFrame([(i, t, "h", 3) for i, t in enumerate(texts)], "doc_id long, text string, h string, N_BYTES int").repartition(5)
    found = S.remove_repeated(df, span=span, gram=gram, hot=hot, cell_bytes=1500, kept=True)
    assert found.columns.count("n_bytes") == 1 and "h" in found.columns
    rows = S.kept_text(found).collect()
    assert len(rows) == len(texts)
    want = brute([(t or "").encode() for t in texts], span)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert r.kept_text == bytes(r.kept).decode(errors="replace")


def test_long_text_and_empty_table(spark):
    once = "".join(chr(97 + i % 26) + str(i) for i in range(300_000))
    df = spark.createDataFrame([(1, once), (2, "x" + once[1000:1500] + "y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.remove_repeated(df).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_bytes) == (500, 1, 500, 0)
    assert S.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [10_000, 3])
def test_equal_rolling_hashes_do_not_match(spark, hot, monkeypatch):
    """With hashes that tell nothing apart all is still right: bytes and digests decide."""
    import numpy as np

    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = make(70)
    texts = [make(60) for _ in range(4)] + [make(20) + passage + make(15) for _ in range(6)] + [make(30) + passage[:45]]
    monkeypatch.setattr(S, "_contexts", lambda data, pos, h, lo, hi, span: (lo, hi + span, np.zeros(len(pos), np.uint64)))
    cells = [(i, hashlib.md5(t.encode()).digest(), t.encode()) for i, t in enumerate(texts)]
    import pyarrow as pa

    rows = [pa.table({"cell": pa.array([i % 2 for i, _, _ in cells if i % 2 == c], pa.int32()), "h": [h for i, h, _ in cells if i % 2 == c], "text": pa.array([t for i, _, t in cells if i % 2 == c], pa.binary()), "n": [1 for i, _, _ in cells if i % 2 == c]}) for c in (0, 1)]
    span, gram, by = 40, 10, lambda t, *names: [t.filter(pa.array([k == key for key in zip(*(t[n].to_pylist() for n in names), strict=True)])) for k in sorted(set(zip(*(t[n].to_pylist() for n in names), strict=True)))]
    asked = pa.concat_tables([S._anchor_hashes(3, span, gram)(r) for r in rows])
    flags = pa.concat_tables([S._repeated(hot)(g) for g in by(asked, "bucket")])
    sent = pa.concat_tables([S._send(3, span, gram)(r, flags.filter(pa.compute.equal(flags["cell"], c))) for c, r in enumerate(rows)])
    found = pa.concat_tables([S._match(span)(g) for g in by(sent, "kind", "bucket")])
    want = {hashlib.md5(t.encode()).digest(): w for t, w in zip(texts, brute([t.encode() for t in texts], span), strict=True)}
    for c, r in enumerate(rows):
        out = S._remove(span, gram)(r, found.filter(pa.compute.equal(found["cell"], c))).to_pylist()
        assert len(out) == len(r) and all((x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == want[x["h"]] for x in out)
