import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spanframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(len(w), 13)
        for s in range(len(w) - n + 1) if n else ():
            for i in range(len(doc) - n + 1):
                if doc[i : i + n] == w[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    ids = sorted(x for x in found if x is not None)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_matches_brute_force(spark, broadcast_bytes):
    rnd = random.Random(4)
    vocab = ["a", "B", "c1", "été", "dog", "x"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(str(i), text(rnd.choice([3, 4, 5, 12, 13, 14, 30])) + rnd.choice(["", " rare"])) for i in range(12)] + [("7", text(20)), ("e", ""), ("n", None), (None, text(15)), ("0", None)]
    docs = [text(rnd.randint(0, 60)) for _ in range(60)] + [text(5) + " " + (rnd.choice(items)[1] or "") + " " + text(9) for _ in range(30)] + [None, "", "...", "a " * 3000]
    df = spark.createDataFrame([(i, d, 9, "kept") for i, d in enumerate(docs)] + [(0, docs[0], 9, "kept")], "doc_id long, text string, N_HIT int, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = D.decontaminate(df, bench, broadcast_bytes=broadcast_bytes)
    assert "item_id" in got.columns and got.columns.count("n_hit") == 1
    rows = got.collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items)
        spans = list(zip(r.hit_spans[::2], r.hit_spans[1::2], strict=True))
        assert sum(b - a for a, b in spans) == r.n_hit


def test_empty_tables(spark):
    docs, bench = "doc_id long, text string", "item_id long, text string"
    assert D.decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b")], bench)).count() == 0
    got = D.decontaminate(spark.createDataFrame([(1, "a b c")], docs), spark.createDataFrame([], bench)).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (3, 0, False)


def test_winnowing_keeps_a_shared_span():
    for length in range(1, 14):
        k, w = D.grams(length)
        assert k + w - 1 == length and k >= 1 and w >= 1


def test_stage_keeps_clean_rows(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)), "en"), (2, "clean", "en"), (None, None, None)], "doc_id long, text string, lang string")
    kept = D.clean_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}
    assert kept.where(F.col("doc_id") == 1).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_equal_hashes_of_different_words_are_no_hit(spark, broadcast_bytes):
    """Words of two letters whose polynomial hashes modulo 2**64 are equal, alone, in windows, and both in the benchmark."""
    one, other = thue_morse(2048), thue_morse(2048, "b", "a")
    import numpy as np

    w = D.Words(np.frombuffer(f"{one} {other}".encode(), np.uint8), np.array([0, 4097]))
    assert w.hashes[0] == w.hashes[1] and w.word(0) != w.word(1)
    line = " ".join(f"w{i}" for i in range(6))
    texts = [one, other, f"{line} {one} {line} {line}", f"{line} {other} {line} {line}", f"x {one} y {other} z"]
    items = [("1", other), ("2", f"{line} {other} {line}"), ("3", f"{line} {one} {line}"), ("4", f"q {one}")]
    for some in (items[:1], items[:2], items):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = D.decontaminate(df, spark.createDataFrame(some, "item_id string, text string"), broadcast_bytes=broadcast_bytes)
        for r in got.collect():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], some)
