import math
import random
import re

from pyspark.sql import functions as F

from spanframe.llm import mixing as M


def fill(sizes):
    """Targets by clamping and resharing round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, clamped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(3 * sizes[s] for s in clamped)
        share = sum(weight[s] for s in free)
        target = {s: 3 * sizes[s] if s in clamped else left * weight[s] / share for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        clamped |= over


def check(rows, got):
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = fill(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    return {s: taken[s] - want[s] for s in sizes}


def test_targets_and_sample(spark):
    rnd = random.Random(1)
    for trial in range(3):
        names = ["src10", "src2", "Zed", "éa", None, "", "😀", "�"][: 3 + 2 * trial]
        rows = [(i if i % 9 else None, rnd.choice(names[: 2 + i % (len(names) - 1)]), " \t".join("w" * rnd.randint(0, 40)) if rnd.random() > 0.1 else None) for i in range(200)]
        df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, source string, text string, SIZE int, bucket string").repartition(4)
        got = M.mix(df)
        assert got.columns.count("size") == 1 and "bucket" in got.columns
        collected = got.collect()
        assert len(collected) == len(rows)
        # a word for rounding, and one for each of the rows without id that share a place in a source
        shared = {s: sum(i is None and x == s for i, x, _ in rows) for s in names}
        assert all(abs(x) <= 1 + shared[s] for s, x in check(rows, collected).items())
        key = lambda r: repr((r.doc_id, r.source, r.text, r.taken))
        assert sorted(map(key, collected)) == sorted(map(key, M.mix(df.repartition(2)).collect()))


def test_repetitions_take_effect(spark):
    rows = [(i, f"s{i % 3}" if i > 5 else "s9", " x".join(f" w{j}" for j in range(i % 23))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = M.mix(df)
    copies = M.repeat(mixed)
    counted = copies.withColumn("n", M.word_count()).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r.doc_id: r.n for r in counted.collect()} == {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    kept = M.mix_stage(spark, df.withColumn("n_chars", F.length("text").cast("long")), "")
    assert kept.columns == ["doc_id", "source", "text", "n_chars"] and kept.where(F.length("text") != F.col("n_chars")).count() == 0


def test_small_cases(spark):
    schema = "doc_id long, source string, text string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    assert [(r.size, r.target, r.taken) for r in M.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], schema)).collect()] == [(0, 0.0, 0)] * 2
    same = M.mix(spark.createDataFrame([(1, "a", "x y z")] * 4 + [(2, "b", "x " * 100)], schema)).collect()
    assert sum(r.taken for r in same) == 112 and max(r.taken for r in same if r.source == "a") <= 9
