import random

import numpy as np

from spanframe.llm import similar as S
from spanframe.llm import simhash


def brute(texts):
    """Pairs of texts by Jaccard similarity of their shingles."""
    sets = [frozenset(S.shingles((t or "").encode()).tolist()) for t in texts]
    out = {}
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] or sets[j]:
                out[j, i] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            else:
                out[j, i] = 1.0
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    texts = [None, "", "  ", "short text", "short text"]
    while len(texts) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            copy = base[:]
            for _ in range(rnd.randint(1, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    return texts


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    prints = []
    for b in base:
        for _ in range(5):
            bits = np.unpackbits(b.view(np.uint8), bitorder="little")
            flip = rng.choice(256, rng.integers(0, 60), replace=False)
            bits[flip] ^= 1
            prints.append(np.packbits(bits, bitorder="little").view(np.uint64))
    prints = np.array(prints)
    distance = lambda i, j: int(np.unpackbits((prints[i] ^ prints[j]).view(np.uint8)).sum())
    planes, n = S.planes_of(prints), len(prints)
    for most in (0, 3, S.radius(), 63):
        for lag in (1, 2, 63, 64, 65, 130):
            same = np.zeros(64 * (planes.shape[1] - 1), np.uint8)
            same[: n - lag] = 1
            got = S.close_at_lag(planes, np.packbits(same, bitorder="little").view(np.uint64), lag, most)
            assert sorted(got.tolist()) == [i for i in range(n - lag) if distance(i, i + lag) <= most]
    u, v = S.forest(np.zeros(n, np.int64), np.arange(n), prints, S.radius())
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if distance(i, j) <= S.radius():
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    root = list(range(n))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        root[a] = b
    assert root == label


def test_recall_and_precision(spark):
    texts = corpus(3, 700)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    prints = S.add_fingerprint(df)
    got = prints.join(S.groups(prints.select("doc_id", "_print"), "doc_id"), "_print").select("doc_id", "component_id").collect()
    group = {r.doc_id: r.component_id for r in got}
    assert len(group) == len(texts)
    pairs = brute(texts)
    similar = [p for p, s in pairs.items() if s >= S.SIMILARITY]
    assert len(similar) > 100 and np.mean([group[i] == group[j] for i, j in similar]) >= 0.95
    # what is linked is linked by similar ones: nothing far from all others is in a group
    for i in range(len(texts)):
        if group[i] != i:
            assert max(s for p, s in pairs.items() if i in p) > 0.5


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus(4, 200)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(7, texts[7], "en"), (None, texts[9], None), (None, "alone without id", None), (None, "alone without id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = S.dedup_stage(spark, df, "")
    assert kept.columns == df.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == 1
    prints = S.add_fingerprint(df)
    least = {r.component_id for r in S.groups(prints.select("doc_id", "_print"), "doc_id").collect()}
    assert set(ids) == least - {None}
    assert S.dedup_stage(spark, df.limit(0), "").count() == 0


def test_narrow_groups_are_as_before(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "other words here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == [1, 3]
