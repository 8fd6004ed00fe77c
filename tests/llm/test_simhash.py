import random
import re

import numpy as np
import pytest
import xxhash

from spanframe.llm import simhash as S
from spanframe.llm.components import components


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(ids, prints):
    group = {i: {i} for i in ids}
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {i: min(g) for i, g in group.items()}


def close_prints(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(rng.integers(1, 7)):
            out.append(x)
            for _ in range(rng.integers(1, 6)):
                x ^= 1 << int(rng.integers(0, 64))
    return sorted(set(out))


def test_forest_joins_what_links():
    prints = close_prints(1, 150)
    u, v = S.forest(np.zeros(len(prints), np.int64), np.array(prints, np.uint64))
    edges = dict(zip(map(int, u), map(int, v), strict=True))

    def root(x):
        return root(edges[x]) if x in edges else x

    want = groups(prints, {p: p for p in prints})
    same = {}
    for p in prints:
        same.setdefault(root(p), set()).add(want[p])
    assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(want.values()))


def test_tables_cover_every_choice():
    for blocks in range(4, 9):
        masks = S.block_masks(blocks)
        rnd = random.Random(blocks)
        for _ in range(200):
            change = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(not change & m for m in masks)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_in_chunks(spark, chunk):
    from spanframe.llm.components import components

    prints = close_prints(2, 40) + [(7 << 40) ^ (1 << b) for b in range(30)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "p long")
    roots = {r.node: r.root for r in components(S.links(nodes, len(signed), chunk)).collect()}
    want = groups(signed, {s: p for s, p in zip(signed, prints, strict=True)})
    assert {p: roots.get(p, p) for p in signed} == want


def test_documents(spark):
    rnd = random.Random(3)
    base = " ".join(f"w{rnd.randint(0, 500)}" for _ in range(400))
    texts = [base, base, base.replace("w1 ", "w9 "), base + " end", None, "", " \t\n", "One two", "one TWO", "x", "Ünï cödé ΣΣ", "a" * 100_000]
    texts += [" ".join(f"v{rnd.randint(0, 50)}" for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    df = spark.createDataFrame([(i + 5, t, i) for i, t in enumerate(texts)] + [(5, base, 0)], "doc_id long, text string, root int")
    rows = S.near_duplicates(df).collect()
    prints = {i + 5: slow(t) for i, t in enumerate(texts)}
    want = groups(list(prints), prints)
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    stay = S.representatives(df)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values())) and stay.columns == df.columns


def test_missing_and_shared_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words stand here now"), (2, "a b c d"), (None, "zz yy xx ww"), (None, "zz yy xx ww"), (None, "a b c d"), (None, "solo text q"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.near_duplicates(df).count() == len(rows)
    kept = [(r.doc_id, r.text) for r in S.representatives(df).collect()]
    assert sorted(kept, key=repr) == sorted([(1, "a b c d"), (5, None), (None, "zz yy xx ww"), (None, "solo text q")], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.representatives(df).count() == 0


def test_links_are_made_once_for_all_rounds(spark):
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 5), (4, 4)], "u long, v long").mapInArrow(count, "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(2, 1), (3, 1), (9, 5)}
    assert rows.value == 4
    assert components(edges.limit(0)).count() == 0
