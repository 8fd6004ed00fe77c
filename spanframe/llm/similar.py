"""Near-duplicates at a similarity: five-word shingles, 0.8 or more, by wide SimHash fingerprints on vertical bit planes.

What `simhash` does for a radius of 3 of 64 bits is too narrow here: sets of shingles with a Jaccard similarity of 0.8 differ
in some 15 % of the bits. So fingerprints have 256 bits, and two link if they differ in `radius` bits at most: the expected
number at that similarity and `MARGIN` standard deviations more. Candidates agree in one of many tables on a seeded choice of
bits; the number of bits follows the number of fingerprints, so that tables stay selective, and the number of tables follows
from that, so that a pair just similar enough is met with a chance of `MEET`. Pairs in a table are compared as in `simhash`:
bit planes, 64 pairs to a word, here with carry-save counters of six bits, abandoned past the radius; a task gives a spanning
forest; keys with very many rows are dealt out as pairs of chunks. No cap on partners or candidates.

Recall is 0.95 or more for pairs at 0.8 and nearly one for more similar ones (`tests` measure it by brute force); texts
down to 0.7, and a few down to 0.6, can link too.

Defined cases: as in `simhash`: texts without words are alike, repeated rows are each other's copies, rows without ids count by
their fingerprint.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components
from .simhash import ROWS_A_TASK, _union, deal, representatives

SHINGLE, SIMILARITY, BITS = 5, 0.8, 256
MARGIN, MEET = 1.9, 0.98
#: Evenly spread fingerprints that share a key.
PER_KEY = 8
_WORDS = BITS // 64
_COUNTERS = 6
PRINT = T.StructType([T.StructField(f"w{i}", T.LongType()) for i in range(_WORDS)])


def bit_share(similarity: float = SIMILARITY) -> float:
    """Share of bits in which the fingerprints of two sets as similar as that differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float = SIMILARITY) -> int:
    p = bit_share(similarity)
    return min(int(BITS * p + MARGIN * math.sqrt(BITS * p * (1 - p))), (1 << _COUNTERS) - 1)


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's five-word shingles; of all its words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(len(words) - SHINGLE + 1, 1)
    start, end = (end - size)[:n].tolist(), end[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], 5) for a, b in zip(start, end, strict=True)], np.uint64, n))


def fingerprint(text: bytes) -> np.ndarray:
    """256 bits as four words: each bit is 1 if it is set in over half of the distinct shingles' hashes."""
    hashes = shingles(text)
    if not len(hashes):
        return np.zeros(_WORDS, np.uint64)
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        part = hashes[i : i + (1 << 13)]
        wide = np.stack([part, *(C.mix(part + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(1, _WORDS))], axis=1)
        count += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "_print") -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema, kept = C.out_schema(docs, [(out, PRINT)])
    schema = to_arrow_schema(spark_schema)

    def run(batches):
        for batch in C.split_batches(batches, text):
            data, offs = C.buffers(batch.column(batch.schema.get_field_index(text)))
            raw, offs = data.tobytes(), offs.tolist()
            prints = np.array([fingerprint(raw[a:b]) for a, b in zip(offs, offs[1:], strict=False)]).view(np.int64)
            words = pa.StructArray.from_arrays([pa.array(prints[:, i]) for i in range(_WORDS)], fields=list(schema.field(out).type))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)).cast(schema.field(n).type) for n in kept] + [words], schema=schema)

    return docs.mapInArrow(run, spark_schema)


# Comparison ---------------------------------------------------------------------------------------


def planes_of(prints: np.ndarray) -> np.ndarray:
    """BITS rows of words; bit i of word j in row b: bit b of fingerprint 64 j + i. One spare word at the end."""
    blocks = -(-len(prints) // 64)
    out = np.zeros((BITS, blocks + 1), np.uint64)
    for w in range(_WORDS):
        square = np.zeros(blocks * 64, np.uint64)
        square[: len(prints)] = prints[:, w]
        step, mask = 32, 0xFFFFFFFF
        while step:  # each block of 64 rows of 64 bits is turned by swapping quarters, quarters of quarters and so on
            part = square.reshape(-1, 2, step)
            low, high = part[:, 0], part[:, 1]
            swap = ((low >> np.uint64(step)) ^ high) & np.uint64(mask)
            low ^= swap << np.uint64(step)
            high ^= swap
            step >>= 1
            mask ^= mask << step if step else 0
            mask &= 0xFFFFFFFFFFFFFFFF
        out[64 * w : 64 * w + 64, :blocks] = square.reshape(blocks, 64).T
    return out


def close_at_lag(planes: np.ndarray, same: np.ndarray, lag: int, most: int) -> np.ndarray:
    """Rows i whose fingerprint differs from that of row i + lag in at most `most` bits; same: words of rows that may be compared."""
    q, r = divmod(lag, 64)
    words = planes.shape[1] - 1
    live = np.flatnonzero(same[: words - q] != 0)
    over = ~same[live]
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # counters begin so high that one difference too many overflows them
    first = (1 << _COUNTERS) - 1 - most
    counter = [np.full(len(live), ones if first >> k & 1 else 0, np.uint64) for k in range(_COUNTERS)]
    for b in range(BITS):
        row = planes[b]
        far = row[live + q] if r == 0 else (row[live + q] >> np.uint64(r)) | (row[live + q + 1] << np.uint64(64 - r))
        carry = row[live] ^ far
        for k in range(_COUNTERS):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 16 == 15 and b > most:
            left = np.flatnonzero(over != ones)
            if not len(left):
                return live[:0]
            if 2 * len(left) < len(live):
                live, over, counter = live[left], over[left], [c[left] for c in counter]
    hit = np.flatnonzero(over != ones)
    bits = np.unpackbits((~over[hit]).view(np.uint8), bitorder="little").reshape(-1, 64)
    at, bit = np.nonzero(bits)
    return live[hit][at] * 64 + bit


def forest(key: np.ndarray, node: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between rows of equal key."""
    nodes, node = np.unique(node, return_inverse=True)
    label = np.arange(len(nodes))
    order = np.argsort(key, kind="stable")
    key, prints, node = key[order], prints[order], node[order]
    lag = 1
    while len(key) > 1:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        least, greatest = np.minimum.reduceat(label[node], first), np.maximum.reduceat(label[node], first)
        rows = np.repeat((size > lag) & (least != greatest), size)  # the rest is compared or joined already
        if not rows.all():
            key, prints, node = key[rows], prints[rows], node[rows]
        if len(key) <= lag:
            break
        planes = planes_of(prints)
        while True:
            same = np.zeros(64 * (planes.shape[1] - 1), np.uint8)
            same[: len(key) - lag] = key[lag:] == key[:-lag]
            if not same.any():
                break
            at = close_at_lag(planes, np.packbits(same, bitorder="little").view(np.uint64), lag, most)
            a, b = label[node[at]], label[node[at + lag]]
            if (a != b).any():
                label = _union(label, a[a != b], b[a != b])
            lag += 1
            if lag & (lag - 1) == 0 or lag % 256 == 0:
                break  # leave out what is done
        if not same.any():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def tables_for(n: int) -> list[list[int]]:
    """For n fingerprints the masks (four signed words) of all tables."""
    bits = min(max(8, math.ceil(math.log2(max(n, 2) / PER_KEY))), 64)
    count = math.ceil(math.log(1 - MEET) / math.log(1 - (1 - bit_share()) ** bits))
    rng, out = np.random.default_rng(256), []
    for _ in range(count):
        mask = np.zeros(BITS, np.uint8)
        mask[rng.choice(BITS, bits, replace=False)] = 1
        out.append(np.packbits(mask, bitorder="little").view(np.int64).tolist())
    return out


def _compare(batches):
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    rows = pa.Table.from_batches(rows)  # bounded: hot keys come in chunks
    column = lambda c: np.asarray(rows[c].combine_chunks())
    prints = np.stack([column(f"w{i}") for i in range(_WORDS)], axis=1).view(np.uint64)
    u, v = forest(column("cell"), column("node"), prints, radius())
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def groups(prints: DataFrame, id_col: str) -> DataFrame:
    """(_print, component_id) for every fingerprint of prints (id, _print)."""
    nodes = prints.groupBy(F.col("_print").alias("p")).agg(F.min(id_col).alias("least"))
    nodes = C.write_table(nodes.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")
    n = nodes.count()
    words = [f"w{i}" for i in range(_WORDS)]
    flat = nodes.select("node", *[F.col("p")[w].alias(w) for w in words])
    masks = tables_for(n)
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, mask, strict=True)]) for i, mask in enumerate(masks)])
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // ROWS_A_TASK)
    edges = deal(flat.select("node", *words, F.explode(keys).alias("key")), parts).mapInArrow(_compare, "u long, v long")
    root = components(edges).withColumnRenamed("node", "_node")
    group = nodes.join(root, F.col("node") == F.col("_node"), "left").select("p", "least", F.coalesce("root", "node").alias("root"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return group.select("p", "root").join(least, "root").select(F.col("p").alias("_print"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group the document with the least id; of rows that repeat its id, one."""
    return representatives(docs, fingerprints=add_fingerprint, grouping=groups)
