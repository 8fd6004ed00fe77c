"""SimHash near-duplicate groups, compared on vertical bit planes.

Fingerprint: a bit is 1 if it is set in over half the XXH64 (seed 42) of a text's 3-word shingles.

Links are pairs of fingerprints that differ in 3 bits at most. Equal fingerprints are one node. With the 64 bits cut into
b blocks, two linked fingerprints agree on at least b - 3 of them, so every choice of b - 3 blocks is a table whose key
is the content of these blocks, and rows with equal keys are compared. The number of blocks follows the number of
fingerprints, which changes the work but never the result. In a task all rows are sorted by key and stored as 64 bit
planes; lag after lag, each row is compared with the row so many places on, 64 pairs to a machine word, by carry-save
counters of three bits; words in which every pair has passed the radius are abandoned. A task gives a spanning forest of
its links, never all pairs. Keys with very many rows are dealt out again as pairs of chunks.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others; repeated rows each get a row;
a component whose ids are all null has component_id null; columns of the input with the name of an added one are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import components

RADIUS = 3
SHINGLE = 3
#: Rows that one task compares with each other; keys with more are dealt out as pairs of chunks of this size.
CHUNK = 4096
#: The number of blocks is the least for which a key of evenly spread fingerprints has at most so many rows.
PER_KEY = 32
#: Fingerprints fit in so many rows of a task.
ROWS_A_TASK = 200_000

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: ASCII letters, and the white space 20 and 09-0D
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = max(len(words) - SHINGLE + 1, 1)
    start, end = (end - size)[:n].tolist(), end[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(start, end, strict=True)], np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        set_in += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(text: str, kept: list[str], schema: pa.Schema):
    def run(batches):
        for batch in C.split_batches(batches, text):
            data, offs = C.buffers(batch.column(batch.schema.get_field_index(text)))
            raw, offs = data.tobytes(), offs.tolist()
            prints = np.array([fingerprint(raw[a:b]) for a, b in zip(offs, offs[1:], strict=False)], np.uint64).view(np.int64)
            cols = [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(prints)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "_print") -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, kept = C.out_schema(docs, [(out, T.LongType())])
    return docs.mapInArrow(_fingerprints(text, kept, to_arrow_schema(schema)), schema)


# Comparison ---------------------------------------------------------------------------------------


def block_masks(blocks: int) -> list[int]:
    """The 64 bits in so many blocks; the mask of each choice of blocks - RADIUS of them."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(x) for x in combinations(masks, blocks - RADIUS)]


def blocks_for(n: int) -> int:
    for blocks in range(RADIUS + 1, 12):
        bits = min(bin(m).count("1") for m in block_masks(blocks))
        if n / 2**bits <= PER_KEY:
            return blocks
    return 12


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i of word j in row b: bit b of fingerprint 64 j + i. One spare word at the end."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.view(np.uint8), bitorder="little").reshape(-1, 64)
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    return np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)


def close_at_lag(planes: np.ndarray, same: np.ndarray, lag: int) -> np.ndarray:
    """Rows i whose fingerprint is within the radius of that of row i + lag; same: words of rows that may be compared."""
    q, r = divmod(lag, 64)
    words = planes.shape[1] - 1
    live = np.flatnonzero(same[: words - q] != 0)
    over = ~same[live]
    ones, twos = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
    for b in range(64):
        row = planes[b]
        far = row[live + q] if r == 0 else (row[live + q] >> np.uint64(r)) | (row[live + q + 1] << np.uint64(64 - r))
        carry = row[live] ^ far
        ones, carry = ones ^ carry, ones & carry
        twos, carry = twos ^ carry, twos & carry
        over |= carry  # a fourth difference
        if b % 8 == 7:
            left = np.flatnonzero(over != _ONES)
            if not len(left):
                return live[:0]
            if 2 * len(left) < len(live):
                live, over, ones, twos = live[left], over[left], ones[left], twos[left]
    hit = np.flatnonzero(over != _ONES)
    bits = np.unpackbits((~over[hit]).view(np.uint8), bitorder="little").reshape(-1, 64)
    at, bit = np.nonzero(bits)
    return live[hit][at] * 64 + bit


def forest(key: np.ndarray, prints: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between rows of equal key."""
    nodes, node = np.unique(prints, return_inverse=True)
    label = np.arange(len(nodes))
    order = np.argsort(key, kind="stable")
    key, prints, node = key[order], prints[order], node[order]
    lag = 1
    while len(key) > 1:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        least, most = np.minimum.reduceat(label[node], first), np.maximum.reduceat(label[node], first)
        rows = np.repeat((size > lag) & (least != most), size)  # the rest is compared or joined already
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
            at = close_at_lag(planes, np.packbits(same, bitorder="little").view(np.uint64), lag)
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


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] and b[i], all of them roots; every node then points to the least root."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).T.tolist()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    new = np.arange(len(label))
    for x in list(parent):
        new[x] = root(x)
    return new[label]


def _compare(batches):
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    rows = pa.Table.from_batches(rows)  # bounded: hot keys come in chunks
    cell = np.asarray(rows["cell"].combine_chunks())
    prints = np.asarray(rows["p"].combine_chunks()).view(np.uint64)
    u, v = forest(cell, prints)
    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(nodes: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that join all linked fingerprints of nodes (p), n of them."""
    masks = block_masks(blocks_for(n))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.xxhash64(F.lit(i), F.col("p").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // ROWS_A_TASK)
    return deal(nodes.select("p", F.explode(tables).alias("key")), parts, chunk).mapInArrow(_compare, "u long, v long")


def deal(keyed: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """keyed (key and more) with cell for key, its rows dealt out by cell: a key with over `chunk` rows has a cell for every pair of its chunks."""
    rest = [c for c in keyed.columns if c != "key"]
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    hot = hot.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    # a chunk meets every chunk of its key: cell (i, j) holds both of them
    own = F.pmod(F.xxhash64(*rest, F.lit("chunk")), F.col("chunks")).cast("int")
    dealt = keyed.join(hot, "key", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(cell.alias("cell"), *rest).repartition(parts, "cell")


def groups(prints: DataFrame, id_col: str) -> DataFrame:
    """(_print, component_id) for every fingerprint of prints (id, _print)."""
    nodes = C.write_table(prints.groupBy(F.col("_print").alias("p")).agg(F.min(id_col).alias("least")), "simhash-nodes")
    root = components(links(nodes.select("p"), nodes.count()))
    group = nodes.join(root, nodes["p"] == root["node"], "left").select("p", "least", F.coalesce("root", "p").alias("root"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return group.select("p", "root").join(least, "root").select(F.col("p").alias("_print"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id, the least id of those that links reach.

    keep: the columns of docs that are returned, all by default; without the text it crosses no shuffle.
    """
    keep = [c for c in keep or docs.columns if c.lower() not in ("fingerprint", "component_id")]
    prints = add_fingerprint(docs.select(*dict.fromkeys([*keep, id_col, text])), text).select(*dict.fromkeys([*keep, id_col]), "_print")
    prints = C.write_table(prints, "simhash")
    digits = F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint")
    return prints.join(groups(prints.select(id_col, "_print"), id_col), "_print", "left").select(*keep, digits, "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fingerprints=add_fingerprint, grouping=groups) -> DataFrame:
    """Of each group the row with the least id; the groups of near_duplicates unless others are given.

    Rows whose id occurs once go by id alone, so their texts cross no shuffle unless the ids that go are too many to
    broadcast. Rows that share an id, or have none, are looked at by fingerprint: of those with their group's id one stays.
    """
    prints = C.write_table(fingerprints(docs.select(id_col, text), text).select(F.col(id_col).alias("_id"), "_print"), "simhash")
    ids = C.write_table(grouping(prints, "_id"), "simhash-groups")
    one = prints.groupBy("_id").agg(F.count("*").alias("n"), F.first("_print").alias("_print")).join(ids, "_print")
    shared = F.col("_id").isNull() | (F.col("n") > 1)
    gone = C.write_table(one.where(shared | (F.col("_id") != F.col("component_id"))).select("_id", shared.alias("_shared")), "simhash-gone")
    stay = docs.join(gone.where(F.col("_id").isNotNull()).select("_id"), docs[id_col] == F.col("_id"), "left_anti").where(F.col(id_col).isNotNull())
    odd = docs.join(gone.where("_shared").select("_id"), docs[id_col].eqNullSafe(F.col("_id")), "left_semi")
    odd = fingerprints(odd, text).join(ids, "_print").where(F.col(id_col).eqNullSafe(F.col("component_id")))
    odd = odd.groupBy("component_id", "_print").agg(F.min(F.struct(*docs.columns)).alias("d"))
    # rows without ids are one group's only where the whole group has none: then by fingerprint
    key = F.when(F.col("component_id").isNull(), F.col("_print").cast("string"))
    odd = odd.groupBy("component_id", key).agg(F.min("d").alias("d")).select("d.*")
    return stay.select(*docs.columns).unionByName(odd)


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
