"""Benchmark decontamination by winnowing.

Of each run of consecutive k-word hashes only the least survives (winnowing), in documents and benchmark items alike.
Any span of L = k + w - 1 shared words holds w consecutive k-grams, so both sides keep the same one: no shared span of
that length is missed. Matching fingerprints are joined and each match is extended to every whole window around it.
Hashes only propose windows: their words are compared as bytes before they count.

A benchmark whose text is up to `BROADCAST_BYTES` is one broadcast index, and the documents are read once without a
shuffle. Beyond that a filter of its fingerprints, of fixed size, is broadcast, and the documents' windows around
fingerprints that pass it are joined with the benchmark's windows by their words: again one pass, however large it is.

Windows are 13 words; an item of fewer words is one window of its own length, and each such length has its own k and w
(`grams`), so the guarantee holds for it too.

Defined cases: null or empty text has no words (n_words 0, not contaminated); an item without words has no window;
an item with null id marks words but is not listed; repeated document rows each get their own row; repeated items count
once. Columns of the input with the name of an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 13
#: A share of hit words of one in so many makes a document contaminated.
ONE_IN = 20
#: Benchmark text that is broadcast as an index; a larger one is joined.
BROADCAST_BYTES = 8 << 20
#: The filter for larger ones: so many sections of 4,096 bits, 16 MB in all.
SECTIONS = 1 << 15

# Lower-cased A-Z, then runs of 0-9, a-z and any byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_VALUE = C.byte_values(101)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]

_ADDED = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("n_items", T.LongType()),
    ("items_sha256", T.StringType()),
    ("contaminated", T.BooleanType()),
    ("item_ids", T.ArrayType(T.StringType(), False)),
    ("hit_spans", T.ArrayType(T.IntegerType(), False)),
]


def grams(length: int) -> tuple[int, int]:
    """k and w for windows of so many words: k + w - 1 == length."""
    k = min(5, (length + 1) // 2)
    return k, length - k + 1


class Words:
    """The words of a run of rows: their hashes and places, and the first word of each row (n + 1 bounds)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.first = C.find_words(data, offs, _WORD)
        self.hashes = C.span_hash(C.prefix_sums(_VALUE[data]), self.start, self.end)
        self._data, self._raw = data, None

    def word(self, i: int) -> bytes:
        """A word itself, A-Z in lower case."""
        if self._raw is None:
            self._raw = self._data.tobytes().lower()
        return self._raw[self.start[i] : self.end[i]]

    def text(self, at: int, length: int) -> bytes:
        return b" ".join([self.word(i) for i in range(at, at + length)])

    def numbers(self, at: np.ndarray, known: dict[bytes, int], grow: bool = False) -> np.ndarray:
        """For the words at these places their numbers in `known`, by their bytes; -1 for others."""
        if grow:
            return np.array([known.setdefault(self.word(i), len(known)) for i in at.tolist()], np.int32)
        return np.array([known.get(self.word(i), -1) for i in at.tolist()], np.int32)


def _gram_hash(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for t in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + t]
    return C.mix(h)


def fingerprints(words: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (position, hash) of all rows; first: the bounds of the rows in words."""
    n = len(words)
    if n < k + w - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hash(words, np.arange(n - k + 1), k)
    least = C.slide_min(h, w)
    row_end = np.repeat(first[1:], np.diff(first))
    least[np.arange(len(least)) + k + w - 1 > row_end[: len(least)]] = 0  # windows that run into the next row
    # a k-gram is kept if it is the least of some window: the greatest minimum around it equals it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(~C.slide_min(~padded, w) == h)
    return at, h[at]


def build_index(items: list[tuple[str | None, str | None]]) -> dict:
    """What is broadcast of a benchmark: its words by number, and by window length fingerprints and windows with their items."""
    w = Words(*C.buffers(pa.array([t for _, t in items], pa.large_string())))
    words, first = w.hashes, w.first
    known: dict[bytes, int] = {}
    number_of = w.numbers(np.arange(len(words)), known, grow=True)
    names = sorted({i for i, _ in items if i is not None})
    number = {i: n for n, i in enumerate(names)}
    own = np.array([number.get(i, -1) for i, _ in items], np.int64)
    size = np.diff(first)
    index = {"names": names, "known": known, "words": number_of, "lengths": {}}
    for length in sorted({int(x) for x in np.minimum(size, WINDOW) if x}):
        rows = np.flatnonzero(size >= WINDOW if length == WINDOW else size == length)
        at = C.concat_ranges(first[rows], first[rows + 1])
        k, w_ = grams(length)
        bounds = np.concatenate([[0], np.cumsum(size[rows])])
        _, prints = fingerprints(words[at], bounds, k, w_)
        starts = C.concat_ranges(bounds[:-1], bounds[1:] - length + 1)
        item = own[rows][np.searchsorted(bounds, starts, "right") - 1]
        hashes, place = _gram_hash(words[at], starts, length), at[starts]
        order = np.argsort(hashes, kind="stable")
        hashes, place, item = hashes[order], place[order], item[order]
        # a window is a run of equal hashes and equal words
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for t in range(length):
            new[1:] |= number_of[place[1:] + t] != number_of[place[:-1] + t]
        which = np.cumsum(new) - 1
        pairs = np.unique(np.stack([which, item]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        index["lengths"][length] = (np.unique(prints), hashes[new], place[new], np.searchsorted(pairs[0], np.arange(new.sum() + 1)), pairs[1])
    return index


def windows_around(at: np.ndarray, first: np.ndarray, length: int, k: int) -> np.ndarray:
    """Starts of all windows within their row that hold one of the k-grams at `at`."""
    row = np.searchsorted(first, at, "right") - 1
    return np.unique(C.concat_ranges(np.maximum(at - (length - k), first[row]), np.minimum(at, first[row + 1] - length) + 1))


def find_hits(index: dict, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """The words inside windows of the benchmark, and by row the items these windows are from."""
    words, first = w.hashes, w.first
    hit = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for length, (prints, windows, place, lo, item) in index["lengths"].items():
        k, w_ = grams(length)
        at, h = fingerprints(words, first, k, w_)
        at = at[C.member(prints, h)]
        if not len(at):
            continue
        starts = windows_around(at, first, length, k)
        h = _gram_hash(words, starts, length)
        a, b = np.searchsorted(windows, h), np.searchsorted(windows, h, "right")
        starts, a, b = starts[a < b], a[a < b], b[a < b]
        if not len(starts):
            continue
        used = np.unique(C.concat_ranges(starts, starts + length))
        mine = np.full(len(words), -1, np.int32)
        mine[used] = w.numbers(used, index["known"])
        row = np.searchsorted(first, starts, "right") - 1
        found = np.zeros(len(starts), bool)
        while (live := np.flatnonzero(a < b)).size:  # windows of equal hash, mostly one
            same = np.ones(len(live), bool)
            for t in range(length):
                same &= mine[starts[live] + t] == index["words"][place[a[live]] + t]
            ok = live[same]
            found[ok] = True
            for r, x in np.unique(np.stack([row[ok], a[ok]]), axis=1).T.tolist():
                items[r].update(index["names"][i] for i in item[lo[x] : lo[x + 1]])
            a[live] += 1
        np.add.at(hit, starts[found], 1)
        np.add.at(hit, starts[found] + length, -1)
    return np.cumsum(hit)[:-1] > 0, items


def _pass(index, kept: list[str], text: str, schema: pa.Schema):
    def run(batches):
        data = index.value
        for batch in C.split_batches(batches, text):
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            w = Words(*C.buffers(col(text)))
            hit, items = find_hits(data, w)
            first = w.first
            edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
            cut = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hit))]
            cut = np.unique(cut[hit[cut] & hit[cut - 1]]) if len(cut) else cut
            lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
            hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
            row = np.searchsorted(first, lo, "right") - 1
            spans = np.stack([lo - first[row], hi - first[row]], 1).astype(np.int32).ravel()
            bounds = 2 * np.searchsorted(lo, first)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_words, n_hit = np.diff(first), total[first[1:]] - total[first[:-1]]
            names = [sorted(items.get(r, ())) for r in range(batch.num_rows)]
            new = [
                n_words,
                n_hit,
                np.array([len(x) for x in names], np.int64),
                [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
                (n_hit > 0) & (ONE_IN * n_hit >= n_words),
                names,
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(spans, pa.int32())),
            ]
            cols = [col(n) for n in kept] + [x if isinstance(x, pa.Array) else pa.array(x, schema.field(len(kept) + i).type) for i, x in enumerate(new)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


# Beyond a broadcast --------------------------------------------------------------------------------

_WINDOWS = "length int, window binary, item string"


def _item_windows(batches):
    """(length, words, item) of the benchmark's windows, with their fingerprints on rows of their own (words null)."""
    schema = pa.schema([("length", pa.int32()), ("window", pa.binary()), ("item", pa.string()), ("print", pa.int64())])
    for batch in C.split_batches(batches, "t"):
        w, names, out = Words(*C.buffers(batch.column(1))), batch.column(0).to_pylist(), []
        for r, name in enumerate(names):
            a, b = int(w.first[r]), int(w.first[r + 1])
            length = min(b - a, WINDOW)
            if length:
                out += [(length, w.text(i, length), name, None) for i in range(a, b - length + 1)]
                k, w_ = grams(length)
                out += [(length, None, None, int(h)) for h in fingerprints(w.hashes[a:b], np.array([0, b - a]), k, w_)[1].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _filter_place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(SECTIONS << 12)


def _section(rows: pa.Table) -> pa.Table:
    at = _filter_place(np.asarray(rows["print"].combine_chunks()).view(np.uint64)) & np.uint64(4095)
    bits = np.zeros(4096, np.uint8)
    bits[at.astype(np.int64)] = 1
    return pa.table({"section": pa.array([rows["section"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _candidates(lengths: list[int], bits, text: str, kept: list[str], schema: pa.Schema):
    """The rows with their number of words and the windows that may be the benchmark's: length, start and words."""

    def run(batches):
        for batch in C.split_batches(batches, text):
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            w = Words(*C.buffers(col(text)))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for length in lengths:
                k, w_ = grams(length)
                at, h = fingerprints(w.hashes, w.first, k, w_)
                place = _filter_place(h).astype(np.int64)
                at = at[bits.value[place >> 3] >> (7 - (place & 7)) & 1 > 0]
                starts = windows_around(at, w.first, length, k) if len(at) else at
                rows = np.searchsorted(w.first, starts, "right") - 1
                for r, i in zip(rows.tolist(), starts.tolist(), strict=True):
                    found[r].append({"length": length, "start": i - int(w.first[r]), "window": w.text(i, length)})
            cols = [col(n) for n in kept] + [pa.array(np.diff(w.first)), pa.array(found, schema.field("_windows").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _joined(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """decontaminate for a benchmark of any size: one pass that is written, and a join of windows by their words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    made = C.write_table(items.mapInArrow(_item_windows, f"{_WINDOWS}, print long"), "benchmark-windows")
    prints = made.where("print is not null").select("print").distinct()
    section = F.shiftright(F.pmod(F.shiftrightunsigned("print", 20), F.lit(SECTIONS << 12)), 12).cast("int")
    parts = prints.withColumn("section", section).groupBy("section").applyInArrow(_section, "section int, bits binary").toArrow()  # SECTIONS rows of 512 bytes at most
    bits = np.zeros((SECTIONS, 512), np.uint8)
    for k, x in zip(parts["section"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        bits[k] = np.frombuffer(x, np.uint8)
    lengths = sorted(r["length"] for r in made.select("length").distinct().collect())  # WINDOW at most
    window = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("window", T.BinaryType())]))
    schema, kept = C.out_schema(docs, [*_ADDED, ("_windows", window)])
    schema = T.StructType([f for f in schema.fields if f.name in kept or f.name in ("n_words", "_windows")])
    read = docs.mapInArrow(_candidates(lengths, spark.sparkContext.broadcast(bits.ravel()), text, kept, to_arrow_schema(schema)), schema)
    read = C.write_table(read.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    known = made.where("window is not null").groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    cand = read.where(F.size("_windows") > 0).select("_row", F.explode("_windows").alias("w")).select("_row", "w.length", "w.start", "w.window")
    hits = cand.join(known, ["length", "window"])
    words = hits.select("_row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p")).distinct()
    words = words.groupBy("_row").agg(F.sort_array(F.collect_list("p")).alias("hit"))
    names = hits.select("_row", F.explode_outer("items").alias("item")).distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = read.drop("_windows").join(words, "_row", "left").join(names, "_row", "left")
    out = out.withColumn("n_hit", F.coalesce(F.size("hit"), F.lit(0)).cast("long")).withColumn("n_hit", F.greatest("n_hit", F.lit(0).cast("long")))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    edge = lambda step: F.filter("hit", lambda p, i: ~F.coalesce(F.get("hit", i + step) == p + step, F.lit(False)))
    spans = F.flatten(F.zip_with(edge(-1), edge(1), lambda a, b: F.array(a, b + 1)))
    return out.select(
        *kept,
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        ids.alias("item_ids"),
        F.coalesce(spans, F.array().cast("array<int>")).alias("hit_spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, item_ids, hit_spans (flat word bounds)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    if C.input_bytes(items, "t") > broadcast_bytes:
        return _joined(docs, items, text)
    rows = items.collect()  # broadcast_bytes at most
    index = docs.sparkSession.sparkContext.broadcast(build_index([(r["i"], r["t"]) for r in rows]))
    schema, kept = C.out_schema(docs, _ADDED)
    return docs.mapInArrow(_pass(index, kept, text, to_arrow_schema(schema)), schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated."""
    found = decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def contamination_sql(source: str = "documents") -> str:
    """DuckDB SQL for the columns of op1 over `source`."""
    return rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from {source}),
it as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, least(len(w), {WINDOW}) as len, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') as g
       from it, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as u(s) where len(w) > 0),
lens as (select distinct len from iw),
dw as (select r, lens.len, s, array_to_string(w[s : s + lens.len - 1], ' ') as g from d, lens, unnest(range(1, len(w) - lens.len + 2)) as u(s)),
m as (select r, item_id, dw.s, dw.len from dw join iw on dw.g = iw.g and dw.len = iw.len),
hw as (select r, count(distinct p) as n_hit from (select distinct r, s, len from m) x, unnest(range(s, s + len)) as u(p) group by r),
hi as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from m group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and {ONE_IN} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (r) left join hi using (r)"""


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": contamination_sql()}
