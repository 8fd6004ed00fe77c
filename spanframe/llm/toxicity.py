"""Toxicity: a logistic classifier with counterfactual regularisation.

Features of a text are the words it has and the words' beginnings of `PREFIXES` bytes, as 64-bit hashes. Only features
that labelled toxic texts have more often than others are kept, and the identity terms themselves; weights are never
negative, so toxic words are not outweighed by padding.

For the regularisation, labelled texts get counterfactual twins: identity terms in them are swapped for other terms of
their group or left out, and to a seeded share of texts without any (`ADDED` of clean and `ADDED_TOXIC` of toxic ones, as
groups are named in abuse more often than elsewhere) one is added. Twins are learned from with the label of their text,
which by itself teaches that the terms are toxic; the loss also has `FAIRNESS` times the squared change of the logit
between twins, so a neutral mention of a group moves the score as little as can be. `mention_rate` measures it.

Fitting takes at most `TRAIN_ROWS` labelled texts of each class (the least seeded hashes of their ids). Texts stay on the
executors: their features are counted by Spark, the best `FEATURES` of each model come to the driver, and of every text
only which of them it has. Scores are calibrated: each half of these texts is scored by a model of the other half, and a
logistic curve through these logits, at the classes' true shares (counted over all labels that may be learned from), gives
scale and intercept. Rows whose crc32(id as text) mod 3 is 1 are never learned from. Scoring is one pass over whole texts
without a shuffle.

Defined cases: null and empty texts score the intercept; labels with null id or class are left out, of several classes for
an id the greatest counts; a labelled id that several rows share counts with its least text; without labels of both
classes every score is the share of toxic labels, or 0; repeated rows score alike; columns with the name of an added one
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TRAIN_ROWS = 2000
PREFIXES = (4, 5, 6)
FEATURES = 20_000
THRESHOLD = 0.7
RIDGE, SPARSE, FAIRNESS = 1e-6, 3e-4, 100.0
#: Share of clean and of toxic labelled texts without identity terms to which one is added.
ADDED, ADDED_TOXIC = 0.1, 0.3
#: Terms that are swapped within their group, in the languages at hand.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "schwule", "behinderte"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "homosexuels", "handicapés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "homosexuales", "discapacitados"),
)

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_VALUE = C.byte_values(808)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]


def features(data: np.ndarray, offs: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all features, repeats included; wanted: filter for hashes."""
    start, end, first = C.find_words(data, offs, _WORD)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    sums = C.prefix_sums(_VALUE[data])
    rows, hashes = [], []
    for p in (0, *PREFIXES):
        at = slice(None) if not p else np.flatnonzero(end - start > p)
        s = start[at]
        h = C.span_hash(sums, s, end[at] if not p else s + p) ^ np.uint64(p)
        r = row[at]
        if wanted is not None:
            ok = np.flatnonzero(wanted(h))
            h, r = h[ok], r[ok]
        rows.append(r)
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


_TERMS = frozenset(w for g in IDENTITY for w in g)


def _hashed(texts: pa.Array, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the texts' distinct features, of sorted names only if given; a small piece at a time."""
    rows, hashes, first = [], [], 0
    for batch in C.split_batches([pa.RecordBatch.from_arrays([texts], names=["t"])], "t", 1 << 18):
        r, h = _distinct(*features(*C.buffers(batch.column(0)), None if names is None else lambda h: C.member(names, h)))
        rows.append(r + first)
        hashes.append(h)
        first += batch.num_rows
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def _word_hash(words: list[str]) -> np.ndarray:
    data, offs = C.buffers(pa.array(words, pa.large_string()))
    return C.span_hash(C.prefix_sums(_VALUE[data]), offs[:-1], offs[1:])


def terms_of(text: str) -> list[str]:
    """The identity terms among the words of a text."""
    return sorted(set(text.lower().split()) & _TERMS)


def twins(terms: Iterable[list[str]], toxic: Iterable[int], seed: int = 5) -> tuple[list[int], list[list[str]], list[list[str]]]:
    """Numbers of texts, and for each the identity terms of two counterfactual versions that differ in nothing else.

    The first has the text's own terms, or one added term; the second their swaps, or none.
    """
    rng = np.random.default_rng(seed)
    group = {w: g for g in IDENTITY for w in g}
    number, one, other = [], [], []
    for i, (own, y) in enumerate(zip(terms, toxic, strict=True)):
        if not own and rng.random() < (ADDED_TOXIC if y else ADDED):
            g = IDENTITY[rng.integers(len(IDENTITY))]
            own = [g[rng.integers(len(g))]]
        if own:
            swapped = [g[(g.index(w) + 1 + rng.integers(len(g) - 1)) % len(g)] for w in own for g in [group[w]]]
            for twin in (swapped, []):
                number.append(i)
                one.append(own)
                other.append(twin)
    return number, one, other


class Model:
    """Sorted feature hashes, their weights and the intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def wanted(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = C.member(self.hashes, h[at])
        return out

    def logit(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows, hashes = _distinct(*features(data, offs, self.wanted))
        found = np.bincount(rows, self.weights[np.searchsorted(self.hashes, hashes)], len(offs) - 1) if len(rows) else np.zeros(len(offs) - 1)
        return found + self.bias

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(data, offs), -700, 700)))


class Sample:
    """Labelled texts as what a model of them needs: features by row and column, classes, halves and identity terms."""

    def __init__(self, names: np.ndarray, rows: np.ndarray, columns: np.ndarray, y: np.ndarray, half: np.ndarray, terms: list[list[str]]):
        self.names, self.rows, self.columns, self.y, self.half, self.terms = names, rows, columns, y, half, terms


def strength(in1, in0, n1, n0, log, sqrt):
    """How surely a feature is one of toxic texts: a z value; for numpy arrays and for columns."""
    odds = log((in1 + 0.5) / (n1 + 1)) - log((in0 + 0.5) / (n0 + 1))
    return odds / sqrt(1 / (in1 + 0.5) + 1 / (in0 + 0.5))


def halves(y: np.ndarray) -> np.ndarray:
    """Every other row of each class."""
    half = np.zeros(len(y), bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    return half


def _constant(share: float) -> Model:
    p = min(max(share, 0.0), 1.0)
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))) if 0 < p < 1 else (-800.0 if p == 0 else 800.0))


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """The model of texts at hand; share: of toxic texts where they come from."""
    y = np.array(toxic, np.float64)
    share = share if share is not None else float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        return _constant(share)
    rows, hashes = _hashed(pa.array(texts, pa.large_string()))
    names, columns = np.unique(hashes, return_inverse=True)
    return fit_sample(Sample(names, rows, columns, y, halves(y), [terms_of(t) for t in texts]), share)


def fit_sample(s: Sample, share: float) -> Model:
    model = _fit(s, np.ones(len(s.y), bool))
    logit = np.zeros(len(s.y))
    for side in (s.half, ~s.half):
        if 0 < s.y[side].sum() < side.sum():
            other = _fit(s, side)
            weight = np.zeros(len(s.names))
            weight[np.searchsorted(s.names, other.hashes)] = other.weights  # the terms' own are not needed here
            logit[~side] = np.bincount(s.rows, weight[s.columns], len(s.y))[~side]
    scale, bias = _calibrate(logit, s.y, min(max(share, 1e-6), 1 - 1e-6))
    return Model(model.hashes, model.weights * scale, bias)


def _calibrate(logit: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Scale (at least 1) and intercept of the logistic curve through the logits."""
    n1, n0 = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    x = np.stack([logit, np.ones(len(y))], 1)
    b = np.array([1.0, np.log(share / (1 - share))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        grad = x.T @ (weight * (p - y)) + 1e-6 * b * [1, 0]
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-12)[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        b = b - step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return max(float(b[0]), 1.0), float(b[1])


def _fit(s: Sample, side: np.ndarray, steps: int = 600) -> Model:
    """The model of the rows in `side`. Its names are those of the sample's features and of identity terms."""
    known = side[s.rows]
    number = np.cumsum(side) - 1
    rows, column, y = number[s.rows[known]], s.columns[known], s.y[side]
    n, n1 = len(y), y.sum()
    in1 = np.bincount(column, y[rows], len(s.names))
    in0 = np.bincount(column, minlength=len(s.names)) - in1
    z = strength(in1, in0, n1, n - n1, np.log, np.sqrt)
    kept = np.flatnonzero((in1 >= 2) & (z > 2))
    kept = np.sort(kept[np.lexsort((s.names[kept], -z[kept]))[:FEATURES]])

    # identity terms are features of their own, whether the texts at hand have them or not
    terms = sorted(_TERMS)
    names = np.unique(np.concatenate([s.names[kept], _word_hash(terms)]))
    k = len(names)
    place = np.full(len(s.names), -1)
    at = np.minimum(np.searchsorted(names, s.names), k - 1)
    same = names[at] == s.names
    place[same] = at[same]
    ok = place[column] >= 0
    rows, column = rows[ok], place[column[ok]]
    of, hashes = _hashed(pa.array(terms, pa.large_string()), names)  # a term's word and those of its beginnings that are features
    own = {t: np.searchsorted(names, hashes[of == i]).tolist() for i, t in enumerate(terms)}

    # twins: the differences that the penalty acts on, and for added terms rows more with the label of their text
    mine = [t for t, x in zip(s.terms, side, strict=True) if x]
    which, one, other = twins(mine, y)
    twin = len(which) or 1
    change = [(i, c, v) for i, pair in enumerate(zip(one, other, strict=True)) for v, ts in zip((1.0, -1.0), pair, strict=True) for t in ts for c in own[t]]
    change_row, change_column = (np.array([x[j] for x in change], np.int64) for j in (0, 1))
    change = np.array([x[2] for x in change])
    more = [(i, t) for i, ts, pair in zip(which, one, other, strict=True) if not pair and not mine[i] for t in ts]
    if more:
        order = np.argsort(rows, kind="stable")
        rows, column = rows[order], column[order]
        start, base = np.searchsorted(rows, np.arange(n + 1)), np.array([i for i, _ in more])
        copied = C.concat_ranges(start[base], start[base + 1])
        added = [(n + j, c) for j, (_, t) in enumerate(more) for c in own[t]]
        rows = np.concatenate([rows, np.repeat(n + np.arange(len(base)), start[base + 1] - start[base]), np.array([r for r, _ in added])])
        column = np.concatenate([column, column[copied], np.array([c for _, c in added])])
        rows, column = np.unique(np.stack([rows, column]), axis=1)
        y = np.concatenate([y, y[base]])
        n, n1 = len(y), y.sum()

    w, b = np.zeros(k), float(np.log(n1 / (n - n1)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    weight = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    for t in range(1, steps + 1):  # Adam, weights kept at zero or above
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[column], n) + b, -50, 50)))
        e = weight * (p - y) / n
        gap = np.bincount(change_row, change * w[change_column], twin) if len(change) else np.zeros(twin)
        g = np.bincount(column, e[rows], k) + RIDGE * w + SPARSE
        if len(change):
            g += 2 * FAIRNESS / twin * np.bincount(change_column, change * gap[change_row], k)
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9**t) * (1 - t / (steps + 1))
        w = np.maximum(w - rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-9), 0)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    keep = w > 1e-4
    return Model(names[keep], w[keep], 0.0)  # the intercept comes from calibration


def mention_rate(model: Model, texts: list[str], terms: Iterable[str] = tuple(sorted(_TERMS)), threshold: float = THRESHOLD) -> float:
    """Share of neutral texts that an identity term pushes to the threshold: false positives on neutral mentions."""
    named = [f"{t} {w}" for t in texts for w in terms]
    return float((model.score(*C.buffers(pa.array(named, pa.large_string()))) >= threshold).mean()) if named else 0.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("i")).agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit("train"), "i"), "i").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    # at most 2 * rows ids: a proven bound for the broadcast
    found = texts.join(F.broadcast(picked), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))

    def read(batches):
        for batch in C.split_batches(batches, "t", 1 << 18):
            t = batch.column(1)
            r, h = _distinct(*features(*C.buffers(t)))
            bounds = pa.array(np.searchsorted(r, np.arange(batch.num_rows + 1)), pa.int32())
            terms = pa.array([terms_of(x) for x in t.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(bounds, pa.array(h.view(np.int64))), terms], names=["i", "y", "hashes", "terms"])

    kind = docs.schema[doc_id].dataType.simpleString()
    sample = C.write_table(found.mapInArrow(read, f"i {kind}, y int, hashes array<bigint>, terms array<string>"), "labelled")
    ids = sample.select("i", "y").orderBy("i").toArrow()  # at most 2 * rows
    y = np.asarray(ids["y"].combine_chunks()).astype(np.float64)
    share = counts.get(1, 0) / total if total else 0.0
    if not 0 < y.sum() < len(y):
        return _constant(share if total else (float(y.mean()) if len(y) else 0.0))
    half = halves(y)
    side = spark.createDataFrame(pa.table({"i": ids["i"], "half": pa.array(half), "n": pa.array(np.arange(len(y)), pa.int32())}))
    rows_of = sample.join(F.broadcast(side), "i")
    # features that any of the three models can take, counted where they are
    by = {"a": F.lit(True), "h": F.col("half"), "o": ~F.col("half")}
    each = rows_of.select("y", "half", F.explode("hashes").alias("h"))
    seen = each.groupBy("h").agg(*[F.count(F.when(c & (F.col("y") == v), 1)).alias(f"{k}{v}") for k, c in by.items() for v in (0, 1)])
    seen = C.write_table(seen.where("a1 >= 2"), "features")
    names = []
    for k, inside in (("a", np.ones(len(y), bool)), ("h", half), ("o", ~half)):
        n1, n0 = float(y[inside].sum()), float((1 - y[inside]).sum())
        z = strength(F.col(f"{k}1"), F.col(f"{k}0"), n1, n0, F.log, F.sqrt)
        names.append(seen.where((F.col(f"{k}1") >= 2) & (z > 1.999)).orderBy(z.desc(), "h").limit(FEATURES).select("h").toArrow()["h"])
    names = np.unique(np.concatenate([np.asarray(x.combine_chunks()).astype(np.int64) for x in names]).view(np.uint64))
    shared = spark.sparkContext.broadcast(names)  # at most 3 * FEATURES

    def pick(batches):
        for batch in batches:
            for n, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.asarray(h.values).view(np.uint64)
                at = np.searchsorted(shared.value, h[C.member(shared.value, h)])
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([at.astype(np.int32)])], names=["n", "columns"])

    kept = rows_of.select("n", "hashes").mapInArrow(pick, "n int, columns array<int>").toArrow()  # features of at most 2 * rows texts
    lists, number = kept["columns"].combine_chunks(), np.asarray(kept["n"].combine_chunks())
    size = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    at, columns = np.repeat(number, size).astype(np.int64), np.asarray(lists.flatten()).astype(np.int64)
    order = np.argsort(at, kind="stable")
    terms = dict(zip(*sample.where(F.size("terms") > 0).select("i", "terms").toArrow().to_pydict().values(), strict=True))
    return fit_sample(Sample(names, at[order], columns[order], y, half, [terms.get(i, []) for i in ids["i"].to_pylist()]), share)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    schema, kept = C.out_schema(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in C.split_batches(batches, text):
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            s = shared.value.score(*C.buffers(col(text)))
            cols = [*(col(n) for n in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier does not reject."""
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
