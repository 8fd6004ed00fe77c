"""Similarity and matching over long tables of cells: keys, i, j, sim.

Every operator keeps to the groups given by `keys` (a pair of texts, a span), so its windows and joins are hash
partitioned by them. Ties go to the lower index. Methods that are sequential by nature, and very large matrices, run as one
kernel a group (`match_groups`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """0 for a zero vector."""
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)


def cells(src: DataFrame, tgt: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """All pairs within a group: src (keys, i, vec) and tgt (keys, j, vec) to (keys, i, j, sim), sim = (cosine + 1) / 2.

    A vector's norm is computed once, before the pairs are formed.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    a = src.select(*keys, "i", F.col(vector).alias("_x"), norm.alias("_m"))
    b = tgt.select(*keys, "j", F.col(vector).alias("_y"), norm.alias("_n"))
    both = F.col("_m") * F.col("_n")
    sim = (F.when(both > 0, dot(F.col("_x"), F.col("_y")) / both).otherwise(0.0) + 1) / 2
    return a.join(b, keys).select(*keys, "i", "j", sim.alias("sim"))


def distort(found: DataFrame, keys: list[str], ratio: float = 0.5, shape: tuple[int, int] | None = None) -> DataFrame:
    """Less for cells at different relative positions; groups of one row or column stay.

    shape: rows and columns of every group, also where the last ones have no cells; without it as far as a group's cells go.
    """
    if shape:
        sized = found.withColumns({"_m": F.lit(shape[0]), "_n": F.lit(shape[1])})
    else:
        sized = found.join(found.groupBy(*keys).agg((F.max("i") + 1).alias("_m"), (F.max("j") + 1).alias("_n")), keys)
    gap = F.col("j") / (F.col("_n") - 1) - F.col("i") / (F.col("_m") - 1)
    less = F.when((F.col("_m") < 2) | (F.col("_n") < 2), 1.0).otherwise(1 - gap * gap * ratio)
    return sized.select(*keys, "i", "j", (F.col("sim") * less).alias("sim"))


def _best(found: DataFrame, keys: list[str], by: str, other: str, sim: str = "sim") -> Column:
    return F.row_number().over(Window.partitionBy(*keys, by).orderBy(F.desc(sim), other)) == 1


def forward(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best column of each row."""
    return found.withColumn("_b", _best(found, keys, "i", "j")).where("_b").select(*keys, "i", "j")


def reverse(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best row of each column."""
    return found.withColumn("_b", _best(found, keys, "j", "i")).where("_b").select(*keys, "i", "j")


def mutual(found: DataFrame, keys: list[str]) -> DataFrame:
    """Cells best in their row and in their column."""
    return found.withColumn("_r", _best(found, keys, "i", "j")).withColumn("_c", _best(found, keys, "j", "i")).where("_r and _c").select(*keys, "i", "j")


def threshold(found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    return found.where(F.col("sim") >= least).select(*keys, "i", "j")


def iterate_mutual(found: DataFrame, keys: list[str], rounds: int = 2, discount: float = 0.9) -> DataFrame:
    """mutual, then rounds among what is free: cells with one free side count `discount`, with none not at all.

    Groups with two rows or columns at most have one round.
    """
    group, row, col = Window.partitionBy(*keys), Window.partitionBy(*keys, "i"), Window.partitionBy(*keys, "j")
    t = found.withColumn("_got", _best(found, keys, "i", "j") & F.lit(True)).withColumn("_c", _best(found, keys, "j", "i")).withColumn("_got", F.col("_got") & F.col("_c"))
    small = F.least(F.max("i").over(group), F.max("j").over(group)) + 1 <= 2
    t = t.withColumn("_small", small)
    for _ in range(rounds - 1):
        t = t.withColumn("_fi", ~F.max("_got").over(row)).withColumn("_fj", ~F.max("_got").over(col))
        t = t.withColumn("_go", ~F.col("_small") & F.max("_fi").over(group) & F.max("_fj").over(group))
        free = F.col("_fi").cast("int") + F.col("_fj").cast("int")
        t = t.withColumn("_s", F.col("sim") * F.when(free == 2, 1.0).when(free == 1, discount).otherwise(0.0))
        t = t.withColumn("_r", _best(t, keys, "i", "j", "_s")).withColumn("_c", _best(t, keys, "j", "i", "_s"))
        t = t.withColumn("_got", F.col("_got") | (F.col("_go") & F.col("_r") & F.col("_c") & (free > 0)))
    return t.where("_got").select(*keys, "i", "j")


def match_groups(found: DataFrame, keys: list[str], method: str, **options) -> DataFrame:
    """Any method of kernels.METHODS on one dense matrix a group: needed for greedy and mwmf."""
    run = kernels.METHODS[method]

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = np.asarray(rows["i"]), np.asarray(rows["j"])
        sim = np.zeros((i.max() + 1, j.max() + 1))
        sim[i, j] = np.asarray(rows["sim"])
        a, b = np.nonzero(run(sim, **options))
        fixed = [pa.array([k.as_py()] * len(a), rows.schema.field(n).type) for k, n in zip(key, keys, strict=True)]
        return pa.Table.from_arrays([*fixed, pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[*keys, "i", "j"])

    kinds = ", ".join(f"`{k}` {found.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(*keys, F.col("i").cast("int"), F.col("j").cast("int"), F.col("sim").cast("double")).groupBy(*keys).applyInArrow(match, f"{kinds}, i int, j int")


def align(found: DataFrame, keys: list[str], letters: str = "mai") -> DataFrame:
    """(keys, method, i, j) for methods by letter (a inter, m mwmf, i itermax, f fwd, r rev, g greedy, t threshold); unknown letters are passed over."""
    native = {"fwd": forward, "rev": reverse, "inter": mutual, "itermax": iterate_mutual, "threshold": threshold}
    out = None
    for name in dict.fromkeys(kernels.LETTERS[c] for c in letters if c in kernels.LETTERS):
        pairs = native[name](found, keys) if name in native else match_groups(found, keys, name)
        part = pairs.select(*keys, F.lit(name).alias("method"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
        out = part if out is None else out.unionByName(part)
    return out


def pool_words(found: DataFrame, keys: list[str], src_words: DataFrame, tgt_words: DataFrame) -> DataFrame:
    """Subword cells to word cells by the greatest; src_words (keys, i, word), tgt_words (keys, j, word)."""
    a = src_words.select(*keys, "i", F.col("word").alias("_wi"))
    b = tgt_words.select(*keys, "j", F.col("word").alias("_wj"))
    return found.join(a, [*keys, "i"]).join(b, [*keys, "j"]).groupBy(*keys, F.col("_wi").alias("i"), F.col("_wj").alias("j")).agg(F.max("sim").alias("sim"))


def word_means(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Subword rows (keys, word, vec) to the mean vector of each word."""
    parts = vectors.select(*keys, "word", F.posexplode("vec").alias("_d", "_v"))
    means = parts.groupBy(*keys, "word", "_d").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    return means.groupBy(*keys, "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda x: x["_v"]).alias("vec"))


def top_candidates(found: DataFrame, keys: list[str], k: int = 5, least: float = 0.5) -> DataFrame:
    """(keys, i, rank, j, sim): the best k of each row that reach `least`, or the best one."""
    rank = F.row_number().over(Window.partitionBy(*keys, "i").orderBy(F.desc("sim"), "j"))
    ranked = found.withColumn("rank", rank - 1).where(F.col("rank") < max(k, 1))
    return ranked.where((F.col("sim") >= least) | (F.col("rank") == 0)).select(*keys, "i", "rank", "j", "sim")
