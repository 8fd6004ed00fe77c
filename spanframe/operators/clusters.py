"""Clusters of target tokens, target regions and candidate filters over long tables.

Gaps-and-islands: windows and aggregates by `keys` only, so a group is one span of one pair of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, token_importance


def _islands(rows: DataFrame, keys: list[str], order: str, starts: Column) -> Column:
    """The number of the island, 0 on; starts: whether a row begins one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def contiguous(rows: DataFrame, keys: list[str], idx: str = "idx", gap: int = 1) -> DataFrame:
    """Distinct indices (keys, idx) with the cluster of each: at most `gap` are left out between neighbours."""
    t = rows.select(*keys, idx).distinct()
    before = F.lag(idx).over(Window.partitionBy(*keys).orderBy(idx))
    t = t.withColumn("_new", before.isNull() | (F.col(idx) - before - 1 > gap))
    return t.withColumn("cluster", _islands(t, keys, idx, F.col("_new")).cast("int")).drop("_new")


def fill(clustered: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """(keys, cluster, lo, hi, n): clusters as whole stretches; n: the indices that were given."""
    return clustered.groupBy(*keys, "cluster").agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.count("*").cast("int").alias("n"))


def largest(filled: DataFrame, keys: list[str]) -> DataFrame:
    """The cluster with most indices; the first of equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "lo"))
    return filled.withColumn("_k", rank).where("_k = 1").drop("_k")


def merge(filled: DataFrame, keys: list[str], base: int = 2, factor: float = 0.5, src_count: str | None = None, center: str | None = None, weights: DataFrame | None = None) -> DataFrame:
    """The best chain of filled clusters (keys, lo, hi, and what src_count and center name): (keys, lo, hi, score).

    Neighbours join if the gap is at most base + int(mass * factor * 1.2 ^ mass), mass being the longer one's length. The
    best chain has the most weight (weights: keys, idx, weight; else its length), 0 if it is over 4 * src_count + 6
    long, then the nearest center, then the least length, then the least start.
    """
    w = Window.partitionBy(*keys).orderBy("lo")
    width = F.col("hi") - F.col("lo") + 1
    t = filled.withColumn("_w", width).withColumn("_lw", F.lag("_w").over(w)).withColumn("_lh", F.lag("hi").over(w))
    mass = F.greatest("_w", "_lw")
    allowed = F.lit(base) + F.floor(mass * F.lit(factor) * F.pow(F.lit(1.2), mass))
    t = t.withColumn("_new", F.col("_lh").isNull() | (F.col("lo") - F.col("_lh") - 1 > allowed))
    t = t.withColumn("_chain", _islands(t, keys, "lo", F.col("_new")))
    if weights is None:
        t = t.withColumn("_v", F.col("_w").cast("double"))
    else:
        inside = t.join(weights.select(*keys, "idx", "weight"), keys).where(F.col("idx").between(F.col("lo"), F.col("hi")))
        t = t.join(inside.groupBy(*keys, "lo").agg(F.sum("weight").alias("_v")), [*keys, "lo"], "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    extra = [c for c in (src_count, center) if c]
    chains = t.groupBy(*keys, *extra, "_chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("_v").alias("score"))
    length = F.col("hi") - F.col("lo") + 1
    if src_count:
        chains = chains.withColumn("score", F.when((F.col(src_count) > 0) & (length > 4 * F.col(src_count) + 6), 0.0).otherwise(F.col("score")))
    near = F.lit(0.0) if center is None else F.coalesce(-F.abs((F.col("lo") + F.col("hi")) / 2 - F.col(center)), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), near.desc(), length, "lo"))
    return chains.withColumn("_k", rank).where("_k = 1").select(*keys, "lo", "hi", "score")


def exact_candidates(candidates: DataFrame, keys: list[str], src: DataFrame, tgt: DataFrame) -> DataFrame:
    """candidates (keys, i, rank, j, sim): where some have the source token's text, only those; src (keys, i, text), tgt (keys, j, text)."""
    fold = lambda c: F.lower(strip(F.col(c)))
    a = src.select(*keys, "i", fold("text").alias("_s"))
    b = tgt.select(*keys, "j", fold("text").alias("_t"))
    t = candidates.join(a, [*keys, "i"]).join(b, [*keys, "j"]).withColumn("_eq", F.col("_s") == F.col("_t"))
    t = t.withColumn("_any", F.max("_eq").over(Window.partitionBy(*keys, "i")))
    return t.where("_eq or not _any").select(*candidates.columns)


def target_region(candidates: DataFrame, keys: list[str], src: DataFrame, n_tgt: DataFrame, padding: float = 0.3) -> DataFrame:
    """(keys, lo, hi): where most content tokens have their best candidate, padded; n_tgt (keys, n_tgt)."""
    best = F.row_number().over(Window.partitionBy(*keys, "i").orderBy("rank"))
    votes = candidates.withColumn("_b", best).where("_b = 1").join(src.select(*keys, "i", token_importance(F.col("text")).alias("_w")), [*keys, "i"])
    votes = votes.withColumn("_any", F.max(F.col("_w") >= 0.5).over(Window.partitionBy(*keys))).where("_w >= 0.5 or not _any")
    win = largest(fill(contiguous(votes.select(*keys, F.col("j").alias("idx")), keys, gap=3), keys), keys)
    pad = F.greatest(F.lit(3), F.floor((F.col("hi") - F.col("lo") + 1) * F.lit(padding)))
    t = n_tgt.join(win, keys, "left")
    lo = F.when(F.col("lo").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("lo") - pad))
    hi = F.when(F.col("hi").isNull(), F.col("n_tgt")).otherwise(F.least(F.col("n_tgt"), F.col("hi") + pad + 1))
    return t.select(*keys, lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def covered_tokens(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens (keys, idx, start, end) that overlap spans (keys, span_id, start, end): an equi-join with a range residual."""
    s = spans.select(*keys, "span_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    t = s.join(tokens, keys)
    return t.where(F.greatest("_a", "start") < F.least("_b", "end")).drop("_a", "_b")


def covered_within(texts: DataFrame, keys: list[str], spans: str = "spans", tokens: str = "tokens") -> DataFrame:
    """covered_tokens for rows (keys, spans, tokens) that hold a text's spans and tokens as arrays: no token is shuffled."""
    overlap = lambda s, t: F.greatest(s["start"], t["start"]) < F.least(s["end"], t["end"])
    row = lambda s: lambda t: F.struct(s["span_id"].alias("span_id"), t["idx"].alias("idx"), t["start"].alias("start"), t["end"].alias("end"))
    found = F.flatten(F.transform(spans, lambda s: F.transform(F.filter(tokens, lambda t: overlap(s, t)), row(s))))
    return texts.select(*keys, F.explode_outer(found).alias("_x")).where("_x is not null").select(*keys, "_x.*")


def alignment_weights(pairs: DataFrame, keys: list[str], src: DataFrame) -> DataFrame:
    """(keys, idx, weight): for each target token the greatest importance of a source token aligned with it."""
    w = src.select(*keys, "i", token_importance(F.col("text")).alias("_w"))
    return pairs.join(w, [*keys, "i"]).groupBy(*keys, F.col("j").alias("idx")).agg(F.max("_w").alias("weight"))


def map_spans_to_tokens(spans: DataFrame, src_tokens: DataFrame, pairs: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """(keys, span_id, lo, hi, n): the largest cluster of target tokens aligned with each span; spans without any are left out."""
    covered = covered_tokens(spans, src_tokens, keys).select(*keys, "span_id", F.col("idx").alias("i"))
    mapped = covered.join(pairs.select(*keys, "i", F.col("j").alias("idx")), [*keys, "i"])
    group = [*keys, "span_id"]
    return largest(fill(contiguous(mapped, group, gap=gap), group), group).drop("cluster")
