"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets: every source's share of all words by weight, but at most `EPOCHS` times its size; what is cut off is shared again
by weight until no target is above its limit. That end is reached in one step here: in the order of limit / weight the
clamped sources are a prefix, which two running sums find exactly, in integers.

Sampling: a source's target is so many whole repetitions of all its documents and a rest. The rest goes to documents in
the order of a seeded hash of their ids until it is used up; the last one gives as many of its first words as are left.
The place in that order comes from sums by hash bucket and a running sum within the one bucket of each source where the
rest ends, so no source, however large, is ordered as a whole.

Defined cases: null text has size 0; null source is a source, the last; null ids are ids; rows with equal ids in a source
have the same place and share what is left in proportion, rounded down; sources without words have target 0; an empty
table gives an empty result; columns with the name of an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
#: Sources whose plan (some 150 bytes each) is broadcast.
BROADCAST_SOURCES = 50_000
#: Leading hex digits of the hash that make a bucket.
DIGITS = 3

_WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with weight and target; one row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), rank % len(weights) + 1).cast("long")
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("weight", w).withColumn("limit", epochs * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))
    share = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("clamped", left * F.col("weight") > F.col("limit") * share)
    left = F.col("total") - F.sum(F.when(F.col("clamped"), F.col("limit")).otherwise(0)).over(all_rows)
    share = F.col("weights") - F.sum(F.when(F.col("clamped"), F.col("weight")).otherwise(0)).over(all_rows)
    target = F.when(F.col("clamped"), F.col("limit").cast("double")).otherwise((left * F.col("weight")).cast("double") / share)
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target (of the source) and taken (words, repetitions counted)."""
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c.lower() not in added]
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    rows = docs.select(*[c for c in docs.columns if c in keep], (word_count() if size is None else size).alias("size"), place.alias("_place"))
    rows = rows.withColumn("_source", F.col(source))
    narrow = rows.select(F.col("_source").alias("source"), F.substring("_place", 1, DIGITS).alias("bucket"), F.col("_place").alias("place"), "size")

    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    plan = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    goal = F.round("target").cast("long")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", goal - F.col("whole") * F.col("source_size"))

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # the bucket in which the rest of each source ends, and what is left of it there
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cut = buckets.withColumn("start", F.coalesce(upto, F.lit(0))).withColumnRenamed("source", "s")
    cut = cut.join(plan.select("source", "rest"), same("s", "source")).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("n")))
    cut = cut.select("s", F.col("bucket").alias("b"), (F.col("rest") - F.col("start")).alias("left"))
    # and within it the place
    inside = narrow.join(cut, same("source", "s") & (F.col("bucket") == F.col("b"))).groupBy("s", "place", "left").agg(F.sum("size").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = inside.withColumn("start", start).where((F.col("start") <= F.col("left")) & (F.col("left") < F.col("start") + F.col("n")))
    ends = ends.select("s", F.col("place").alias("_end"), (F.col("left") - F.col("start")).alias("_left"), F.col("n").alias("_n"))
    plan = plan.join(ends, same("source", "s"), "left").select(F.col("source").alias("_s"), "source_size", "target", F.col("whole").alias("_whole"), "_end", "_left", "_n")

    # one row a source: sent to all tasks if it is small, else joined by source
    plan = C.write_table(plan, "mix")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    extra = F.when(F.col("_place") < F.col("_end"), F.col("size")).when(F.col("_place") == F.col("_end"), F.floor(F.col("_left") * F.col("size") / F.col("_n")).cast("long")).otherwise(0)
    found = rows.join(plan, same("_source", "_s"), "left")
    return found.select(*keep, "size", "source_size", "target", (F.col("_whole") * F.col("size") + extra).cast("long").alias("taken"))


def repeat(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the mix is made of: whole copies, then the first words of a copy that is not taken whole."""
    n, size = F.col("taken"), F.col("size")
    copies = F.when(size > 0, F.ceil(n / size)).otherwise(0).cast("int")
    rows = mixed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    words = (n - (F.col("_copy") - 1) * size).cast("int")
    pieces = F.split(F.col(text), "(?<=[^ \\t\\n\\x0B\\f\\r])(?=[ \\t\\n\\x0B\\f\\r])")  # each with the white space before it
    part = F.when(words < size, F.array_join(F.slice(pieces, 1, words), "")).otherwise(F.col(text))
    return rows.withColumn(text, part)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    sized = C.write_table(docs, "sizes")  # the words are counted once
    return mix(sized, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as often as the mix takes them; the partial copy of a source is cut to its words."""
    rows = repeat(mix(docs))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


_ORACLE = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  md5('{SEED}:' || coalesce(doc_id::varchar, 'null')) as place from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, list_value(5, 2, 1)[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, {EPOCHS} * source_size as lim from s),
c as (select *, (sum(source_size) over ())::bigint as total, (sum(weight) over ())::bigint as weights,
             (coalesce(sum(lim) over b, 0))::bigint as lim_before, (coalesce(sum(weight) over b, 0))::bigint as weight_before from w
      window b as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
k as (select *, (total - lim_before) * weight > lim * (weights - weight_before) as clamped from c),
t as (select source, source_size, case when clamped then lim::double else ((total - sum(case when clamped then lim else 0 end) over ())::bigint * weight)::double
             / (weights - sum(case when clamped then weight else 0 end) over ())::bigint end as target from k),
g as (select *, round(target)::bigint as goal, case when source_size > 0 then round(target)::bigint // source_size else 0 end as whole from t),
p as (select source, place, sum(size) as n, coalesce(sum(sum(size)) over (partition by source order by place rows between unbounded preceding and 1 preceding), 0) as start from d group by source, place)
select doc_id, size, source_size, target,
       (whole * size + case when start + n <= goal - whole * source_size then size when n > 0 and start < goal - whole * source_size
                            then floor((goal - whole * source_size - start) * size / n) else 0 end)::bigint as taken
from d join g on d.source is not distinct from g.source join p on p.source is not distinct from d.source and p.place = d.place"""

QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": _ORACLE}
