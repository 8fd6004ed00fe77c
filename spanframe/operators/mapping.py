"""Mapping annotations onto a changed version of their text: exact, tolerant-pattern and fuzzy search.

All of it happens within a row, so it needs no shuffle and works on streams. Exact and pattern search are Column
expressions; only segments that they leave open go to an Arrow-batched function, the others cross to Python as nulls.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import cut, let, nearest_exact, regex_sequence, sanitize_span, strip
from ..schema import MAPPED, SPANS
from . import tags

_FOUND = "array<struct<start:int,end:int,ratio:double>>"


def _search(min_ratio: float, max_dist: int):
    """For each segment its similarity (need 1) or its fuzzy place (need 2)."""

    @F.arrow_udf(_FOUND)
    def search(text: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text.to_pylist(), items.to_pylist(), strict=True):
            row = []
            for x in found or ():
                start, end, ratio = x["start"], x["end"], 0.0
                if x["need"] == 1:
                    ratio = kernels.sequence_ratio(x["segment"], t[start:end])
                elif x["need"] == 2:
                    start, end, ratio = kernels.fuzzy_ladder(t, x["segment"], x["approx"], min_ratio, max_dist)
                row.append({"start": start, "end": end, "ratio": round(ratio, 4)})
            out.append(row if found is not None else None)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())])))

    return search


def map_column(df: DataFrame, text: str, items: str, out: str, min_ratio: float = 0.9, max_dist: int = 20, fuzzy: bool = False) -> DataFrame:
    """df with mapped annotations in `out`, one for each given: status exact, regex, fuzzy or unmatched (start, end and text null).

    A place farther than max_dist from the annotation's start is rejected; the similarity found stays. The stages are
    columns of their own, so that none of them is repeated within another.
    """
    text = F.col(text)

    def stage(s: Column) -> Column:
        given = F.struct(F.coalesce(s["start"], F.lit(0)).alias("approx"), strip(F.coalesce(s["text"], F.lit(""))).alias("segment"))

        def search(g: Column) -> Column:
            exact = nearest_exact(text, g["segment"], g["approx"])
            return F.struct(g["approx"].alias("approx"), g["segment"].alias("segment"), exact.alias("at"), F.when(exact.isNull(), regex_sequence(text, g["segment"], g["approx"])).alias("pattern"))

        def report(x: Column) -> Column:
            return F.struct(
                F.coalesce(x["at"], x["pattern"]["start"]).alias("start"),
                F.when(x["at"].isNotNull(), x["at"] + F.length(x["segment"])).otherwise(x["pattern"]["end"]).cast("int").alias("end"),
                F.coalesce(s["labels"], F.array().cast("array<string>")).alias("labels"),
                F.when(x["at"].isNotNull(), "exact").when(x["pattern"].isNotNull(), "regex").otherwise("unmatched").alias("status"),
                x["segment"].alias("segment"),
                x["approx"].cast("int").alias("approx"),
                F.when(x["at"].isNotNull(), 0).when(x["pattern"].isNotNull(), 1).otherwise(2 if fuzzy else 0).alias("need"),
            )

        return let(let(given, search), report)

    staged, found = F.col("_staged"), F.col("_found")
    open_ = F.exists(staged, lambda x: x["need"] > 0)
    asked = F.transform(staged, lambda x: F.struct(x["start"], x["end"], F.when(x["need"] > 0, x["segment"]).alias("segment"), x["approx"], x["need"]))

    def finish(x: Column, i: Column) -> Column:
        def place(extra: Column) -> Column:
            is_fuzzy = (x["need"] == 2) & extra["start"].isNotNull()
            start, end = F.when(is_fuzzy, extra["start"]).otherwise(x["start"]), F.when(is_fuzzy, extra["end"]).otherwise(x["end"])
            similarity = F.when(x["status"] == "exact", 1.0).when((x["status"] == "regex") | is_fuzzy, extra["ratio"]).otherwise(0.0)
            near = start.isNotNull() & (F.abs(start - x["approx"]) <= max_dist)
            status = F.when(near, F.when(is_fuzzy, "fuzzy").otherwise(x["status"])).otherwise("unmatched")
            return F.struct(F.when(near, sanitize_span(text, start, end)).alias("span"), status.alias("status"), similarity.alias("similarity"))

        def report(p: Column) -> Column:
            return F.struct(
                p["span"]["start"].alias("start"),
                p["span"]["end"].alias("end"),
                cut(text, p["span"]["start"], p["span"]["end"]).alias("text"),
                x["labels"].alias("labels"),
                p["status"].alias("status"),
                p["similarity"].alias("similarity"),
                x["segment"].alias("detected"),
                x["approx"].alias("approx_start"),
            )

        return let(let(F.get(found, i), place), report)

    df = df.withColumn("_staged", F.transform(F.coalesce(F.col(items), F.array().cast(SPANS)), stage))
    df = df.withColumn("_found", _search(min_ratio, max_dist)(F.when(open_, text), F.when(open_, asked)))
    return df.withColumn(out, F.transform(staged, finish).cast(f"array<{MAPPED}>")).drop("_staged", "_found")


def map_spans(df: DataFrame, text: str = "original_text", spans: str = "spans", entities: str | None = "entities", min_ratio: float = 0.9, max_dist: int = 20, fuzzy: bool = False, task: str | None = None) -> DataFrame:
    """df with spans and entities mapped onto text, and all_aligned (true without annotations).

    task: a column whose data.text becomes the text that was mapped onto.
    """
    out = df
    for c in filter(None, (spans, entities)):
        out = map_column(out, text, c, c, min_ratio, max_dist, fuzzy)
    ok = F.lit(True)
    for c in filter(None, (spans, entities)):
        ok = ok & ~F.exists(c, lambda s: s["status"] == "unmatched")
    out = out.withColumn("all_aligned", ok)
    return out.withColumn(task, F.col(task).withField("data", F.col(task)["data"].withField("text", F.col(text)))) if task else out


def project_spans(df: DataFrame, target: str = "tgt_text", spans: str = "spans", **options) -> DataFrame:
    """Same-language projection: spans mapped onto the target text."""
    return map_spans(df, target, spans, None, **options)


def map_tags(df: DataFrame, original: str = "original_text", tagged: str = "tagged_text", out: str = "mapped_text", min_ratio: float = 0.8, max_dist: int = 20, fuzzy: bool = False) -> DataFrame:
    """df with the original text tagged as the tagged version is, where its annotations are found."""
    read = df.withColumn("_read", tags.parse_tags(tagged)).withColumn("_spans", F.col("_read.spans"))
    read = map_column(read, original, "_spans", "_spans", min_ratio, max_dist, fuzzy)
    plain = F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["text"], s["labels"])).cast(SPANS)
    return read.withColumn(out, tags.rebuild(original, plain)["tagged_text"]).drop("_read", "_spans")
