"""Merging, reading and checking annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, strip
from ..schema import SPANS


def merge(base: DataFrame, addition: DataFrame, keys: list[str], columns: tuple[str, ...] = ("spans", "entities")) -> DataFrame:
    """base with the annotations of addition after its own, none left out; other columns are base's."""
    none = F.array().cast(SPANS)
    other = addition.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(other, keys, "left")
    return joined.select(*[F.concat(F.coalesce(F.col(c), none), F.coalesce(F.col(f"_{c}"), none)).alias(c) if c in columns else F.col(c) for c in base.columns])


def format_annotations(task: Column | str) -> Column:
    """Struct (classification, entities, segmentation) of a task: its first annotation's results, or its first prediction's.

    The last non-empty choice of `type` counts; labels of other names are passed over.
    """
    task = task if isinstance(task, Column) else F.col(task)
    first = lambda c: F.get(task[c], F.lit(0))["result"]
    given = first("annotations")
    results = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(first("predictions"))
    of = lambda name: F.transform(F.filter(results, lambda r: (r["type"] == "labels") & (r["from_name"] == name)), lambda r: r["value"])
    choices = F.filter(results, lambda r: (r["type"] == "choices") & (r["from_name"] == "type") & (F.size(r["value"]["choices"]) > 0))
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(F.try_element_at(choices, F.lit(-1))["value"]["choices"], none).alias("classification"),
        of("entities").alias("entities"),
        of("segmentation").alias("segmentation"),
    )


def validate(text: Column | str, spans: Column | str) -> Column:
    """Struct (valid, issues) of spans on a text: outside the text, other text there, partial overlap of neighbours with other labels."""
    text, spans = (c if isinstance(c, Column) else F.col(c) for c in (text, spans))
    keyed = F.transform(F.coalesce(spans, F.array().cast(SPANS)), lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))
    ordered = F.array_sort(keyed, lambda x, y: F.when(x["a"] < y["a"], -1).when(x["a"] > y["a"], 1).when(x["b"] < y["b"], -1).when(x["b"] > y["b"], 1).otherwise(x["i"] - y["i"]))
    inside = lambda x: (x["a"] >= 0) & (x["a"] <= x["b"]) & (x["b"] <= F.length(text))

    def own(x: Column, i: Column) -> Column:
        there, said = cut(text, x["a"], x["b"]), F.coalesce(x["s"]["text"], F.lit(""))
        outside = F.format_string("Span out of bounds: %d-%d", x["a"], x["b"])
        differs = F.format_string("Text mismatch at %d: expected '%s', got '%s'", i, said, there)
        return F.when(~inside(x), outside).when(strip(there) != strip(said), differs)

    def neighbours(x: Column, i: Column) -> Column:
        y = F.get(ordered, i + 1)
        crossing = (x["b"] > y["a"]) & (x["b"] < y["b"]) & ~x["s"]["labels"].eqNullSafe(y["s"]["labels"])
        return F.when(crossing, F.format_string("Partial overlap: %s and %s", x["s"]["text"], y["s"]["text"]))

    issues = F.filter(F.concat(F.transform(ordered, own), F.transform(ordered, neighbours)), lambda m: m.isNotNull())
    return F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues"))
