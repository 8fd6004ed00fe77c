"""Inline-tagged text to annotations and back, row by row in the JVM.

Bare tags only: tags with attributes and self-closing tags are text. Names are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import cut, invert_map, label_to_tag, let
from ..schema import SPAN, SPANS
from .annotations import format_annotations

TAG = r"<(/?)([a-zA-Z_][a-zA-Z0-9_-]*)>"


def _names(names: Iterable[str] | None) -> Column | None:
    return None if names is None else F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _mapping(m: dict[str, str] | None) -> Column:
    pairs = [F.lit(x) for kv in (m or {}).items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def parse_tags(tagged: Column | str, attachments: bool = True, span_map: dict[str, str] | None = None, ner_map: dict[str, str] | None = None, allowed: Iterable[str] | None = None) -> Column:
    """Struct (plain_text, spans, entities) of a tagged text; null for null or empty text.

    One fold over the tags. A closing tag ends the nearest open one of its name and discards those opened since; spans
    are trimmed of newlines and dropped if empty; they come in the order of their closing tags. Without `attachments`
    what lies in attachment tags, and the tail after the last tag, is left out. `allowed` defaults to the maps' keys.
    """
    text = tagged if isinstance(tagged, Column) else F.col(tagged)
    if allowed is None and (span_map or ner_map):
        allowed = [*(ner_map or {}), *(span_map or {})]
    wanted = _names(allowed)
    literals = F.split(text, TAG, -1)
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    steps = let(tags, lambda found: F.arrays_zip(F.slice(literals, 1, F.size(found)).alias("lit"), found.alias("tag")))
    start = F.struct(
        F.lit("").alias("plain"),
        F.lit(0).alias("depth"),
        F.array().cast("array<struct<tag:string,at:int>>").alias("open"),
        F.array().cast("array<struct<start:int,end:int,tag:string>>").alias("done"),
    )

    def step(acc: Column, x: Column) -> Column:
        closing = F.substring(x["tag"], 2, 1) == "/"
        name = F.lower(F.btrim(x["tag"], F.lit("</>")))
        plain = F.concat(acc["plain"], x["lit"])
        if not attachments:
            plain = F.when(acc["depth"] == 0, plain).otherwise(acc["plain"])
        at = F.length(plain)
        inside = F.greatest(F.lit(0), acc["depth"] + F.when(closing, -1).otherwise(1))
        depth = F.when(name.isin("attachment", "attachments"), inside).otherwise(acc["depth"])
        # the nearest opener: its place from the end of the stack, by name alone
        back = F.array_position(F.reverse(F.transform(acc["open"], lambda o: o["tag"])), name).cast("int")
        place = F.size(acc["open"]) - back + 1
        opener = F.get(acc["open"], place - 1)["at"]
        known = F.lit(True) if wanted is None else F.array_contains(wanted, name)
        ends = known & closing & (back > 0)
        opened = F.array_append(acc["open"], F.struct(name.alias("tag"), at.alias("at")))
        stack = F.when(~known, acc["open"]).when(~closing, opened).when(back > 0, F.slice(acc["open"], 1, place - 1)).otherwise(acc["open"])
        done = F.when(ends & (at > opener), F.array_append(acc["done"], F.struct(opener.alias("start"), at.alias("end"), name.alias("tag")))).otherwise(acc["done"])
        return F.struct(plain.alias("plain"), depth.alias("depth"), stack.alias("open"), done.alias("done"))

    def finish(acc: Column) -> Column:
        plain = F.concat(acc["plain"], F.element_at(literals, -1)) if attachments else acc["plain"]
        return F.struct(plain.alias("plain_text"), acc["done"].alias("done"))

    read = F.aggregate(steps, start, step, finish)
    return F.when(F.length(text) > 0, let(read, lambda r: _label(r, span_map, ner_map)))


def _label(read: Column, span_map, ner_map) -> Column:
    labels = _mapping({**(span_map or {}), **(ner_map or {})})

    def span(d: Column) -> Column:
        part = cut(read["plain_text"], d["start"], d["end"])
        start = d["start"] + F.length(part) - F.length(F.ltrim(part, F.lit("\n")))
        body = F.btrim(part, F.lit("\n"))
        label = F.coalesce(F.try_element_at(labels, d["tag"]), d["tag"])
        return F.struct(start.cast("int").alias("start"), (start + F.length(body)).cast("int").alias("end"), body.alias("text"), F.array(label).alias("labels"), d["tag"].alias("tag"))

    every = F.filter(F.transform(read["done"], span), lambda s: F.length(s["text"]) > 0)
    ner = _names(ner_map or {})
    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["start"], s["end"], s["text"], s["labels"])).cast(SPANS)
    return let(every, lambda found: F.struct(
        read["plain_text"].alias("plain_text"),
        plain(F.filter(found, lambda s: ~F.array_contains(ner, s["tag"]))).alias("spans"),
        plain(F.filter(found, lambda s: F.array_contains(ner, s["tag"]))).alias("entities"),
    ))


def with_annotations(df: DataFrame, tagged: str = "tagged_text", **options) -> DataFrame:
    """df with plain_text, spans and entities."""
    read = df.withColumn("_read", parse_tags(tagged, **options))
    return read.select(*[c for c in df.columns if c not in ("plain_text", "spans", "entities")], "_read.plain_text", "_read.spans", "_read.entities")


def to_task(df: DataFrame, tagged: str = "tagged_text", doc_class: str | None = None, class_map: dict[str, str] | None = None, attachments: bool = True, **options) -> DataFrame:
    """df with the annotation-tool envelope: task (data with text, tagged_text and meta), spans, entities, labels."""
    read = with_annotations(df, tagged, attachments=attachments, **options)
    kind = F.col(doc_class).cast("string") if doc_class else F.lit(None).cast("string")
    mapped = F.try_element_at(_mapping(class_map), kind)
    first = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.coalesce(F.get(s["labels"], F.lit(0)), F.lit("")))))
    meta = F.struct(F.size("spans").alias("segments"), first.alias("labels_present"), F.lit(attachments).alias("include_attachments"), F.coalesce(kind, F.lit("")).alias("document_classification"))
    data = F.struct(F.col("plain_text").alias("text"), F.col(tagged).alias("tagged_text"), meta.alias("meta"))
    labels = F.when(mapped.isNotNull() & (kind != ""), F.array(mapped)).otherwise(F.array().cast("array<string>"))
    return read.withColumn("task", F.when(F.col("plain_text").isNotNull(), F.struct(data.alias("data")))).withColumn("labels", labels)


# Rebuilding ---------------------------------------------------------------------------------------

_ITEM = "struct<start:int,width:int,end:int,kind:int,ord:int,tag:string>"


def rebuild(text: Column | str, spans: Column | str | None = None, entities: Column | str | None = None, label_to_tag_map: Column | dict[str, str] | None = None) -> Column:
    """Struct (tagged_text, total, skipped_crossing): text with nested tags.

    Annotations within the text and with a label are taken by start, longest first, spans before entities; one that
    crosses an accepted one is skipped. Its tag is the label's in the map, else made from the label.
    """
    text = text if isinstance(text, Column) else F.col(text)
    tags = label_to_tag_map if isinstance(label_to_tag_map, Column) else _mapping(label_to_tag_map)
    none = F.array().cast(SPANS)

    def items(xs, kind: int) -> Column:
        xs = none if xs is None else F.coalesce(xs if isinstance(xs, Column) else F.col(xs), none)
        valid = F.transform(
            xs,
            lambda s, i: F.struct(
                s["start"].alias("start"),
                (s["start"] - s["end"]).alias("width"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                i.alias("ord"),
                F.coalesce(F.try_element_at(tags, F.get(s["labels"], F.lit(0))), label_to_tag(F.get(s["labels"], F.lit(0)))).alias("tag"),
            ),
        )
        good = F.filter(valid, lambda v: (v["start"] >= 0) & (v["end"] > v["start"]) & (v["end"] <= F.length(text)) & F.get(F.get(xs, v["ord"])["labels"], F.lit(0)).isNotNull() & (v["tag"] != ""))
        return good.cast(f"array<{_ITEM}>")

    def nest(every: Column) -> Column:
        return F.aggregate(
            every,
            F.array().cast(f"array<{_ITEM}>"),
            lambda acc, x: F.when(F.exists(acc, lambda a: (a["end"] > x["start"]) & (a["end"] < x["end"])), acc).otherwise(F.array_append(acc, x)),
        )

    def write(kept: Column) -> Column:
        # openings in order, closings in reverse order of opening; at one place closings come first
        event = lambda at, kind, ord_, mark: F.struct(at.alias("at"), F.lit(kind).alias("kind"), ord_.alias("ord"), mark.alias("tag"))
        opens = F.transform(kept, lambda x, i: event(x["start"], 1, i, F.concat(F.lit("<"), x["tag"], F.lit(">"))))
        closes = F.transform(kept, lambda x, i: event(x["end"], 0, -i, F.concat(F.lit("</"), x["tag"], F.lit(">"))))
        return F.aggregate(
            F.array_sort(F.concat(closes, opens)),
            F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
            lambda acc, e: F.struct(F.concat(acc["out"], cut(text, acc["at"], e["at"]), e["tag"]).alias("out"), e["at"].alias("at")),
            lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
        )

    def report(every: Column) -> Column:
        return let(nest(every), lambda kept: F.struct(write(kept).alias("tagged_text"), F.size(every).alias("total"), (F.size(every) - F.size(kept)).alias("skipped_crossing")))

    return let(F.array_sort(F.concat(items(spans, 0), items(entities, 1))), report)


def rebuild_from_task(task: Column | str, label_to_tag_map: Column | dict[str, str] | None = None) -> Column:
    """The tagged text of an annotation task: rebuild of its data.text with the segmentation and entities of its results."""
    task = task if isinstance(task, Column) else F.col(task)
    found = format_annotations(task)
    spans = lambda name: F.transform(found[name], lambda v: F.struct(v["start"], v["end"], v["text"], v["labels"])).cast(SPANS)
    return rebuild(F.coalesce(task["data"]["text"], F.lit("")), spans("segmentation"), spans("entities"), label_to_tag_map)["tagged_text"]


def update_with_rebuilt(df: DataFrame, text: str = "original_text", task: str = "task", spans: str = "spans", entities: str = "entities", span_map: Column | None = None, ner_map: Column | None = None, overwrite: bool = True) -> DataFrame:
    """df whose task.data has the rebuilt text as tagged_text (or tagged_text_unified), the former one as
    tagged_text_original unless there is one, and rebuild_stats. Maps go from tag to label; where both give a label the
    entity map's tag counts."""
    empty = F.create_map().cast("map<string,string>")
    both = F.map_concat(
        F.map_filter(invert_map(F.coalesce(span_map, empty) if span_map is not None else empty), lambda k, _: ~F.map_contains_key(invert_map(ner_map if ner_map is not None else empty), k)),
        invert_map(ner_map if ner_map is not None else empty),
    )
    built = rebuild(text, spans, entities, both)
    rows = df.withColumn("_built", built)
    data = F.col(task)["data"]
    names = {f.name for f in df.schema[task].dataType["data"].dataType.fields}
    was = data["tagged_text"] if "tagged_text" in names else F.lit(None).cast("string")
    original = data["tagged_text_original"] if "tagged_text_original" in names else F.lit(None).cast("string")
    stats = F.struct(F.col("_built.total").alias("total"), F.col("_built.skipped_crossing").alias("skipped_crossing"))
    new = data.withField("tagged_text_original", F.coalesce(F.nullif(original, F.lit("")), was)).withField("tagged_text" if overwrite else "tagged_text_unified", F.col("_built.tagged_text")).withField("rebuild_stats", stats)
    return rows.withColumn(task, F.col(task).withField("data", new)).drop("_built")


# A table function for LATERAL joins ---------------------------------------------------------------


def register_parse_tags(spark, name: str = "parse_tags") -> None:
    """SQL: SELECT ... FROM t, LATERAL parse_tags(t.text) gives a row for each span; linear in the text."""

    class ParseTags:
        def eval(self, tagged: str):
            for i, (start, end, text, tag) in enumerate(kernels.parse_tags(tagged)[1] if tagged else ()):
                yield i, start, end, text, [tag]

    spark.udtf.register(name, F.udtf(ParseTags, returnType="ord int, start int, end int, text string, labels array<string>"))


def explode_spans(df: DataFrame, spans: str = "spans", entities: str | None = "entities") -> DataFrame:
    """A row for each annotation: kind, ord, start, end, text, labels; other columns are kept."""
    none = F.array().cast(SPANS)
    tag = lambda c, kind: F.transform(F.coalesce(F.col(c), none), lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), s.cast(SPAN).alias("s")))
    every = tag(spans, "span") if entities is None else F.concat(tag(spans, "span"), tag(entities, "entity"))
    rest = [c for c in df.columns if c not in (spans, entities)]
    # an inner explode would have Catalyst infer size(x) > 0 and compute the array a second time below any exchange
    return df.select(*rest, F.explode_outer(every).alias("_x")).where("_x is not null").select(*rest, "_x.kind", "_x.ord", "_x.s.*")


def collect_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The reverse of explode_spans: arrays spans and entities by keys, in order."""
    item = F.struct("ord", F.struct("start", "end", "text", "labels").alias("s"))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item))), lambda x: x["s"]).cast(SPANS)
    return rows.groupBy(*keys).agg(of("span").alias("spans"), of("entity").alias("entities"))
