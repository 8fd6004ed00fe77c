import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions import kernels
from spanframe.operators import annotations, tags
from spanframe.schema import SPANS, TASK

ARTICLE = "<administrative_body>Municipality of Gh.</administrative_body> decides for <primary_location>Ghent city.</primary_location>"


def parse(spark, text, **options):
    return spark.createDataFrame([(text,)], "t string").select(tags.parse_tags("t", **options).alias("r")).first()["r"]


def test_parse_random_text_as_the_linear_kernel_does(spark):
    rnd = random.Random(1)
    marks = ["<a>", "</a>", "<B>", "</b>", "<attachment>", "</attachment>", "<a x='1'>", "<br/>", "x", "é😀", "\n", " "]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for options in ({}, {"attachments": False}, {"allowed": ["a"]}, {"allowed": []}):
        for r in df.select("t", tags.parse_tags("t", **options).alias("r")).collect():
            plain, spans = kernels.parse_tags(r.t, options.get("attachments", True), options.get("allowed"))
            assert r.r.plain_text == plain
            assert [(s.start, s.end, s.text, s.labels[0]) for s in r.r.spans] == spans


def test_maps_and_missing_text(spark):
    got = parse(spark, ARTICLE, ner_map={"administrative_body": "ADMINISTRATIVE BODY", "primary_location": "PRIMARY LOCATION"})
    assert [(e.start, e.end, e.labels) for e in got.entities] == [(0, 19, ["ADMINISTRATIVE BODY"]), (32, 43, ["PRIMARY LOCATION"])]
    assert got.spans == []
    assert parse(spark, "") is None and parse(spark, None) is None


def test_rebuild_and_round_trip(spark):
    row = ("Hello World", [(0, 11, "", ["sentence"]), (3, 99, "", ["out"]), (2, 8, "", [])], [(0, 5, "", ["greeting"]), (3, 8, "", ["crossing"])])
    df = spark.createDataFrame([row], f"t string, s {SPANS}, e {SPANS}")
    got = df.select(tags.rebuild("t", "s", "e").alias("r")).first()["r"]
    assert tuple(got) == ("<sentence><greeting>Hello</greeting> World</sentence>", 3, 1)
    again = parse(spark, got.tagged_text)
    assert again.plain_text == "Hello World" and {s.labels[0] for s in again.spans} == {"sentence", "greeting"}
    assert df.select(tags.rebuild("t").alias("r")).first()["r"].tagged_text == "Hello World"


def test_task_and_update(spark):
    df = spark.createDataFrame([(ARTICLE, "decision"), (ARTICLE, None)], "tagged_text string, kind string")
    a, b = tags.to_task(df, doc_class="kind", class_map={"decision": "Decision"}).collect()
    assert a.labels == ["Decision"] and b.labels == [] and b.task.data.meta.document_classification == ""
    assert a.task.data.meta.segments == 2 and a.task.data.meta.labels_present == ["administrative_body", "primary_location"]
    done = tags.update_with_rebuilt(tags.to_task(df).withColumn("original_text", F.col("plain_text")), overwrite=False).first()
    assert done.task.data.tagged_text == ARTICLE == done.task.data.tagged_text_unified == done.task.data.tagged_text_original


def test_explode_and_collect(spark):
    df = spark.createDataFrame([(1, [(0, 1, "a", ["x"]), (2, 3, "b", ["y"])], [(4, 5, "c", ["z"])]), (2, None, None)], f"id int, spans {SPANS}, entities {SPANS}")
    rows = tags.explode_spans(df)
    assert rows.count() == 3
    back = tags.collect_spans(rows, ["id"]).first()
    assert [s.text for s in back.spans] == ["a", "b"] and [s.text for s in back.entities] == ["c"]


def test_table_function(spark):
    tags.register_parse_tags(spark, "test_parse_tags")
    spark.createDataFrame([(ARTICLE,), (None,)], "t string").createOrReplaceTempView("test_tagged")
    assert spark.sql("select p.text from test_tagged, lateral test_parse_tags(t) p").count() == 2


def test_merge_format_validate(spark):
    schema = f"id int, spans {SPANS}, entities {SPANS}"
    a, b = spark.createDataFrame([(1, [(0, 1, "A", [])], None)], schema), spark.createDataFrame([(1, [(0, 1, "B", [])], [(0, 1, "C", [])])], schema)
    merged = annotations.merge(a, b, ["id"]).first()
    assert [s.text for s in merged.spans] == ["A", "B"] and [s.text for s in merged.entities] == ["C"]
    tasks = spark.createDataFrame(
        [('{"annotations":[],"predictions":[{"result":[{"type":"labels","from_name":"entities","value":{"text":"pred"}},{"type":"choices","from_name":"type","value":{"choices":["k"]}}]}]}',), ("broken",)], "value string"
    ).select(F.from_json("value", TASK).alias("task"))
    got = tasks.select(annotations.format_annotations("task").alias("f")).first()["f"]
    assert [e.text for e in got.entities] == ["pred"] and got.classification == ["k"]
    df = spark.createDataFrame([("Hello World", [(0, 5, "Hello", ["a"]), (3, 9, "lo Wor", ["b"]), (4, 50, "x", ["c"])]), ("", [])], f"t string, s {SPANS}")
    bad, good = (r["v"] for r in df.select(annotations.validate("t", "s").alias("v")).collect())
    assert good.valid and not bad.valid and len(bad.issues) == 3


@pytest.mark.parametrize("text", ["no tags", "<a></a>", "</a>", "<a>"])
def test_no_spans(spark, text):
    assert parse(spark, text).spans == []
