"""Every query against its SQL on the small driver tables, and the operators on a stream."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanframe.functions import kernels
from spanframe.operators import mapping, tags
from spanframe.plans import registry
from spanframe.schema import SPANS
from spanframe.sources import tables
from spanframe.streaming.stream import read_stream, run_stream

DATA = os.environ.get("SPANFRAME_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents benchmark pages embeddings conversations labels events".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    rows = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(found.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name,what", [("project_spans", "ArrowEvalPython ["), ("project_single", "ArrowEvalPython ["), ("project_long", "ArrowEvalPython ["), ("tag_parse", "regexp_extract_all("), ("tag_maps", "regexp_extract_all(")])
def test_expensive_columns_are_computed_once(spark, name, what):
    """No size(x) > 0 is inferred from an explode and pushed below the exchange."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(what) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_covered_tokens_cut_once_and_shuffle_no_tokens(spark):
    plan = registry.QUERIES["covered_tokens"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "Join" not in plan


def test_tokens_come_in_bounded_batches(spark):
    texts = [None, "", "Ab, c", *["word " * 40_000] * 20, "x", None]
    out = list(tables.tokens().func(iter([pa.array(texts[:9], pa.string()), pa.array(texts[9:], pa.string())])))
    assert max(sum(len(r or "") for r in part.to_pylist()) for part in out) <= tables.PIECE_CHARS // 5 and len(out) > 3
    want = [None if t is None else [{"text": w, "start": a, "end": b, "idx": i} for i, (w, a, b) in enumerate(kernels.tokenize(t))] for t in texts]
    assert [r for part in out for r in part.to_pylist()] == want
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).withColumn("n", F.size(tables.tokens()("t")))
    assert [r.n for r in rows.orderBy("i").collect()] == [None if r is None else len(r) for r in want]


@pytest.mark.parametrize("name", ["align_mwmf", "region_estimate", "similarity_distort"])
def test_groups_that_lack_embeddings(spark, tmp_path, name):
    rng = random.Random(3)
    ids = [*range(20), *range(20, 36), *range(50, 60), *range(60, 70), *(v for v in range(80, 100) if v != 84)]
    rows = [(v, [rng.uniform(-1, 1) for _ in range(8)]) for v in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
    assert sorted(map(plain, found.select(*want.columns).collect())) == sorted(map(plain, want.fetchall()))


def test_operators_run_on_a_stream(spark, tmp_path):
    rows = [("<a>The quick</a> fox", "The  quick fox", [(0, 9, "The quick", ["a"])])]
    spark.createDataFrame(rows, f"tagged_text string, original_text string, spans {SPANS}").write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), f"tagged_text string, original_text string, spans {SPANS}")
    work = lambda df: mapping.map_spans(df, entities=None).withColumn("parsed", tags.parse_tags("tagged_text"))
    run_stream(stream, work, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select(F.col("spans")[0]["status"].alias("s"), "parsed.plain_text").first()
    assert tuple(got) == ("regex", "The quick fox")
