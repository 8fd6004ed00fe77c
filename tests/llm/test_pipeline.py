"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanframe.llm import common as C
from spanframe.llm import decontaminate, registry, similar

DATA = os.environ.get("SPANFRAME_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, DATA)
    rows = found.collect()
    table = "pages" if name in ("op5_html", "op10_warc") else "documents"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    if name != "op6_chat":
        assert len(rows) == con.sql(f"select count(*) from {table}").fetchall()[0][0]
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(want.columns) == sorted(found.columns)
        assert sorted(repr([plain(r[c]) for c in sorted(found.columns)]) for r in rows) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))


def test_stages(spark):
    docs = C.table(spark, DATA, "documents")
    first = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "token_output"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.write_table(stage(spark, docs, DATA), name)
        kept[name] = docs
        assert name == names[-1] or docs.columns == first
    prints = similar.add_fingerprint(kept["simhash_near_dedup"])
    groups = prints.join(similar.groups(prints.select("doc_id", "_print"), "doc_id"), "_print")
    assert groups.where("doc_id <> component_id").count() == 0
    assert decontaminate.decontaminate(kept["benchmark_decontamination"], C.table(spark, DATA, "benchmark")).where("contaminated").count() == 0
    mixed = kept["source_mix"].count()
    assert docs.count() == mixed and docs.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == docs.agg(F.sum("n_tokens")).first()[0]


def test_run_is_repeatable_and_takes_odd_rows(spark, tmp_path):
    schema = C.table(spark, DATA, "documents").schema
    base = C.table(spark, DATA, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0), (900001, "", "en", None, 0), (900002, "long " * 40_000, "en", "src1", 200_000)], schema)
    base.unionByName(odd).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("benchmark", "labels"):
        C.table(spark, DATA, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    a = key(corpus_pipeline.run(spark, str(tmp_path)))
    assert a and a == key(corpus_pipeline.run(spark, str(tmp_path)))


def test_empty_documents(spark, tmp_path):
    C.table(spark, DATA, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("benchmark", "labels"):
        C.table(spark, DATA, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_written_tables_can_be_dropped(spark):
    df = C.write_table(spark.range(3), "numbers")
    path = C._written[-1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    C.drop_tables(spark)
    assert not os.path.isdir(path.removeprefix("file://")) and not C._written
