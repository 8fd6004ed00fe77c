from spanframe.operators import sql


def test_functions_by_name(spark):
    assert sql.register(spark) == ["spanframe_tokens", "spanframe_best_fuzzy", "spanframe_sequence_ratio", "spanframe_parse_tags"]
    row = spark.sql("select spanframe_tokens('a b,') as t, spanframe_best_fuzzy('The quick brown fox', 'brwn', cast(null as int)) as f, spanframe_sequence_ratio('ab', 'ab') as r").first()
    assert [x.text for x in row.t] == ["a", "b", ","] and (row.f.start, row.f.end) == (10, 15) and row.r == 1.0
    assert [tuple(r) for r in spark.sql("select start, text from values ('<a>x</a>y<b>z</b>') as v(t), lateral spanframe_parse_tags(t)").collect()] == [(0, "x"), (2, "z")]
