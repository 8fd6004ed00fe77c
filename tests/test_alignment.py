import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.functions import kernels as K
from spanframe.functions import projection
from spanframe.functions.projection import Config
from spanframe.operators import clusters, project, similarity
from spanframe.operators.render import render_html, render_text
from spanframe.sources import tables
from spanframe.sources.providers import HashedNgrams, LetterCounts, word_means

SRC = "The council of Ghent decided on the new budget for 2021."
TGT = "De council van Ghent besliste over het nieuwe budget voor 2021."


def test_maximum_weight_is_maximum():
    rng = np.random.default_rng(1)
    for m, n in itertools.product((1, 2, 3, 4), (1, 2, 3, 4, 5)):
        sim = rng.random((m, n)) * (rng.random((m, n)) > 0.3)
        small, big, flip = (sim, sim.shape[1], False) if m <= n else (sim.T, m, True)
        best = max(((sum(small[i, j] > 0 for i, j in enumerate(p)), sum(small[i, j] for i, j in enumerate(p))) for p in itertools.permutations(range(big), len(small))), default=(0, 0))
        got = K.maximum_weight(sim)
        assert got.sum() == best[0] and np.isclose((sim * got).sum(), best[1]), flip
        assert got.sum(0).max(initial=0) <= 1 and got.sum(1).max(initial=0) <= 1


def test_methods_relate():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sim = rng.random((rng.integers(1, 8), rng.integers(1, 8)))
        inter, greedy = K.mutual(sim), K.greedy(sim)
        assert (inter == (K.forward(sim) & K.reverse(sim))).all() and (inter <= K.iterate_mutual(sim)).all()
        assert greedy.sum() == min(sim.shape) and greedy.sum(0).max() == 1
        assert (sim * K.maximum_weight(sim)).sum() >= (sim * greedy).sum() - 1e-9


@pytest.mark.parametrize("letters", ["f", "r", "a", "t", "i"])
def test_relational_methods_equal_the_kernels(spark, letters):
    rng = np.random.default_rng(3)
    mats = {g: rng.random((rng.integers(1, 7), rng.integers(1, 7))) for g in range(12)}
    df = spark.createDataFrame([(g, int(i), int(j), float(m[i, j])) for g, m in mats.items() for i, j in np.ndindex(m.shape)], "g int, i int, j int, sim double")
    got = {(r.g, r.i, r.j) for r in similarity.align(df, ["g"], letters).collect()}
    assert got == {(g, int(i), int(j)) for g, m in mats.items() for i, j in zip(*np.nonzero(K.METHODS[K.LETTERS[letters]](m)), strict=True)}


def test_candidates_and_path_golden():
    candidates = [[(12, 0.88), (14, 0.85), (13, 0.84), (15, 0.79), (9, 0.78)], [(13, 0.94)], [(14, 0.95), (12, 0.86), (13, 0.83), (21, 0.79), (15, 0.78)]]
    weights = [K.importance(t) for t in ("Ghent", ",", "Belgium")]
    pairs, paths = K.path_dp(candidates, weights, most=1)
    assert pairs == [(0, 12), (1, 13), (2, 14)]
    assert [round(p["score"], 2) for p in paths[:5]] == [19.24, 18.34, 17.04, 16.54, 10.64]
    assert [[t for _, _, t in p["path"]] for p in paths[:5]] == [[12, 13, t] for t in (14, 12, 13, 15, 21)]
    assert K.path_dp([], []) == K.sequence_dp([[], []], [1, 1], 2, 5) == ([], [])
    pairs, _ = K.sequence_dp(candidates, weights, 3, 30, (10, 18))
    assert (2, 14) in pairs
    words = np.array([[0.9, 0.9, 0.1], [0.2, 0.3, 0.1]])
    assert K.top_candidates(words, 1) == [[(0, 0.9)], [(1, 0.3)]]


def test_clusters_and_regions(spark):
    assert K.clusters([5, 1, 2, 2, 9], 1) == [[1, 2], [5], [9]] and K.clusters([]) == []
    assert K.merge_clusters([[1, 2], [20]], 1, 0, 0.0) == [1, 2] and K.merge_clusters([], 1, 0, 0.0) == []
    assert K.target_region([[(4, 0.9)], [(5, 0.8)], [(40, 0.9)]], [1.0, 1.0, 0.3], 50) == (1, 9)
    assert K.refine_alignment([(0, 1), (0, 9), (1, 2)], ["x"] * 10, 1) == [(0, 1), (1, 2)]
    assert K.refine_alignment([(0, 1), (0, 2)], ["ab", "foot", "ball"], 1) == [(0, 1), (0, 2)]
    df = spark.createDataFrame([(1, i) for i in (5, 1, 2, 2, 9)] + [(2, 7)], "g int, idx int")
    got = {(r.g, r.lo, r.hi, r.n) for r in clusters.fill(clusters.contiguous(df, ["g"]), ["g"]).collect()}
    assert got == {(1, 1, 2, 2), (1, 5, 5, 1), (1, 9, 9, 1), (2, 7, 7, 1)}


def test_provider_and_embedding(spark):
    assert LetterCounts().embed(["Ab1!"])[0].sum() == 4
    assert np.allclose(word_means(np.array([[1.0, 0], [3, 0], [5, 5]]), [0, 0, 2], 4), [[2, 0], [0, 0], [5, 5], [0, 0]])
    df = tables.embed(spark.createDataFrame([("a b",), ("",), (None,)], "text string"), HashedNgrams(16))
    assert [len(r.tokens) for r in df.collect()] == [2, 0, 0]
    r = spark.range(1).select(tables.subword_range(F.array(*[F.lit(x) for x in (0, 0, 1, 3)]), F.lit(1), F.lit(2)).alias("r")).first()["r"]
    assert tuple(r) == (2, 3)


def test_align_texts(spark):
    df = spark.createDataFrame([(SRC, TGT), (SRC, ""), (None, TGT)], "src_text string, tgt_text string")
    rows = project.align_texts(df, config=Config(letters="amitx"), matrix=True)
    first, *rest = rows.collect()
    assert set(first.aligned.alignments) == {"inter", "mwmf", "itermax", "threshold"} and [r.aligned for r in rest] == [None, None]
    pairs = {(r.src_token, r.tgt_token) for r in project.alignment_rows(rows, "inter").collect()}
    assert {("council", "council"), ("Ghent", "Ghent"), ("2021", "2021")} <= pairs
    part = project.align_substring(spark.createDataFrame([(SRC, TGT, "Ghent decided"), (SRC, TGT, "nowhere")], "src_text string, tgt_text string, part string"), "part").collect()
    assert [t.text for t in part[0].aligned.src_tokens] == ["Ghent", "decided"] and part[1].aligned is None


def test_align_words(spark):
    df = spark.createDataFrame([(1, ["new", "york,", "city"], ["york,", "city"])], "id int, src_text array<string>, tgt_text array<string>")
    pairs = {(r.src_token, r.tgt_token) for r in project.alignment_rows(project.align_words(df), "inter").collect()}
    assert pairs == {("york,", "york,"), ("city", "city")}


def test_projection(spark):
    spans = [(7, SRC.index("Ghent"), SRC.index("Ghent") + 5, "Ghent", ["place"]), (8, SRC.index("2021"), SRC.index("2021") + 4, "2021", ["year"])]
    df = spark.createDataFrame([(SRC, TGT, spans), (SRC, "", spans), (SRC, TGT, [])], "src_text string, tgt_text string, spans array<struct<key:int,start:int,end:int,text:string,labels:array<string>>>")
    for run in (project.project_spans, project.project_spans_single, project.project_spans_long):
        full, no_target, no_spans = run(df, debug=True).collect()
        assert [(p.key, p.text, p.labels) for p in full.projected] == [(7, "Ghent", ["place"]), (8, "2021", ["year"])]
        assert no_target.projected == [] and no_spans.projected == []
    by_sequence = project.project_spans(df, refinement="sequence", render="text").first().projected
    assert [p.text for p in by_sequence] == ["Ghent", "2021"] and "Ghent" in by_sequence[0].rendering
    tagged = spark.createDataFrame([("The council of <place>Ghent</place> decided on the new budget for 2021.", TGT)], "tagged_text string, tgt_text string")
    assert project.project_tagged(tagged).first().tagged_target == TGT.replace("Ghent", "<place>Ghent</place>")


def test_long_windows_find_late_spans():
    filler = " ".join(f"w{i}" for i in range(900))
    src, tgt = f"{filler} unique needle here", f"{filler} unique needle there"
    a = src.index("needle")
    got = projection.project_long(src, tgt, [{"start": a, "end": a + 6, "labels": []}], Config(), window=64)
    assert got[0]["text"] == "needle" and tgt[got[0]["start"] : got[0]["end"]] == "needle"


def test_rendering_escapes():
    candidates, paths = [[(0, 0.5)], []], [{"score": 1.0, "path": [(0, 0, 0)]}]
    assert "&lt;b&gt;" in render_html(candidates, ["<i>", "x"], ["<b>"], paths, [0])
    assert "P0" in render_text(candidates, ["<i>", "x"], ["<b>"], paths, [0]) and render_text([], [], []) == "no candidates"
    assert projection.alignment_path([(0, 0), (1, 5)], candidates)["path"] == [(0, 0, 0), (1, 0, 5)]


def test_covered_within_equals_the_join(spark):
    rows = [(1, [(0, 2, 9), (1, 40, 50)], [(0, 0, 2), (1, 2, 5), (2, 8, 12), (3, 9, 10)]), (2, [], [(0, 0, 2)]), (3, [(0, 0, 5)], None), (4, None, [(0, 0, 1)])]
    df = spark.createDataFrame(rows, "k int, spans array<struct<span_id:int,start:int,end:int>>, tokens array<struct<idx:int,start:int,end:int>>")
    spans, tokens = (df.select("k", F.explode(c).alias("x")).select("k", "x.*") for c in ("spans", "tokens"))
    long = clusters.covered_tokens(spans, tokens, ["k"]).select("k", "span_id", "idx", "start", "end")
    got = sorted(map(tuple, clusters.covered_within(df, ["k"]).collect()))
    assert got == sorted(map(tuple, long.collect())) == [(1, 0, 1, 2, 5), (1, 0, 2, 8, 12)]
