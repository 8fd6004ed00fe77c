"""Alignment and projection of spans over DataFrames of text pairs.

A pair is one row and is embedded once for all its spans; rows are independent, so nothing is shuffled. The same steps over
long tables are in `similarity` and `clusters`.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions import kernels, projection
from ..functions.projection import Config
from ..schema import CANDIDATES, MATRIX, PAIRS, SPANS, TOKENS
from ..sources.providers import ByWhiteSpace
from . import tags
from .render import render_html, render_text

_TOKEN_ALIGNMENT = "struct<src:int,src_token:string,tgt:int,tgt_token:string,score:double,in_cluster:boolean>"
PROJECTED = (
    "array<struct<ord:int,start:int,end:int,text:string,labels:array<string>,cluster_size:int,total_aligned:int,num_clusters:int,"
    f"token_alignments:array<{_TOKEN_ALIGNMENT}>,all_clusters:array<array<int>>,rendering:string>>"
)
ALIGNED = f"struct<alignments:map<string,{PAIRS}>,src_tokens:{TOKENS},tgt_tokens:{TOKENS},similarity:{MATRIX},candidates:{CANDIDATES}>"


def _arrow(kind: str):
    return to_arrow_type(_parse_datatype_string(kind))


def _project(run):
    kind = _arrow(PROJECTED)

    @F.arrow_udf(PROJECTED)
    def go(src: pa.Array, tgt: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([run(s or "", t or "", x or []) for s, t, x in zip(src.to_pylist(), tgt.to_pylist(), spans.to_pylist(), strict=True)], kind)

    return go


def _finish(df: DataFrame, column: Column, spans: str, out: str, debug: bool, rendered: bool) -> DataFrame:
    """The projected spans with the further fields of the given ones, in their order."""
    names = df.schema[spans].dataType.elementType.fieldNames()
    extra = [n for n in names if n not in ("start", "end", "text", "labels")]
    given = F.col(spans)
    fields = ["start", "end", "text", "labels"] + (["cluster_size", "total_aligned", "num_clusters", "token_alignments", "all_clusters"] if debug else []) + (["rendering"] if rendered else [])
    df = df.withColumn("_projected", column)
    made = F.transform("_projected", lambda p: F.struct(*[F.get(given, p["ord"])[n].alias(n) for n in extra], *[p[n].alias(n) for n in fields]))
    return df.withColumn(out, made).drop("_projected")


def project_spans(df: DataFrame, src: str = "src_text", tgt: str = "tgt_text", spans: str = "spans", out: str = "projected", config: Config | None = None, max_gap: int = 5, max_paths: int = 1, refinement: str = "path_dp", debug: bool = False, render: str | None = None) -> DataFrame:
    """df with projected spans; spans without a place are left out. render: "text" or "html" adds a picture of each."""
    show = {"text": render_text, "html": render_html, None: None}[render]
    run = partial(projection.project, config=config or Config(), gap=max_gap, most=max_paths, refinement=refinement, render=show)
    return _finish(df, _project(run)(F.col(src), F.col(tgt), F.col(spans)), spans, out, debug, bool(render))


def project_spans_single(df: DataFrame, src: str = "src_text", tgt: str = "tgt_text", spans: str = "spans", out: str = "projected", config: Config | None = None, method: str = "inter", max_gap: int = 1, debug: bool = False, render: str | None = None) -> DataFrame:
    """df with spans projected through one matching method's alignment."""
    show = {"text": render_text, "html": render_html, None: None}[render]
    run = partial(projection.project_single, config=config or Config(), method=method, gap=max_gap, render=show)
    return _finish(df, _project(run)(F.col(src), F.col(tgt), F.col(spans)), spans, out, debug, bool(render))


def project_spans_long(df: DataFrame, src: str = "src_text", tgt: str = "tgt_text", spans: str = "spans", out: str = "projected", config: Config | None = None, method: str = "inter", max_gap: int = 1, window: int = 512, debug: bool = False) -> DataFrame:
    """project_spans_single in windows of tokens around each span, for texts beyond what a model takes at once."""
    run = partial(projection.project_long, config=config or Config(), method=method, gap=max_gap, window=window)
    return _finish(df, _project(run)(F.col(src), F.col(tgt), F.col(spans)), spans, out, debug, False)


def project_tagged(df: DataFrame, src: str = "tagged_text", tgt: str = "tgt_text", out: str = "tagged_target", allowed: list[str] | None = None, config: Config | None = None, max_gap: int = 1) -> DataFrame:
    """df with the target text tagged as the tagged source is."""
    read = df.withColumn("_read", tags.parse_tags(src, allowed=allowed)).withColumn("_plain", F.col("_read.plain_text"))
    read = read.withColumn("_spans", F.concat("_read.spans", "_read.entities").cast(SPANS))
    done = project_spans(read, "_plain", tgt, "_spans", "_done", config, max_gap)
    return done.withColumn(out, tags.rebuild(tgt, F.col("_done").cast(SPANS))["tagged_text"]).drop("_read", "_plain", "_spans", "_done")


def align_texts(df: DataFrame, src: str = "src_text", tgt: str = "tgt_text", start: str | None = None, end: str | None = None, out: str = "aligned", config: Config | None = None, matrix: bool = False, candidates: bool = True) -> DataFrame:
    """df with the alignment of the source tokens that start..end touches (all by default): pairs by method and, if asked for, candidates and similarities.

    Null where there is nothing to compare.
    """
    config, kind = config or Config(), _arrow(ALIGNED)
    methods = [kernels.LETTERS[c] for c in config.letters if c in kernels.LETTERS]
    token = lambda t, i: {"text": t[0], "start": t[1], "end": t[2], "idx": i}

    @F.arrow_udf(ALIGNED)
    def go(s: pa.Array, t: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for st, tt, x, y in zip(s.to_pylist(), t.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
            found = projection.align(projection.side(st, config), projection.side(tt, config), config, x or 0, y)
            rows.append(
                found
                and {
                    "alignments": [(m, [{"src": i, "tgt": j} for i, j in found.pairs(m)]) for m in methods],
                    "src_tokens": [token(x, i) for i, x in enumerate(found.src_tokens)],
                    "tgt_tokens": [token(x, i) for i, x in enumerate(found.tgt.tokens)],
                    "similarity": found.sim.tolist() if matrix else None,
                    "candidates": [[{"tgt": j, "score": v} for j, v in row] for row in found.candidates()] if candidates else None,
                }
            )
        return pa.array(rows, kind)

    none = F.lit(None).cast("int")
    return df.withColumn(out, go(F.col(src), F.col(tgt), F.col(start).cast("int") if start else none, F.col(end).cast("int") if end else none))


def align_words(df: DataFrame, src: str = "src_text", tgt: str = "tgt_text", out: str = "aligned", config: Config | None = None, matrix: bool = True) -> DataFrame:
    """align_texts over the words between white space; src and tgt may also be arrays of words, which are taken as they are split."""
    from dataclasses import replace

    config = config or Config()
    joined = df
    for c in (src, tgt):
        if df.schema[c].dataType.typeName() == "array":
            joined = joined.withColumn(c, F.array_join(c, " "))
    done = align_texts(joined, src, tgt, out=out, config=replace(config, provider=ByWhiteSpace(config.provider)), matrix=matrix)
    return done.select(*[c for c in df.columns if c not in (src, tgt, out)], *[F.col(c) for c in (src, tgt) if c in done.columns], out)


def align_substring(df: DataFrame, part: str, src: str = "src_text", tgt: str = "tgt_text", out: str = "aligned", config: Config | None = None) -> DataFrame:
    """align_texts for the first occurrence of a part of the source; null where it does not occur."""
    at = F.position(F.col(part), F.col(src)) - 1
    df = df.withColumn("_a", F.when(at >= 0, at)).withColumn("_b", F.when(at >= 0, at + F.length(part)))
    done = align_texts(df, src, tgt, "_a", "_b", out, config)
    return done.withColumn(out, F.when(F.col("_a").isNotNull(), F.col(out))).drop("_a", "_b")


def alignment_rows(aligned: DataFrame, method: str, column: str = "aligned") -> DataFrame:
    """A row for each pair of a method: the two tokens and their indices."""
    rows = aligned.select(*[c for c in aligned.columns if c != column], F.col(column).alias("_a"), F.explode_outer(F.try_element_at(F.col(column)["alignments"], F.lit(method))).alias("_p")).where("_p is not null")
    pick = lambda side, i: F.get(F.col("_a")[side], i)["text"]
    return rows.select(*[c for c in aligned.columns if c != column], F.col("_p.src").alias("src_idx"), pick("src_tokens", F.col("_p.src")).alias("src_token"), F.col("_p.tgt").alias("tgt_idx"), pick("tgt_tokens", F.col("_p.tgt")).alias("tgt_token"))


def refine(refinement: str = "path_dp", most: int = 5):
    """Arrow-batched function from (candidates, source tokens, number of target tokens) to struct (pairs, paths)."""
    kind = f"struct<pairs:{PAIRS},paths:array<struct<score:double,path:array<struct<src:int,rank:int,tgt:int>>>>>"
    arrow = _arrow(kind)

    @F.arrow_udf(kind)
    def go(candidates: pa.Array, tokens: pa.Array, n_tgt: pa.Array) -> pa.Array:
        rows = []
        for c, texts, n in zip(candidates.to_pylist(), tokens.to_pylist(), n_tgt.to_pylist(), strict=True):
            cells = [[(x["tgt"], x["score"]) for x in row or ()] for row in c or ()]
            weights = [kernels.importance(t) for t in texts or ()]
            if refinement == "path_dp":
                pairs, paths = kernels.path_dp(cells, weights, most=most)
            else:
                pairs, paths = kernels.sequence_dp(cells, weights, len(texts or ()), n or 0, kernels.target_region(cells, weights, n or 0), most)
            rows.append({"pairs": [{"src": s, "tgt": t} for s, t in pairs], "paths": [{"score": p["score"], "path": [{"src": s, "rank": r, "tgt": t} for s, r, t in p["path"]]} for p in paths]})
        return pa.array(rows, arrow)

    return go
