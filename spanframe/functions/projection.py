"""Projection of spans from one text to another, for one pair of texts: what the Arrow-batched functions call."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..sources.providers import EmbeddingProvider, HashedNgrams
from . import kernels


@dataclass(frozen=True)
class Config:
    """How texts are aligned: subwords or words, distortion, matching methods by letter, candidates a token."""

    provider: EmbeddingProvider = field(default_factory=HashedNgrams)
    by_word: bool = False
    distortion: float = 0.0
    letters: str = "mai"
    top_k: int = 5
    least: float = 0.5


@dataclass
class Side:
    tokens: list[tuple[str, int, int]]
    vectors: np.ndarray
    index: list[int]

    @property
    def texts(self) -> list[str]:
        return [t[0] for t in self.tokens]


@dataclass
class Alignment:
    """Source tokens first..last-1 against all target tokens."""

    src: Side
    tgt: Side
    first: int
    last: int
    sim: np.ndarray
    src_index: list[int]
    config: Config

    @property
    def src_tokens(self) -> list[tuple[str, int, int]]:
        return self.src.tokens[self.first : self.last]

    def pairs(self, method: str) -> list[tuple[int, int]]:
        """Word pairs of a method; source indices count from `first`."""
        i, j = np.nonzero(kernels.METHODS[method](self.sim))
        return sorted({(self.src_index[a], self.tgt.index[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)})

    def words(self) -> np.ndarray:
        return kernels.pool(self.sim, self.src_index, self.tgt.index, self.last - self.first, len(self.tgt.tokens))

    def candidates(self) -> list[list[tuple[int, float]]]:
        return kernels.top_candidates(self.words(), self.config.top_k, self.config.least)


def side(text: str, config: Config) -> Side:
    return Side(*config.provider.embed_text(text or "", config.by_word))


def align(src: Side, tgt: Side, config: Config, start: int = 0, end: int | None = None) -> Alignment | None:
    """The alignment of the source tokens that start..end touches; None if there are none to compare.

    The first token that ends after `start` (0 if none does) and the last that starts before `end` (all if none does).
    """
    n = len(src.tokens)
    first = next((i for i, t in enumerate(src.tokens) if t[2] > start), 0)
    last = n if end is None else next((i + 1 for i in reversed(range(n)) if src.tokens[i][1] < end), n)
    lo = next((k for k, w in enumerate(src.index) if w >= first), 0)
    hi = next((k for k, w in enumerate(src.index) if w >= last), len(src.index))
    hi = min(hi, len(src.vectors))
    if lo >= hi or not len(tgt.vectors):
        return None
    last = min(last, src.index[hi - 1] + 1)
    sim = kernels.distort(kernels.similarity(src.vectors[lo:hi], tgt.vectors), config.distortion)
    return Alignment(src, tgt, first, last, sim, [w - first for w in src.index[lo:hi]], config)


def _covered(found: Alignment, span: dict[str, Any]) -> list[int]:
    return [i for i, (_, a, b) in enumerate(found.src_tokens) if max(span["start"], a) < min(span["end"], b)]


def _place(found: Alignment, tgt_text: str, span: dict[str, Any], pairs: list[tuple[int, int]], gap: int, factor: float, region: tuple[int, int] | None, candidates=None) -> dict[str, Any] | None:
    """The winning cluster of a span's target tokens as a projected span."""
    covered = _covered(found, span)
    to: dict[int, list[int]] = {}
    for s, t in pairs:
        to.setdefault(s, []).append(t)
    mapped = [t for i in covered for t in to.get(i, ())]
    if not mapped:
        return None
    filled = [list(range(c[0], c[-1] + 1)) for c in kernels.clusters(mapped, gap)]
    weights = None
    if region is not None:
        weights = {}
        for i in covered:
            w = kernels.importance(found.src_tokens[i][0])
            for t in to.get(i, ()):
                weights[t] = max(weights.get(t, 0.0), w)
    best = kernels.merge_clusters(filled, len(covered), gap, factor, None if region is None else sum(region) / 2, weights)
    if not best:
        return None
    start, end = found.tgt.tokens[min(best)][1], found.tgt.tokens[max(best)][2]
    words = found.words() if candidates is None else None
    detail = []
    for i in covered:
        if candidates is not None:
            t = to.get(i, [None])[0]
            score = next((s for j, s in candidates[i] if j == t), 0.0)
        else:
            inside = [j for j in best if j < words.shape[1]]
            t = max(inside or range(words.shape[1]), key=lambda j: words[i, j])  # noqa: B023
            score = float(words[i, t])
        detail.append({"src": i, "src_token": found.src_tokens[i][0], "tgt": t, "tgt_token": None if t is None else found.tgt.tokens[t][0], "score": score, "in_cluster": t in best})
    return {
        "start": start, "end": end, "text": tgt_text[start:end], "labels": list(span.get("labels") or ()), "cluster_size": len(best), "total_aligned": len(mapped),
        "num_clusters": len(filled), "token_alignments": detail, "all_clusters": filled,
    }


def project(src_text: str, tgt_text: str, spans: list[dict], config: Config, gap: int = 5, most: int = 1, refinement: str = "path_dp", render=None) -> list[dict]:
    """Spans through candidates, exact-text filter, target region, path search and clusters; those without a place are left out.

    render: called with what there is to show; its result goes into `rendering`.
    """
    if not src_text or not tgt_text or not spans:
        return []
    src, tgt = side(src_text, config), side(tgt_text, config)
    out = []
    for n, span in enumerate(spans):
        found = align(src, tgt, config, span["start"], span["end"])
        if found is None:
            continue
        texts = [t[0] for t in found.src_tokens]
        weights = [kernels.importance(t) for t in texts]
        candidates = kernels.exact_candidates(found.candidates(), texts, tgt.texts)
        region = kernels.target_region(candidates, weights, len(tgt.tokens))
        if refinement == "path_dp":
            pairs, paths = kernels.path_dp(candidates, weights, most=most)
        else:
            pairs, paths = kernels.sequence_dp(candidates, weights, len(texts), len(tgt.tokens), region)
        row = _place(found, tgt_text, span, pairs, gap, 0.0, region, candidates)
        if row:
            out.append({"ord": n, **row, "rendering": render(candidates, texts, tgt.texts, paths) if render else None})
    return out


def project_single(src_text: str, tgt_text: str, spans: list[dict], config: Config, method: str = "inter", gap: int = 1, render=None) -> list[dict]:
    """Spans through the alignment of one matching method, refined, and clusters."""
    if not src_text or not tgt_text or not spans:
        return []
    src, tgt = side(src_text, config), side(tgt_text, config)
    out = []
    for n, span in enumerate(spans):
        found = align(src, tgt, config, span["start"], span["end"])
        if found is None:
            continue
        pairs = kernels.refine_alignment(found.pairs(method), tgt.texts, gap)
        row = _place(found, tgt_text, span, pairs, gap, 0.6, None)
        if row:
            shown = None
            if render:
                top = kernels.top_candidates(found.words(), 5, -1.0)
                shown = render(top, [t[0] for t in found.src_tokens], tgt.texts, [alignment_path(pairs, top)])
            out.append({"ord": n, **row, "rendering": shown})
    return out


def project_long(src_text: str, tgt_text: str, spans: list[dict], config: Config, method: str = "inter", gap: int = 1, window: int = 512) -> list[dict]:
    """project_single within a window of tokens around each span and the like place of the target."""
    if not src_text or not tgt_text or not spans:
        return []
    src, tgt = kernels.tokenize(src_text), kernels.tokenize(tgt_text)
    if not src or not tgt:
        return []
    starts, half, out = [t[1] for t in src], window // 2, []
    for n, span in enumerate(spans):
        at = max(0, min(len(src) - 1, bisect_left(starts, (span["start"] + span["end"]) / 2)))
        there = int(at / max(len(src) - 1, 1) * len(tgt))
        a, b = src[max(0, at - half)][1], src[min(len(src), at + half) - 1][2]
        c, d = tgt[max(0, there - half)][1], tgt[min(len(tgt), there + half) - 1][2]
        if span["start"] < a or span["end"] - a > b - a:
            continue
        for p in project_single(src_text[a:b], tgt_text[c:d], [{**span, "start": span["start"] - a, "end": span["end"] - a}], config, method, gap):
            start, end = p["start"] + c, p["end"] + c
            out.append({**p, "ord": n, "start": start, "end": end, "text": tgt_text[start:end]})
    return out


def alignment_path(pairs: list[tuple[int, int]], candidates: kernels.Candidates, score: float = 0.0) -> dict[str, Any]:
    """An alignment as a path through candidates; pairs that are no candidate have rank 0."""
    rank = {(i, t): r for i, row in enumerate(candidates) for r, (t, _) in enumerate(row)}
    return {"score": score, "path": [(s, rank.get((s, t), 0), t) for s, t in sorted(pairs)]}
