"""Sequential algorithms on one row's values: numpy and the standard library only, called from Arrow-batched functions."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Sequence

import numpy as np

from .text import EDGES, STOPWORDS

TOKEN = re.compile(r"\w+|[^\w\s]")
TAG = re.compile(r"<(/?)([a-zA-Z_][a-zA-Z0-9_-]*)>")

#: Rows of a similarity matrix that are ordered at once.
ROWS = 256

Candidates = Sequence[Sequence[tuple[int, float]]]


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of words and single other characters."""
    return [(m[0], *m.span()) for m in TOKEN.finditer(text)]


def importance(token: str) -> float:
    t = token.strip()
    if not any(map(str.isalnum, t)):
        return 0.1
    return 0.3 if t.lower() in STOPWORDS else 0.8 if t.isdigit() else 1.0


def sanitize(text: str, start: int, end: int) -> tuple[int, int]:
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    part = text[start:end]
    left = len(part) - len(part.lstrip(EDGES))
    return (end, end) if left == len(part) else (start + left, start + len(part.rstrip(EDGES)))


# String similarity --------------------------------------------------------------------------------


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def best_fuzzy(text: str, segment: str, hint: int | None, slack: int = 20) -> tuple[int | None, int | None, float]:
    """Start, end and ratio of the stretch most similar to segment around hint.

    Ratio: twice the longest common subsequence by the sum of the lengths. For every start one bit-parallel pass over the
    longest stretch gives the subsequence with all its beginnings, so each allowed end costs a population count.
    """
    if not segment:
        return None, None, 0.0
    left = 0 if hint is None else max(0, hint - slack)
    window = text[left:] if hint is None else text[left : max(left, hint + len(segment) + 2 * slack)]
    m, spare = len(segment), max(5, int(0.2 * len(segment)))
    shortest, longest = max(1, m - spare), m + spare
    places: dict[str, int] = {}
    for i, c in enumerate(segment):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << m) - 1
    best = (0.0, 0, 0)
    for i in range(len(window) - shortest + 1):
        state = full
        for size, c in enumerate(window[i : i + longest], 1):
            hits = state & places.get(c, 0)
            state = (state + hits | state - hits) & full
            if size >= shortest:
                ratio = 2 * (m - state.bit_count()) / (m + size)
                if ratio > best[0]:
                    best = (ratio, i, i + size)
        if best[0] == 1.0:
            break
    if not best[0]:
        return None, None, 0.0
    return (*sanitize(text, left + best[1], left + best[2]), best[0])


def fuzzy_ladder(text: str, segment: str, hint: int, least: float, farthest: int) -> tuple[int | None, int | None, float]:
    """best_fuzzy with growing slack until a stretch is similar enough."""
    for slack in sorted({*range(0, farthest + 1, 20), farthest}):
        start, end, ratio = best_fuzzy(text, segment, hint, slack)
        if start is not None and ratio >= least:
            return start, end, ratio
    return None, None, 0.0


# Tags ---------------------------------------------------------------------------------------------


def parse_tags(tagged: str, attachments: bool = True, allowed: Iterable[str] | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """Plain text and (start, end, text, tag) of closed tags: linear in the text, for very tag-dense documents."""
    wanted = None if allowed is None else set(allowed)
    parts: list[str] = []
    size, at, depth = 0, 0, 0
    open_at: list[tuple[str, int]] = []
    closed: list[tuple[int, int, str]] = []
    for m in TAG.finditer(tagged):
        if attachments or not depth:
            parts.append(tagged[at : m.start()])
            size += m.start() - at
        at, tag = m.end(), m[2].lower()
        if tag in ("attachment", "attachments"):
            depth = max(0, depth - 1) if m[1] else depth + 1
        if wanted is not None and tag not in wanted:
            continue
        if not m[1]:
            open_at.append((tag, size))
            continue
        same = next((i for i in reversed(range(len(open_at))) if open_at[i][0] == tag), None)
        if same is not None:
            closed.append((open_at[same][1], size, tag))
            del open_at[same:]
    plain = "".join(parts) + (tagged[at:] if attachments else "")
    spans = []
    for start, end, tag in closed:
        part = plain[start:end]
        start += len(part) - len(part.lstrip("\n"))
        part = part.strip("\n")
        if part:
            spans.append((start, start + len(part), part, tag))
    return plain, spans


# Matching -----------------------------------------------------------------------------------------


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(cosine + 1) / 2 of all pairs of rows; a zero row has cosine 0."""
    unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    return (np.clip(unit(np.asarray(x, float)) @ unit(np.asarray(y, float)).T, -1, 1) + 1) / 2


def distort(sim: np.ndarray, ratio: float) -> np.ndarray:
    """Less for pairs at different relative positions."""
    m, n = sim.shape
    if m < 2 or n < 2 or not ratio:
        return sim
    gap = np.arange(n)[None] / (n - 1) - np.arange(m)[:, None] / (m - 1)
    return sim * (1 - gap**2 * ratio)


def forward(sim: np.ndarray) -> np.ndarray:
    out = np.zeros(sim.shape, bool)
    out[np.arange(len(sim)), sim.argmax(1)] = True
    return out


def reverse(sim: np.ndarray) -> np.ndarray:
    return forward(sim.T).T


def mutual(sim: np.ndarray) -> np.ndarray:
    return forward(sim) & reverse(sim)


def iterate_mutual(sim: np.ndarray, rounds: int = 2, discount: float = 0.9) -> np.ndarray:
    """mutual, then again for what is still free: cells with one free side count `discount`, with none not at all."""
    got = mutual(sim)
    if min(sim.shape) <= 2:
        return got
    for _ in range(rounds - 1):
        row, col = ~got.any(1), ~got.any(0)
        if not row.any() or not col.any():
            break
        free = row[:, None].astype(int) + col[None]
        more = mutual(sim * np.array([0, discount, 1])[free]) & (free > 0) & ~got
        if not more.any():
            break
        got |= more
    return got


def greedy(sim: np.ndarray, one_to_one: bool = True) -> np.ndarray:
    """Best cells first (ties by row, then column); each row and column once."""
    m, n = sim.shape
    order = np.argsort(-sim.ravel(), kind="stable")
    out = np.zeros(sim.shape, bool)
    if not one_to_one:
        return sim > 0
    row, col = np.ones(m, bool), np.ones(n, bool)
    for k in order.tolist():
        i, j = divmod(k, n)
        if sim[i, j] <= 0 or not row.any() or not col.any():
            break
        if row[i] and col[j]:
            out[i, j], row[i], col[j] = True, False, False
    return out


def maximum_weight(sim: np.ndarray) -> np.ndarray:
    """Matching of greatest weight among those of greatest size; cells at zero are no edges. Shortest augmenting paths."""
    m, n = sim.shape
    if m > n:
        return maximum_weight(sim.T).T
    big = 1.0 + sim.max(initial=0.0) * (m + 1)  # an edge more outweighs any weights
    cost = np.where(sim > 0, -sim - big, 0.0)
    u, v, owner = np.zeros(m), np.zeros(n), np.full(n, -1)
    for i in range(m):
        least, back, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        at, row = -1, i
        while row >= 0:
            gap = cost[row] - u[row] - v
            better = ~done & (gap < least)
            least[better], back[better] = gap[better], at
            j = int(np.where(done, np.inf, least).argmin())
            step = least[j]
            seen = np.flatnonzero(done)
            u[owner[seen]] += step
            v[seen] -= step
            u[i] += step
            least[~done] -= step
            done[j], at, row = True, j, owner[j]
        while at >= 0:
            before = back[at]
            owner[at] = owner[before] if before >= 0 else i
            at = before
    out = np.zeros(sim.shape, bool)
    for j in np.flatnonzero(owner >= 0):
        out[owner[j], j] = sim[owner[j], j] > 0
    return out


METHODS = {
    "fwd": forward,
    "rev": reverse,
    "inter": mutual,
    "itermax": iterate_mutual,
    "mwmf": maximum_weight,
    "greedy": greedy,
    "threshold": lambda sim: sim >= 0.5,
}
LETTERS = {"a": "inter", "m": "mwmf", "i": "itermax", "f": "fwd", "r": "rev", "g": "greedy", "t": "threshold"}


def pool(sim: np.ndarray, src_word: Sequence[int], tgt_word: Sequence[int], n_src: int, n_tgt: int) -> np.ndarray:
    """Subword similarities to words: the greatest of each pair, 0 where there is none."""
    if sim.shape == (n_src, n_tgt) and np.array_equal(src_word, range(n_src)) and np.array_equal(tgt_word, range(n_tgt)):
        return sim  # every word is one subword
    out = np.zeros((n_src, n_tgt))
    i, j = np.asarray(src_word[: len(sim)], int), np.asarray(tgt_word[: sim.shape[1]], int)
    keep_i, keep_j = (i >= 0) & (i < n_src), (j >= 0) & (j < n_tgt)
    part = sim[: len(i), : len(j)][keep_i][:, keep_j]
    np.maximum.at(out, (i[keep_i][:, None], j[keep_j][None]), part)
    return out


def top_candidates(words: np.ndarray, k: int = 5, least: float = 0.5) -> list[list[tuple[int, float]]]:
    """Per row the best k columns that reach `least`, or the best one."""
    out, k = [], max(k, 1)
    for at in range(0, len(words), ROWS):  # in blocks of rows: the order of a block is as large as the block
        block = words[at : at + ROWS]
        if k < block.shape[1]:
            # columns that reach the k-th best value; ties go to the first columns
            bound = -np.partition(-block, k - 1, axis=1)[:, k - 1 : k]
            row, col = np.nonzero(block >= bound)
        else:
            row, col = np.nonzero(np.ones(block.shape, bool))
        value = block[row, col]
        order = np.lexsort((col, -value, row))
        edge = np.searchsorted(row[order], np.arange(len(block) + 1)).tolist()
        cells = list(zip(col[order].tolist(), value[order].tolist(), strict=True))
        for a, b in zip(edge, edge[1:], strict=False):
            best = cells[a : min(b, a + k)]
            out.append([c for c in best if c[1] >= least] or best[:1])
    return out


# Clusters and paths -------------------------------------------------------------------------------


def clusters(indices: Iterable[int], gap: int = 1) -> list[list[int]]:
    """Distinct indices in runs in which at most `gap` are left out between neighbours."""
    at = np.array(sorted(set(indices)), int)
    if not len(at):
        return []
    return [part.tolist() for part in np.split(at, np.flatnonzero(np.diff(at) - 1 > gap) + 1)]


def merge_clusters(found: list[list[int]], src_count: int | None, base: int, factor: float, center: float | None = None, weights: dict[int, float] | None = None) -> list[int]:
    """The best chain of clusters near each other: by weight (or size), closeness to center, compactness."""
    chains: list[list[list[int]]] = []
    for c in sorted(found):
        if chains:
            last = chains[-1][-1]
            mass = max(len(last), len(c))
            # the exponent is bounded: 1.2**64 tokens are more than any text has, and no float overflows
            if c[0] - last[-1] - 1 <= base + (int(mass * factor * 1.2 ** min(mass, 64)) if factor else 0):
                chains[-1].append(c)
                continue
        chains.append([c])

    def rank(chain: list[int]) -> tuple[float, float, int]:
        width = chain[-1] - chain[0] + 1
        weight = float(len(chain)) if not weights else sum(weights.get(i, 0.0) for i in chain)
        if src_count and width > 4 * src_count + 6:
            weight = 0.0
        near = 0.0 if center is None else -abs((chain[0] + chain[-1]) / 2 - center)
        return weight, near, -width

    return max(([i for c in chain for i in c] for chain in chains), key=rank, default=[])


def target_region(candidates: Candidates, weights: Sequence[float], n_tgt: int, padding: float = 0.3) -> tuple[int, int]:
    """The stretch of target tokens where most content tokens have their best candidate, padded."""
    first = [(c[0][0], w) for c, w in zip(candidates, weights, strict=False) if c]
    votes = [t for t, w in first if w >= 0.5] or [t for t, _ in first]
    if not votes:
        return 0, n_tgt
    best = max(clusters(votes, 3), key=len)
    pad = max(3, int((best[-1] - best[0] + 1) * padding))
    return max(0, best[0] - pad), min(n_tgt, best[-1] + pad + 1)


def exact_candidates(candidates: Candidates, src: Sequence[str], tgt: Sequence[str]) -> list[list[tuple[int, float]]]:
    """Where candidates have the source token's own text, only those."""
    fold = lambda t: t.lower().strip()
    return [[c for c in row if fold(tgt[c[0]]) == fold(s)] or list(row) for row, s in zip(candidates, src, strict=False)]


def _cells(candidates: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Source token, rank, target token and score of all candidates."""
    flat = [(i, r, t, s) for i, row in enumerate(candidates) for r, (t, s) in enumerate(row)]
    a = np.array(flat, float).reshape(-1, 4)
    return a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2].astype(int), a[:, 3]


def _trace(back: np.ndarray, end: int) -> list[int]:
    path = [end]
    while (end := int(back[end])) >= 0:
        path.append(end)
    return path[::-1]


def path_dp(candidates: Candidates, weights: Sequence[float], by_score: bool = True, skip: int = 5, most: int = 5) -> tuple[list[tuple[int, int]], list[dict]]:
    """Paths through the candidates that end anywhere: the alignment of the first `most`, and all that no better one holds.

    A cell is worth ten times its score (or 10 - 1.5 rank) by the token's weight. A path may start at any token at 2 for
    every token with candidates before it; a step costs 2 for each token passed over, and how far the target's move
    differs from the source's, in either direction.
    """
    src, rank, tgt, score = _cells(candidates)
    if not len(src):
        return [], []
    w = np.array([weights[i] if i < len(weights) else 1.0 for i in range(len(candidates))])
    worth = (score * 10.0 if by_score else 10.0 - rank * 1.5) * w[src]
    order = np.unique(src, return_inverse=True)[1]
    total, back = worth - order * 2.0, np.full(len(src), -1)
    edge = np.searchsorted(src, np.arange(len(candidates) + 1))
    for k in range(len(src)):
        prev = np.arange(edge[max(src[k] - skip, 0)], edge[src[k]])
        if len(prev):
            gap = src[k] - src[prev]
            reached = total[prev] + (worth[k] - (gap - 1) * 2.0 - np.abs(np.abs(tgt[k] - tgt[prev]) - gap))
            best = int(reached.argmax())
            if reached[best] > total[k]:
                total[k], back[k] = reached[best], prev[best]
    paths, held = [], []
    for end in np.argsort(-total, kind="stable").tolist():
        cells = _trace(back, end)
        if not any(set(cells) <= other for other in held):
            held.append(set(cells))
            paths.append({"score": float(total[end]), "path": [(int(src[c]), int(rank[c]), int(tgt[c])) for c in cells]})
    return sorted({(s, t) for p in paths[:most] for s, _, t in p["path"]}), paths


def sequence_dp(candidates: Candidates, weights: Sequence[float], n_src: int, n_tgt: int, region: tuple[int, int] | None = None, most: int = 5) -> tuple[list[tuple[int, int]], list[dict]]:
    """Paths from the first token with candidates to the last, in reading order where possible; up to `most` that differ in where they go."""
    src, rank, tgt, score = _cells(candidates)
    if not len(src):
        return [], []
    left, width = (region[0], region[1] - region[0]) if region else (0, n_tgt)
    stride = max(width / max(n_src, 1), 1.0)
    rows = np.unique(src)
    edge = {int(i): (int(np.searchsorted(src, i)), int(np.searchsorted(src, i, "right"))) for i in rows}
    total, back = np.zeros(len(src)), np.full(len(src), -1)
    a, b = edge[int(rows[0])]
    expected = left + (rows[0] / max(n_src - 1, 1)) * max(width - 1, 0) if n_src > 1 else left
    total[a:b] = (score[a:b] + np.maximum(0, 0.05 - 0.001 * np.abs(tgt[a:b] - expected))) * weights[rows[0]]
    for p in range(1, len(rows)):
        prev = np.concatenate([np.arange(*edge[int(i)]) for i in rows[max(0, p - 3) : p]])
        for k in range(*edge[int(rows[p])]):
            move, due = tgt[k] - tgt[prev], (src[k] - src[prev]) * stride
            good = (move == 1) | ((move > 0) & (np.abs(move - due) < 1.5))
            cost = np.select([good, move == 0, move > 1], [0.0, 0.1, 0.15 * np.maximum(0, move - due)], 0.4 * np.abs(move) + 0.3)
            reached = total[prev] + (score[k] - np.minimum(cost, 3.0)) * weights[src[k]]
            best = int(reached.argmax())
            total[k], back[k] = reached[best], prev[best]
    a, b = edge[int(rows[-1])]
    found, seen = [], set()
    for end in sorted(range(a, b), key=lambda k: (-total[k], -k)):
        cells = _trace(back, end)
        where = tuple((c[0], c[-1]) for c in clusters(tgt[cells].tolist(), 5))
        if where not in seen and len(found) < most:
            seen.add(where)
            first = {(int(s), int(t)): int(r) for s, r, t in zip(src[::-1], rank[::-1], tgt[::-1], strict=True)}
            found.append({"score": float(total[end]), "path": [(int(src[c]), first[int(src[c]), int(tgt[c])], int(tgt[c])) for c in cells]})
    return sorted({(s, t) for p in found for s, _, t in p["path"]}), found


def refine_alignment(pairs: Iterable[tuple[int, int]], tgt: Sequence[str], gap: int = 2) -> list[tuple[int, int]]:
    """One place for each source token whose targets repeat a text or lie far apart; compounds are kept."""
    pairs = list(pairs)
    size = {t: len(c) for c in clusters((t for _, t in pairs), gap) for t in c}
    by_src: dict[int, list[int]] = {}
    for s, t in pairs:
        by_src.setdefault(s, []).append(t)
    order = sorted(by_src)
    out = set()
    for at, s in enumerate(order):
        targets = by_src[s]
        texts = {(tgt[t] if t < len(tgt) else str(t)).lower().strip() for t in targets}
        if len(targets) > 1 and (len(texts) == 1 or len(clusters(targets, gap)) > 1):
            most = max(size[t] for t in targets)
            runs = clusters([t for t in targets if size[t] == most], 0)
            near = ([by_src[order[at - 1]][-1]] if at else []) + ([by_src[order[at + 1]][0]] if at + 1 < len(order) else [])
            mean = lambda run: sum(abs(sum(run) / len(run) - x) for x in near) / len(near) if near else 0.0  # noqa: E731, B023
            targets = min(runs, key=lambda run: (mean(run), -len(run)))  # noqa: B023
        out.update((s, t) for t in targets)
    return sorted(out)
