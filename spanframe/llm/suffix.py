"""Exact removal of repeated passages with a sparse, distributed suffix order.

A byte goes if a string of `span` bytes that covers it also starts anywhere else. Suffixes of all positions would be many
times the input, so only anchors are ordered: in each window of `span` bytes the k-gram of the least hash (the last of
equal ones) is its anchor. That depends on nothing but the window's bytes, so equal windows have equal anchors at equal
offsets, and each window belongs to exactly one anchor.

1. Exact copies of a text are counted where they are read and become one text; texts are dealt by hash into cells.
2. Anchor hashes are counted over all cells; anchors that occur once own no repeated window and go no further.
3. What stands left and right of the other anchors, as far as their own windows reach, is dealt by anchor hash. In each
   group the contexts to the right and the reversed ones to the left are put in suffix order by deep-shallow sorting:
   multikey quicksort to a shallow depth, then blind tries for the groups that still tie. With the common prefix lengths
   of both orders, the widest repeated stretch around every anchor follows without comparing all pairs.
4. An anchor hash with more than `hot` occurrences is no group for one task. There every window goes by its own hash,
   which is counted where it is met before it is dealt: with no large group anywhere.

Rolling 64-bit hashes only ever propose: contexts are compared byte by byte, and where bytes are not at hand, copies,
contexts that a cell asks about again and windows of hot anchors go by 128-bit BLAKE2 or MD5 digests.

Counts, contexts and hashes travel as one binary row for each cell and bucket that has any, at most a row an anchor.

Defined cases: null is an empty text; texts shorter than `span` bytes lose nothing; repeated rows are copies of each
other; matches never cross texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 400
GRAM = 100
#: Occurrences of an anchor hash that are sorted in one task.
HOT = 10_000
CELL_BYTES = 4 << 20
#: Bytes of anchor hashes that one bucket counts.
BUCKET_BYTES = 8 << 20
#: Bytes to which multikey quicksort goes before blind tries take over, and the bytes it takes for one character.
SHALLOW, CHAR = 32, 8

_GRAM_VALUE, _WINDOW_VALUE = C.byte_values(202), C.byte_values(203)

# Deep-shallow sorting -----------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """The group in order; its strings agree to `depth`. Inner nodes hold a depth and children by the byte there, no more."""
    root: list = [None, group[:1]]  # leaf: [None, members]; inner node: [depth, {byte or -1: node}]
    for i in group[1:]:
        s = strings[i]
        node = root
        while node[0] is not None:  # blindly: only the branching bytes are looked at
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        same = depth + common_prefix(s[depth:], other[depth:])
        if same == len(s) == len(other):
            node[1].append(i)
            continue
        node = root
        while node[0] is not None and node[0] < same:
            node = node[1][s[node[0]]]
        mine = s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][mine] = [None, [i]]
        else:
            old = node[:]
            node[:] = [same, {(other[same] if same < len(other) else -1): old, mine: [None, [i]]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], np.ndarray]:
    """The strings' order, and for each but the first its common prefix with the one before (0 for the first)."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2 or depth < 0:
            out += group
        elif depth >= SHALLOW:
            out += blind_trie(strings, group, depth)
        else:
            key = {i: strings[i][depth : depth + CHAR] for i in group}
            a, b, c = key[group[0]], key[group[len(group) // 2]], key[group[-1]]
            pivot = max(min(a, b), min(max(a, b), c))
            less = [i for i in group if key[i] < pivot]
            more = [i for i in group if key[i] > pivot]
            equal = [i for i in group if key[i] == pivot]
            # a short character is a string's end: strings that agree on it are equal and need no more
            stack += [(more, depth), (equal, depth + CHAR if len(pivot) == CHAR else -1), (less, depth)]
    lcp = np.zeros(len(strings), np.int64)
    for t in range(1, len(out)):
        lcp[t] = common_prefix(strings[out[t - 1]], strings[out[t]])
    return out, lcp


def widest(left: list[bytes], right: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of each anchor the repeated stretches reach; left: reversed. 0, 0 where there is none."""
    m = len(left)
    far_left, far_right = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if m == 2:
        a, b = common_prefix(*left), common_prefix(*right)
        if a + b >= span:
            far_left[:], far_right[:] = a, b
        return far_left, far_right
    (by_left, lcp_left), (by_right, lcp_right) = deep_shallow(left), deep_shallow(right)
    offsets = {int(x) for x in lcp_left[1:]} | {span - int(x) for x in lcp_right[1:]}
    reach_left, reach_right = int(lcp_left.max()), int(lcp_right.max())
    class_left, class_right = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in sorted(offsets):
        if o < 0 or o > reach_left or span - o > reach_right:
            continue
        class_left[by_left] = np.cumsum(lcp_left < o)
        class_right[by_right] = np.cumsum(lcp_right < span - o)
        _, which, n = np.unique(class_left * (m + 1) + class_right, return_inverse=True, return_counts=True)
        rows = n[which] > 1
        far_left[rows] = o
        far_right[rows] = np.maximum(far_right[rows], span - o)
    return far_left, far_right


# Anchors ------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offs: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of every anchor, and the first and last start of the windows it owns."""
    n = len(data) - gram + 1
    if len(data) < span:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    w = span - gram + 1
    at = np.arange(n)
    h = C.span_hash(C.prefix_sums(_GRAM_VALUE[data]), at, at + gram)
    least = C.slide_min(h, w)
    end = np.repeat(offs[1:], np.diff(offs))
    least[at[: len(least)] + span > end[: len(least)]] = 0
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    pos = np.flatnonzero(~C.slide_min(~padded, w) == h)
    h = h[pos]
    row = np.searchsorted(offs, pos, "right") - 1
    lo = np.maximum(pos - (w - 1), offs[row])
    hi = np.minimum(pos, offs[row + 1] - span)
    # the windows between a lesser one before and a lesser or equal one after
    for back in (True, False):
        live, t = np.arange(len(pos)), 1
        while len(live):
            live = live[live >= t] if back else live[live + t < len(pos)]
            near = live - t if back else live + t
            ok = np.abs(pos[near] - pos[live]) < w
            live, near = live[ok], near[ok]
            wins = h[near] < h[live] if back else h[near] <= h[live]
            if back:
                lo[live[wins]] = np.maximum(lo[live[wins]], pos[near[wins]] + 1)
            else:
                hi[live[wins]] = np.minimum(hi[live[wins]], pos[near[wins]] - w)
            live, t = live[~wins], t + 1
    own = lo <= hi
    return pos[own], h[own], lo[own], hi[own]


def _texts(rows: pa.Table) -> tuple[list[bytes], list[bytes], list[int]]:
    """Distinct digests of a cell, their texts and numbers of copies, in the order of the digests."""
    text: dict[bytes, bytes] = {}
    copies: dict[bytes, int] = defaultdict(int)
    for h, t, n in zip(rows["h"].to_pylist(), rows["text"], rows["n"].to_pylist(), strict=True):
        copies[h] += n
        if h not in text and t.is_valid:
            text[h] = t.as_py()
    keys = sorted(text)
    return keys, [text[h] for h in keys], [copies[h] for h in keys]


def _pieces(texts: list[bytes]):
    """Runs of texts of about a piece's size: (first text, bytes, bounds)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= C.PIECE_BYTES):
            size += len(texts[j])
            j += 1
        yield i, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])])
        i = j


def _contexts(data, pos, h, lo, hi, span):
    """Start and end of what each anchor's windows cover, and a hash of that and of the anchor's place in it."""
    start, end = lo, hi + span
    sums = C.prefix_sums(_WINDOW_VALUE[data])
    return start, end, C.mix(C.span_hash(sums, start, end) ^ C.mix(h + (pos - start).astype(np.uint64)))


def _by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, indices) for hashes; work follows the hashes, not the buckets."""
    b = ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    found, first = np.unique(b[order], return_index=True)
    for k, a, z in zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(order)], strict=False):
        yield k, order[a:z]


def _digest(data: bytes, place: int) -> bytes:
    """128 bits for a stretch and the place of its anchor in it."""
    return hashlib.blake2b(data, digest_size=16, salt=place.to_bytes(8)).digest()


def _window_digests(raw: bytes, pos, lo, hi, span: int) -> tuple[list[int], list[bytes]]:
    """Start and digest of every window that the anchors own."""
    starts = C.concat_ranges(lo, hi + 1).tolist()
    places = (np.repeat(pos, hi - lo + 1) - np.array(starts, np.int64)).tolist()
    return starts, [_digest(raw[s : s + span], p) for s, p in zip(starts, places, strict=True)]


_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("cell", pa.int32()), *((x, pa.binary()) for x in ("a", "b", "c", "d"))])
_SENT_DDL = "kind int, bucket int, cell int, a binary, b binary, c binary, d binary"


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


def _u8(x: np.ndarray) -> bytes:
    return np.minimum(x, 255).astype(np.uint8).tobytes()


def _arrays(rows: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]


# Steps --------------------------------------------------------------------------------------------


def _read(cells: int, span: int):
    schema = pa.schema([("cell", pa.int32()), ("h", pa.binary()), ("text", pa.binary()), ("n", pa.int64())])

    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in C.split_batches(batches, "text"):
            data, offs = C.buffers(batch.column(0))
            raw, out = data.tobytes(), []
            for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
                if b - a >= span:
                    h = hashlib.md5(t := raw[a:b]).digest()
                    if h in seen:
                        seen[h] += 1
                    else:
                        seen[h] = 0
                        out.append((int.from_bytes(h[:4]) % cells, h, t, 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        more = [(int.from_bytes(h[:4]) % cells, h, None, n) for h, n in seen.items() if n]
        for i in range(0, len(more), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*more[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

    return run


def _anchor_hashes(buckets: int, span: int, gram: int):
    def run(rows: pa.Table) -> pa.Table:
        cell = rows["cell"][0].as_py()
        _, texts, _ = _texts(rows)
        found = [anchors(data, offs, span, gram)[1] for _, data, offs in _pieces(texts)]
        h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        return _sent([(0, k, cell, h[i].tobytes(), np.minimum(n[i], 65535).astype(np.uint16).tobytes(), None, None) for k, i in _by_bucket(h, buckets)])

    return run


def _repeated(hot: int):
    """Of the hashes that each cell asks about, those that occur twice or more, and which are hot."""

    def run(rows: pa.Table) -> pa.Table:
        hashes, counts = _arrays(rows, "a", np.uint64), _arrays(rows, "b", np.uint16)
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts).astype(np.float64))
        out, i = [], 0
        for cell, bucket, h in zip(rows["cell"].to_pylist(), rows["bucket"].to_pylist(), hashes, strict=True):
            n = total[which[i : i + len(h)]]
            i += len(h)
            if (n > 1).any():
                out.append((0, bucket, cell, h[n > 1].tobytes(), _u8(n[n > 1] > hot), None, None))
        return _sent(out)

    return run


def _send(buckets: int, span: int, gram: int):
    """The contexts of repeated anchors (kind 0), the windows of hot ones (1), and the hot ones for the cell itself (2)."""

    def run(rows: pa.Table, flags: pa.Table) -> pa.Table:
        if not flags.num_rows or not rows.num_rows:
            return _sent([])
        cell = rows["cell"][0].as_py()
        asked, is_hot = np.concatenate(_arrays(flags, "a", np.uint64)), np.concatenate(_arrays(flags, "b", np.uint8)) > 0
        order = np.argsort(asked)
        asked, hot = asked[order], np.sort(asked[is_hot])
        kept: dict[bytes, list] = {}
        windows: Counter[bytes] = Counter()
        for _, data, offs in _pieces(_texts(rows)[1]):
            pos, h, lo, hi = anchors(data, offs, span, gram)
            ok = C.member(asked, h)
            pos, h, lo, hi = pos[ok], h[ok], lo[ok], hi[ok]
            start, end, context = _contexts(data, pos, h, lo, hi, span)
            heat, raw = C.member(hot, h), data.tobytes()
            if heat.any():
                windows.update(_window_digests(raw, pos[heat], lo[heat], hi[heat], span)[1])
            cold = np.flatnonzero(~heat)
            for c, a, p, s, e in zip(context[cold].tolist(), h[cold].tolist(), pos[cold].tolist(), start[cold].tolist(), end[cold].tolist(), strict=True):
                text = raw[s:e]
                d = _digest(text, p - s)
                if d in kept:
                    kept[d][4] += 1
                else:
                    kept[d] = [c, a, p - s, text, 1]
        out = []
        if kept:
            names, values = list(kept), list(kept.values())
            context, h = np.array([v[0] for v in values], np.uint64), np.array([v[1] for v in values], np.uint64)
            place = np.array([(v[2], len(v[3]), min(v[4], 2)) for v in values], np.uint16)
            for k, i in _by_bucket(h, buckets):
                # of each context its rolling hash and its digest
                both = b"".join([context[x].tobytes() + names[x] for x in i])
                out.append((0, k, cell, h[i].tobytes(), both, place[i].tobytes(), b"".join([values[x][3] for x in i])))
        if windows:
            names = sorted(windows)
            n = np.minimum(np.array([windows[x] for x in names]), 2).astype(np.uint16)
            for k, i in _by_bucket(np.array([int.from_bytes(x[:8]) for x in names], np.uint64), buckets):
                out.append((1, k, cell, b"".join([names[x] for x in i]), n[i].tobytes(), None, None))
            out.append((2, cell % buckets, cell, hot.tobytes(), None, None, None))
        return _sent(out)

    return run


def _match(span: int):
    """By cell: contexts with their widest repeated stretch (kind 0), repeated windows (1), hot anchors (2)."""

    def run(rows: pa.Table) -> pa.Table:
        kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        if kind == 2:
            return rows.select(_SENT.names).cast(_SENT)
        if kind == 1:
            return _windows(rows)
        groups: dict[int, dict[tuple[int, bytes], list]] = defaultdict(dict)
        found: dict[int, list[tuple[bytes, int, int]]] = defaultdict(list)
        for cell, h, c, place, text in zip(rows["cell"].to_pylist(), _arrays(rows, "a", np.uint64), rows["b"].to_pylist(), _arrays(rows, "c", np.uint16), rows["d"].to_pylist(), strict=True):
            i = 0
            for x, (a, (before, size, n)) in enumerate(zip(h.tolist(), place.reshape(-1, 3).tolist(), strict=True)):
                same = groups[a].setdefault((before, text[i : i + size]), [0])
                same[0] += n
                same.append((cell, c[24 * x : 24 * x + 24]))
                i += size
        for group in groups.values():
            kinds = list(group.items())
            far_left, far_right = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            if len(kinds) > 1:
                far_left, far_right = widest([t[:p][::-1] for (p, t), _ in kinds], [t[p:] for (p, t), _ in kinds], span)
            for i, ((p, t), (n, *members)) in enumerate(kinds):
                a, b = (p, len(t) - p) if n > 1 else (int(far_left[i]), int(far_right[i]))
                if a + b >= span:
                    for cell, context in members:
                        found[cell].append((context, a, b))
        return _sent([(0, bucket, cell, b"".join([x[0] for x in v]), np.array([x[1:] for x in v], np.uint16).tobytes(), None, None) for cell, v in found.items()])

    return run


def _windows(rows: pa.Table) -> pa.Table:
    """Of the window digests that each cell sends, those that occur twice or more."""
    total: Counter[bytes] = Counter()
    sent = [[x[i : i + 16] for i in range(0, len(x), 16)] for x in rows["a"].to_pylist()]
    for names, n in zip(sent, _arrays(rows, "b", np.uint16), strict=True):
        for x, k in zip(names, n.tolist(), strict=True):
            total[x] += k
    again = [b"".join([x for x in names if total[x] > 1]) for names in sent]
    return _sent([(1, bucket, cell, x, None, None, None) for cell, bucket, x in zip(rows["cell"].to_pylist(), rows["bucket"].to_pylist(), again, strict=True) if x])


def _remove(span: int, gram: int):
    schema = pa.schema([("h", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())])

    def gather(rows: pa.Table, kind: int, name: str, form) -> np.ndarray:
        return np.concatenate([np.zeros(0, form), *(np.frombuffer(x.as_buffer(), form) for x, k in zip(rows[name], rows["kind"].to_pylist(), strict=True) if k == kind)])

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys, texts, copies = _texts(rows)
        both, reach = gather(found, 0, "a", np.dtype("V24")), gather(found, 0, "b", np.uint16).reshape(-1, 2).tolist()
        known = {x[8:]: r for x, r in zip(both.tolist(), reach, strict=True)}
        maybe = np.unique(both.view(np.uint64).reshape(-1, 3)[:, 0])
        windows, hot = set(gather(found, 1, "a", np.dtype("V16")).tolist()), np.sort(gather(found, 2, "a", np.uint64))
        out = []
        for first, data, offs in _pieces(texts):
            edge = np.zeros(len(data) + 1, np.int64)
            if len(known) or len(hot):
                pos, h, lo, hi = anchors(data, offs, span, gram)
                start, end, context = _contexts(data, pos, h, lo, hi, span)
                ok, raw = C.member(maybe, context), data.tobytes()
                for p, s, e in zip(pos[ok].tolist(), start[ok].tolist(), end[ok].tolist(), strict=True):
                    if r := known.get(_digest(raw[s:e], p - s)):
                        edge[p - r[0]] += 1
                        edge[p + r[1]] -= 1
                heat = C.member(hot, h)
                if heat.any():
                    for s, w in zip(*_window_digests(raw, pos[heat], lo[heat], hi[heat], span), strict=True):
                        if w in windows:
                            edge[s] += 1
                            edge[s + span] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            for i, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
                if copies[first + i] > 1:
                    cut = np.array([0, b - a])
                else:
                    mine = gone[a:b]
                    cut = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                text, at, kept = texts[first + i], 0, []
                for x, y in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
                    kept.append(text[at:x])
                    at = y
                kept = b"".join([*kept, text[at:]])
                out.append((keys[first + i], b - a, int((cut[1::2] - cut[::2]).sum()), len(cut) // 2, hashlib.sha256(kept).hexdigest(), cut.tolist(), kept.decode(errors="replace")))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def repeated_passages(texts: DataFrame, text: str, span: int = SPAN, gram: int = GRAM, hot: int = HOT, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """For each distinct text of at least `span` bytes: h (its MD5), n_bytes, n_removed, n_spans, kept_sha256, spans (flat byte bounds), kept."""
    texts = texts.select(F.col(text).cast("binary").alias("text"))
    size = C.input_bytes(texts, "text")
    cells = max(1, math.ceil(size / cell_bytes))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(size / (span - gram) * 16 / BUCKET_BYTES))
    read = texts.mapInArrow(_read(cells, span), "cell int, h binary, text binary, n long").groupBy("cell")
    asked = read.applyInArrow(_anchor_hashes(buckets, span, gram), _SENT_DDL)
    flags = asked.groupBy("bucket").applyInArrow(_repeated(hot), _SENT_DDL)
    sent = read.cogroup(flags.groupBy("cell")).applyInArrow(_send(buckets, span, gram), _SENT_DDL)
    found = sent.groupBy("kind", "bucket").applyInArrow(_match(span), _SENT_DDL)
    return read.cogroup(found.groupBy("cell")).applyInArrow(_remove(span, gram), "h binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>, kept string")


def remove_repeated(docs: DataFrame, text: str = "text", span: int = SPAN, kept: bool = False, **options) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and removed_spans (flat byte bounds).

    kept: also kept_text, what remains of the text. Where a cut falls inside a character, its bytes that are left are
    shown as U+FFFD; kept_sha256 is of the bytes themselves.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans") + ("kept_text",) * kept
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    found = repeated_passages(docs, text, span, **options)
    found = found.select(F.col("h").alias("_h"), *[F.col(c).alias(f"_{c}") for c in ("n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * kept)])
    keep = [c for c in docs.columns if c.lower() not in added]
    size = F.octet_length(raw).cast("long")
    short = F.when(size < span, F.sha2(raw, 256))
    # all that needs the text is computed below the join, so that only its consumers carry it through the shuffle
    short_text = F.when(size < span, F.coalesce(F.col(text), F.lit("")))
    joined = docs.select(*keep, F.unhex(F.md5(raw)).alias("_h"), size.alias("n_bytes"), short.alias("_short"), *[short_text.alias("_short_text")] * kept).join(found, "_h", "left")
    rest = F.coalesce("_kept", "_short_text").alias("kept_text") if kept else None
    return joined.select(
        *keep,
        "n_bytes",
        F.coalesce("_n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("_n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("_kept_sha256", "_short").alias("kept_sha256"),
        F.coalesce("_spans", F.array().cast("array<bigint>")).alias("removed_spans"),
        *[rest] * kept,
    )


def kept_text(found: DataFrame, text: str = "text", out: str = "kept") -> DataFrame:
    """What remains of each text as bytes, for the result of remove_repeated (a cut may fall inside a character)."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    s, n = F.col("removed_spans"), F.size("removed_spans") / 2
    starts = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, 2 * i - 1)))
    pieces = F.transform(starts, lambda a, i: F.substring(raw, (a + 1).cast("int"), (F.coalesce(F.get(s, 2 * i), F.octet_length(raw).cast("long")) - a).cast("int")))
    return found.withColumn(out, F.aggregate(pieces, F.lit(b""), lambda x, y: F.concat(x, y)))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeated(docs, kept=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "kept_text")


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
