"""DuckDB SQL for the queries of `queries`, written from the operators' definitions."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from .queries import ENTITIES, LABELS

_TAG = "<(/?)([a-zA-Z_][a-zA-Z0-9_-]*)>"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x85\p{Z}]"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _tags(html: str = "html", attachments: bool = True, allowed: list[str] | None = None) -> str:
    """CTEs up to `spans` (page_id, pos, s, e, body, tag) and `pages_read` (page_id, plain)."""
    known = "true" if allowed is None else "name in (" + ", ".join(f"'{x}'" for x in allowed) + ")"
    emit = "true" if attachments else "depth = 0"
    return f"""
with recursive steps as (select page_id, string_split_regex(h, '{_TAG}') as lits, regexp_extract_all(h, '{_TAG}', 0) as tags from (select page_id, {html} as h from pages) where length(h) > 0),
x as (select page_id, i, lits[i] as lit, lower(regexp_extract(tags[i], '{_TAG}', 2)) as name, regexp_extract(tags[i], '{_TAG}', 1) = '/' as closing from steps, unnest(range(1, len(tags) + 1)) as u(i)),
r as (
  select page_id, 0::bigint as i, ''::varchar as plain, 0::bigint as depth, []::struct(tag varchar, off bigint)[] as opened, []::struct(s bigint, e bigint, tag varchar)[] as done from steps
  union all
  select page_id, i, plain2, case when name in ('attachment', 'attachments') then greatest(0, depth + case when closing then -1 else 1 end) else depth end,
    case when not known then opened when not closing then list_append(opened, {{'tag': name, 'off': length(plain2)}}) when back > 0 then opened[1 : len(opened) - back] else opened end,
    case when known and closing and back > 0 and length(plain2) > opened[len(opened) - back + 1].off then list_append(done, {{'s': opened[len(opened) - back + 1].off, 'e': length(plain2), 'tag': name}}) else done end
  from (select r.page_id, x.i, r.depth, r.opened, r.done, x.name, x.closing, {known} as known, case when {emit} then plain || lit else plain end as plain2,
               coalesce(list_position(list_reverse(list_transform(opened, lambda o: o.tag)), name), 0) as back
        from r join x on x.page_id = r.page_id and x.i = r.i + 1)
),
pages_read as (select r.page_id, r.plain || {"steps.lits[-1]" if attachments else "''"} as plain, r.done from r join steps on r.page_id = steps.page_id and r.i = len(steps.tags)),
cuts as (select page_id, pos, done[pos] as d, substr(plain, (done[pos].s + 1)::bigint, (done[pos].e - done[pos].s)::bigint) as part from pages_read, unnest(range(1, len(done) + 1)) as u(pos)),
spans as (select page_id, pos, d.s + length(part) - length(ltrim(part, chr(10))) as s, d.s + length(rtrim(part, chr(10))) as e, trim(part, chr(10)) as body, d.tag as tag from cuts where trim(part, chr(10)) <> '')
"""


def _span_rows(label: str = "tag", kind: str = "", where: str = "true") -> str:
    return f'select page_id, (row_number() over (partition by page_id order by pos) - 1)::int as ord, s::int as start, e::int as "end", body as text, {label} as label{kind} from spans where {where}'


def _case(m: dict[str, str]) -> str:
    return "case tag " + " ".join(f"when '{k}' then '{v}'" for k, v in m.items()) + " end"


_MAPS = [*ENTITIES, *LABELS]
_IS_ENTITY = "tag in (" + ", ".join(f"'{x}'" for x in ENTITIES) + ")"


def _rebuild(tags: dict[str, str], columns: str) -> str:
    mapped = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in tags.items()) + " end"
    return f"""
with recursive made as (
  select doc_id, text, kind, ord, s, e, {mapped} as tag from (
    select doc_id, text, 0 as kind, 0 as ord, doc_id % 7 as s, doc_id % 7 + 40 as e, 'Whole Part' as label from documents
    union all select doc_id, text, 0, 1, doc_id % 7 + 20, doc_id % 7 + 60, 'Crossing!' from documents
    union all select doc_id, text, 1, 0, doc_id % 5 + 3, doc_id % 5 + 14, 'Name' from documents
    union all select doc_id, text, 1, 1, doc_id % 7, doc_id % 7 + 40, 'Twin' from documents) where e <= length(text)),
ranked as (select *, row_number() over (partition by doc_id order by s, s - e, kind, ord) as k from made),
r as (
  select doc_id, 0::bigint as k, []::struct(s bigint, e bigint, tag varchar)[] as kept from documents
  union all
  select r.doc_id, x.k, case when len(list_filter(kept, lambda a: a.e > x.s and a.e < x.e)) > 0 then kept else list_append(kept, {{'s': x.s, 'e': x.e, 'tag': x.tag}}) end
  from r join ranked x on x.doc_id = r.doc_id and x.k = r.k + 1),
last as (select doc_id, max(k) as n, arg_max(kept, k) as kept from r group by doc_id),
events as (
  select doc_id, kept[i].s as off, 1 as kind, i as ord, '<' || kept[i].tag || '>' as mark from last, unnest(range(1, len(kept) + 1)) as u(i)
  union all select doc_id, kept[i].e, 0, -i, '</' || kept[i].tag || '>' from last, unnest(range(1, len(kept) + 1)) as u(i)),
pieces as (select doc_id, off, row_number() over w as n, mark, coalesce(lag(off) over w, 0) as before from events window w as (partition by doc_id order by off, kind, ord)),
built as (select p.doc_id, string_agg(substr(d.text, (before + 1)::bigint, (off - before)::bigint) || mark, '' order by n) as head, max(off) as off from pieces p join documents d using (doc_id) group by p.doc_id),
rebuilt as (select d.doc_id, coalesce(head, '') || substr(d.text, (coalesce(off, 0) + 1)::bigint) as tagged, last.n, len(last.kept) as kept from documents d join last using (doc_id) left join built using (doc_id))
select {columns} from rebuilt"""


def _nearest(text: str, segment: str, approx: str) -> str:
    """The start of segment nearest to approx, as an expression over a list of all occurrences."""
    places = f"list_filter(range(0, greatest(length({text}) - length({segment}) + 1, 0)), lambda p: substr({text}, p + 1, length({segment})) = {segment})"
    return f"list_sort(list_transform({places}, lambda p: {{'d': abs(p - {approx}), 'p': p}}))[1].p"


_SEGMENT = "substr(text, doc_id % 40 + 1, 4)"


def _own(text: str, shift: str, max_dist: int, more: str = "") -> str:
    return f"""
with a as (select doc_id, {text} as text, trim(substr(text, 21, 30), {_BLANK}) as seg, 20 + {shift} as approx from documents),
b as (select *, {_nearest("text", "seg", "approx")} as p from a), c as (select *, abs(p - approx) <= {max_dist} as near from b)
select doc_id, case when near then p end::int as start, case when near then p + length(seg) end::int as "end", case when near then 'exact' else 'unmatched' end as status,
       case when near then seg end as text, {more} near as all_aligned from c"""


_CELLS = """
with e as (select vec_id // 20 as g, vec_id % 20 as k, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
cells as (select a.g, a.k::int as i, (b.k - 10)::int as j, (case when a.n * b.n > 0 then list_dot_product(a.v, b.v) / (a.n * b.n) else 0 end + 1) / 2 as sim from e a join e b on a.g = b.g where a.k < 10 and b.k >= 10),
best as (select *, row_number() over (partition by g, i order by sim desc, j) as r, row_number() over (partition by g, j order by sim desc, i) as c from cells),
mutual as (select g, i, j from best where r = 1 and c = 1)
"""
_ITERMAX = f"""{_CELLS},
t as (select b.*, r = 1 and c = 1 as got, not bool_or(r = 1 and c = 1) over (partition by g, i) as fi, not bool_or(r = 1 and c = 1) over (partition by g, j) as fj from best b),
u as (select *, sim * case when fi and fj then 1 when fi or fj then 0.9 else 0 end as s, bool_or(fi) over (partition by g) and bool_or(fj) over (partition by g) as go from t),
v as (select *, row_number() over (partition by g, i order by s desc, j) as r2, row_number() over (partition by g, j order by s desc, i) as c2 from u),
found as (select g, i, j from v where got or (go and r2 = 1 and c2 = 1 and (fi or fj)))
"""
_GREEDY = f"""{_CELLS.replace("with e as", "with recursive e as")},
ordered as (select *, row_number() over (partition by g order by sim desc, i, j) as k from cells where sim > 0),
walk as (select distinct g, 0::bigint as k, []::int[] as ui, []::int[] as uj from cells
  union all select w.g, o.k, case when list_contains(ui, i) or list_contains(uj, j) then ui else list_append(ui, i) end, case when list_contains(ui, i) or list_contains(uj, j) then uj else list_append(uj, j) end
  from walk w join ordered o on o.g = w.g and o.k = w.k + 1),
last as (select g, arg_max(ui, k) as ui, arg_max(uj, k) as uj from walk group by g),
found as (select g, ui[n] as i, uj[n] as j from last, unnest(range(1, len(ui) + 1)) as u(n))
"""
_TOP = "top as (select g, i, (r - 1)::int as rank, j, sim from best where r <= 3 and (sim >= 0.52 or r = 1))"
_NAME = "['the', 'Ghent', '12', ',', 'river', 'van'][((g + {} * 5) % 6 + 1)::int]"
_WEIGHT = "case {} when 'the' then 0.3 when 'van' then 0.3 when '12' then 0.8 when ',' then 0.1 else 1.0 end"


def _clusters(source: str, keys: str, gap: int, name: str = "filled") -> str:
    """CTEs <name>_rows (keys, idx, cluster) and <name> (keys, cluster, lo, hi, n)."""
    return f"""
{name}_d as (select distinct {keys}, idx from {source}),
{name}_l as (select *, coalesce(idx - lag(idx) over (partition by {keys} order by idx) - 1 > {gap}, true) as fresh from {name}_d),
{name}_rows as (select {keys}, idx, (sum(fresh::int) over (partition by {keys} order by idx) - 1)::int as cluster from {name}_l),
{name} as (select {keys}, cluster, min(idx) as lo, max(idx) as hi, count(*)::int as n from {name}_rows group by {keys}, cluster)"""


_INDICES = "with ix as (select doc_id // 20 as g, ((doc_id * doc_id + 3 * doc_id) % 61)::int as idx from documents)"
_OFFSETS = f"""
with t as (select doc_id, regexp_extract_all(text, '{_TOKEN}') as toks, string_split_regex(text, '{_TOKEN}') as gaps from documents),
o as (select doc_id, i - 1 as idx, length(toks[i]) as n, sum(length(gaps[i]) + coalesce(length(toks[i - 1]), 0)) over (partition by doc_id order by i) as start from (select doc_id, toks, gaps, unnest(range(1, len(toks) + 1)) as i from t))"""
_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_LOG = "case when {0} > 0 then {0} / t * log2({0} / t) else 0 end"

ORACLES = {
    "tag_parse": _tags() + _span_rows(),
    "tag_udtf": _tags() + _span_rows(),
    "tag_plain_text": _tags() + "select page_id, length(plain)::int as n, md5(plain) as plain_md5 from pages_read",
    "tag_allowed": _tags(allowed=["h1", "p", "li"]) + _span_rows(),
    "tag_maps": _tags(allowed=_MAPS) + _span_rows(_case(LABELS), ", 'span' as kind", f"not {_IS_ENTITY}") + " union all " + _span_rows(_case(ENTITIES), ", 'entity' as kind", _IS_ENTITY),
    "tag_attachments": _tags("replace(replace(html, '<nav>', '<attachment>'), '</nav>', '</attachment>')", attachments=False) + _span_rows(),
    "tag_task": _tags(allowed=_MAPS)
    + f"""select p.page_id, count(tag) filter (not {_IS_ENTITY})::int as segments, coalesce(array_to_string(list_sort(list_distinct(list({_case(LABELS)}) filter (not {_IS_ENTITY}))), '|'), '') as labels_present,
       'web' as classification, 'Web Page' as label, count(tag) filter ({_IS_ENTITY})::int as n_entities from pages_read p left join spans using (page_id) group by p.page_id""",
    "rebuild_nested": _rebuild({"Whole Part": "whole_part", "Crossing!": "crossing", "Name": "person", "Twin": "twin"}, "doc_id, md5(tagged) as tagged_md5, n::int as total, (n - kept)::int as skipped_crossing"),
    "rebuild_task": _rebuild({"Whole Part": "whole_part", "Crossing!": "crossing", "Name": "person", "Twin": "twin"}, "doc_id, md5(tagged) as tagged_md5"),
    "rebuild_update": _rebuild({"Whole Part": "whole", "Crossing!": "crossing", "Name": "person", "Twin": "twin"}, "doc_id, md5(tagged) as tagged_md5, 'old' as original, n::int as total"),
    "sanitize_spans": f"""
with a as (select doc_id, text, greatest(least(doc_id % 50 - 3, length(text)), 0) as a from documents),
b as (select *, greatest(least(doc_id % 50 + doc_id % 9 - 2, length(text)), a) as b from a), c as (select *, substr(text, a + 1, b - a) as part from b)
select doc_id, case when trim(part, {_BLANK}) = '' then b else a + length(part) - length(ltrim(part, {_BLANK})) end::int as start,
       case when trim(part, {_BLANK}) = '' then b else a + length(rtrim(part, {_BLANK})) end::int as "end" from c""",
    "find_exact": f"""
with a as (select doc_id, text, {_SEGMENT} as seg from documents), b as (select doc_id, list_filter(range(0, length(text) - length(seg) + 1), lambda p: substr(text, p + 1, length(seg)) = seg) as f from a)
select doc_id, len(f)::int as n, array_to_string(f, ',') as starts from b""",
    "nearest_exact": f"with a as (select doc_id, text, {_SEGMENT} as seg, doc_id * 37 % 300 as approx from documents) select doc_id, {_nearest('text', 'seg', 'approx')}::int as start from a",
    "map_spans_exact": _own("text", "doc_id % 31 - 15", 12, "1.0::double as similarity, seg as detected, approx::int as approx_start,"),
    "map_spans_project": _own("text", "doc_id % 31 - 15", 20).replace("select doc_id, text as text, trim", "select doc_id, 'Note: ' || text as text, trim"),
    "map_spans_regex": rf"""
with a as (select doc_id, text, trim(replace(substr(text, 21, 30), ' ', '  '), {_BLANK}) as seg, 15 as approx from documents),
b as (select *, {_nearest("text", "seg", "approx")} as p, array_to_string(list_transform(regexp_extract_all(seg, '{_TOKEN}'), lambda t: regexp_escape(t)), '[^\p{{L}}\p{{N}}_]*') as pat, substr(text, 16, least(length(text), 15 + 2 * length(seg)) - 15) as win from a),
c as (select *, regexp_extract(win, pat) as m, regexp_extract(text, pat) as any_m from b where pat <> '' and p is null union all select *, '', '' from b where pat = '' or p is not null),
d as (select *, case when p is not null then p when m <> '' then 15 + strpos(win, m) - 1 when any_m <> '' then strpos(text, any_m) - 1 end as s, case when p is not null then length(seg) when m <> '' then length(m) else length(any_m) end as n from c),
e as (select *, coalesce(abs(s - 15) <= 20, false) as near from d)
select doc_id, case when near then s end::int as start, case when near then s + n end::int as "end", case when not near then 'unmatched' when p is not null then 'exact' else 'regex' end as status, near as all_aligned from e""",
    "map_tags": f"""
with a as (select doc_id, text, substr(text, 1, 25) as part from documents), b as (select *, trim(part, {_BLANK}) as seg, length(part) - length(ltrim(part, chr(10))) as approx from a),
c as (select *, {_nearest("text", "seg", "approx")} as p from b)
select doc_id, md5(case when seg <> '' and abs(p - approx) <= 20 then substr(text, 1, p) || '<head_line>' || seg || '</head_line>' || substr(text, p + length(seg) + 1) else text end) as mapped_md5 from c""",
    "label_to_tag": "select conv_id, turn, trim(regexp_replace(replace(lower(trim('  ' || upper(role[1]) || substr(role, 2) || ' Turn (' || turn || ')! ')), ' ', '_'), '[^a-z0-9_]+', '_', 'g'), '_') as tag from conversations",
    "invert_map": "select doc_id, array_to_string(list_sort(case when doc_id % 2 = 0 then [lang || '=b', source || '=c'] else [source || '=a', lang || '=b', 'other=c'] end), ',') as inverted from documents",
    "merge_annotations": "select doc_id, 3 as n_spans, 2 as n_entities, concat_ws(',', doc_id % 7, doc_id % 7 + 20, 20 + doc_id % 31 - 15) as starts from documents",
    "format_annotations": "select conv_id, turn, role as classification, 1 as n_entities, 1 as n_spans, turn::int as start, role as label from conversations",
    "validate_projection": """
with s as (select doc_id, text, doc_id % 9 as a, doc_id % 9 + 12 as b, 'a' as l, 0 as o from documents union all select doc_id, text, doc_id % 11 + 4, doc_id % 11 + 20, 'b', 1 from documents
           union all select doc_id, text, doc_id % 3, doc_id % 3 + 500, 'c', 2 from documents),
n as (select *, lead(a) over w as na, lead(b) over w as nb from s window w as (partition by doc_id order by a, b, o)),
c as (select doc_id, sum((b > length(text))::int + coalesce((b > na and b < nb)::int, 0)) as n from n group by doc_id)
select doc_id, n = 0 as valid, n::int as n_issues from c""",
    "entropy": f"""
with w as (select doc_id, (doc_id * 3 % 7)::double as a, (doc_id * 5 % 11)::double as b, (doc_id * 7 % 4)::double as c, (doc_id % 2)::double as d from documents), t as (select *, a + b + c + d as t from w)
select doc_id, case when t > 0 then round(0 - ({" + ".join(_LOG.format(x) for x in "abcd")}), 6) else 0 end as bits from t""",
    "tokenize_offsets": f"""{_OFFSETS}
select t.doc_id, len(toks)::int as n, coalesce(s, 0)::bigint as starts, coalesce(e, 0)::bigint as ends, md5(array_to_string(toks, chr(1))) as tokens_md5
from t left join (select doc_id, sum(start) as s, sum(start + n) as e from o group by doc_id) using (doc_id)""",
    "tokenize_words": r"select doc_id, len(list_filter(string_split_regex(text, '[\x09-\x0d\x1c-\x20\x85\p{Z}]+'), lambda x: x <> ''))::int as n from documents",
    "token_importance": rf"""
with t as (select doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) as t from documents)
select doc_id, round(sum(case when not regexp_matches(t, '[\p{{L}}\p{{N}}]') then 0.1::double when lower(t) in ({_STOP}) then 0.3 when regexp_matches(t, '^[\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+$') then 0.8 else 1 end), 4) as importance, count(*) as n from t group by doc_id""",
    "similarity_cells": _CELLS + "select g, i, j, round(sim, 6) as sim from cells",
    "similarity_distort": _CELLS + "select g, i, j, round(sim * (1 - (j / 9.0::double - i / 9.0::double) * (j / 9.0::double - i / 9.0::double) * 0.5), 6) as sim from cells",
    "align_fwd": _CELLS + "select g, i, j from best where r = 1",
    "align_rev": _CELLS + "select g, i, j from best where c = 1",
    "align_inter": _CELLS + "select g, i, j from mutual",
    "align_threshold": _CELLS + "select g, i, j from cells where sim >= 0.5",
    "align_itermax": _ITERMAX + "select g, i, j from found",
    "align_greedy": _GREEDY + "select g, i, j from found",
    "align_all": "select g, method, count(*) as n from ("
    + " union all ".join(f"select g, '{m}' as method from ({q})" for m, q in (("inter", _CELLS + "select g from mutual"), ("itermax", _ITERMAX + "select g from found"), ("fwd", _CELLS + "select g from best where r = 1"), ("rev", _CELLS + "select g from best where c = 1"), ("greedy", _GREEDY + "select g from found"), ("threshold", _CELLS + "select g from cells where sim >= 0.5")))
    + ") group by g, method",
    "topk_candidates": f"{_CELLS}, {_TOP} select g, i, rank, j, round(sim, 6) as sim from top",
    "pool_words": _CELLS + "select g, (i // 3)::int as i, (j // 3)::int as j, round(max(sim), 6) as sim from cells group by g, i // 3, j // 3",
    "word_means": """
with p as (select vec_id // 20 as g, (vec_id % 20 // 3)::int as word, embedding as v from embeddings where vec_id % 20 < 10), m as (select g, word, d, avg(v[d]::double) as m from p, unnest(range(1, 65)) as u(d) group by g, word, d)
select g, word, round(sum(m), 5) as total, count(*)::int as dim from m group by g, word""",
    "clusters_contiguous": f"{_INDICES}, {_clusters('ix', 'g', 2)} select g, idx, cluster from filled_rows",
    "clusters_filled": f"{_INDICES}, {_clusters('ix', 'g', 2)} select * from filled",
    "clusters_largest": f"{_INDICES}, {_clusters('ix', 'g', 2)} select * from filled qualify row_number() over (partition by g order by n desc, lo) = 1",
    "clusters_merge": f"""{_INDICES}, {_clusters("ix", "g", 1)},
a as (select g, lo, hi, hi - lo + 1 as w, lag(hi - lo + 1) over (partition by g order by lo) as lw, lag(hi) over (partition by g order by lo) as lh from filled),
b as (select *, coalesce(lo - lh - 1 > 1 + floor(greatest(w, lw) * 0.2 * pow(1.2, greatest(w, lw))), true) as fresh from a),
c as (select *, sum(fresh::int) over (partition by g order by lo) as chain from b),
v as (select c.g, chain, c.lo, c.hi, coalesce(sum(case when idx % 3 = 0 then 0.3::double else 1 end), 0) as v from c left join (select distinct g, idx from ix) x on x.g = c.g and x.idx between c.lo and c.hi group by c.g, chain, c.lo, c.hi),
s as (select g, min(lo) as lo, max(hi) as hi, sum(v) as score from v group by g, chain),
t as (select g, lo, hi, case when hi - lo + 1 > 4 * 8 + 6 then 0 else score end as score from s)
select g, lo, hi, round(score, 4) as score from t qualify row_number() over (partition by g order by score desc, -abs((lo + hi) / 2 - 30.0) desc, hi - lo, lo) = 1""",
    "exact_match_filter": f"""{_CELLS}, {_TOP}, f as (select *, lower({_NAME.format("i")}) = lower({_NAME.format("j")}) as eq from top)
select g, i, rank, j from f qualify eq or not bool_or(eq) over (partition by g, i)""",
    "region_estimate": f"""{_CELLS}, {_TOP}, w as (select g, j as idx, {_WEIGHT.format(_NAME.format("i"))} as w from top where rank = 0), votes as (select g, idx from w qualify w >= 0.5 or not bool_or(w >= 0.5) over (partition by g)),
{_clusters("votes", "g", 3)}, win as (select * from filled qualify row_number() over (partition by g order by n desc, lo) = 1)
select g, greatest(0, lo - greatest(3, floor((hi - lo + 1) * 0.3)))::int as lo, least(10, hi + greatest(3, floor((hi - lo + 1) * 0.3)) + 1)::int as hi from win""",
    "alignment_weights": f"{_CELLS} select g, j as idx, max({_WEIGHT.format(_NAME.format('i'))})::double as weight from mutual group by g, j",
    "covered_tokens": f"""{_OFFSETS}, s as (select doc_id, k::int as span_id, doc_id % 40 + k * 15 as a, doc_id % 40 + k * 15 + 12 as b from documents, unnest([0, 1]) as u(k))
select s.doc_id, span_id, count(*) as n, min(idx)::int as first, max(idx)::int as last from s join o on s.doc_id = o.doc_id and greatest(a, start) < least(b, start + o.n) group by s.doc_id, span_id""",
    "span_tokens": f"""{_CELLS}, s as (select g, k::int as span_id, k * 4 as a, k * 4 + 18 as b from e where k < 10), m as (select s.g, span_id, j as idx from s join mutual m on s.g = m.g and greatest(a, i * 5) < least(b, i * 5 + 4)),
{_clusters("m", "g, span_id", 1)} select g, span_id, lo, hi, n from filled qualify row_number() over (partition by g, span_id order by n desc, lo) = 1""",
    "embed_pieces": f"""
with t as (select item_id, regexp_extract_all(text, '{_TOKEN}') as t from benchmark), p as (select item_id, t, list_transform(t, lambda x: (length(x) + 2) // 3) as p from t)
select item_id, len(t)::int as n, list_sum(p)::int as n_pieces, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * (i - 1)))::bigint as words, list_sum(list_transform(t, lambda x: length(x)))::double as letters,
       case when len(p) > 2 then list_sum(p[1:2])::int else 0 end as first, list_sum(p[1:5])::int as last from p""",
    "align_mwmf": _CELLS.replace("with e as", "with recursive e as") + """
, r as (
  select distinct g, 0 as i, 0 as used, 0.0::double as w from cells
  union all
  select g, i, used, max(w) as w from (select r.g, r.i + 1 as i, r.used | (1 << c.j::int) as used, r.w + c.sim as w from r join cells c on c.g = r.g and c.i = r.i and (r.used & (1 << c.j::int)) = 0) group by g, i, used
)
select g, 10::bigint as n, round(max(w), 6) as weight from r where i = 10 group by g""",
    "embed_texts": f"with t as (select item_id, regexp_extract_all(text, '{_TOKEN}') as t from benchmark) select item_id, len(t)::int as n, 37 as dim, list_sum(list_transform(t, lambda x: length(x)))::double as letters from t",
}
