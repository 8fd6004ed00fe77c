"""Pictures of candidates and paths: one column a source token, one row a rank."""

from __future__ import annotations

from html import escape

from ..functions.kernels import Candidates

_TINTS = ("#cfe8ff", "#d7f5d3", "#ffe3c2", "#f3d4ff", "#fff5b8")


def cell_paths(candidates: Candidates, paths: list[dict], most: int = 5) -> dict[tuple[int, int], list[int]]:
    """The paths through each cell (source token, rank), by number."""
    out: dict[tuple[int, int], list[int]] = {}
    for n, p in enumerate(paths[:most]):
        for src, rank, _ in p["path"]:
            out.setdefault((src, rank), []).append(n)
    return out


def _describe(p: dict, arrow: str) -> str:
    steps, last = [], None
    for src, rank, tgt in p["path"]:
        if last is not None and src > last + 1:
            steps.append(f"[{src - last - 1} skipped]")
        steps.append(f"{tgt} (source {src}, rank {rank})")
        last = src
    return arrow.join(steps)


def render_text(candidates: Candidates, src: list[str], tgt: list[str], paths: list[dict] = (), final: list[int] = (), most: int = 5) -> str:
    """Plain text: every cell has the target index, its token and score, P and the numbers of paths, and # in the final cluster."""
    if not any(candidates):
        return "no candidates"
    through, chosen = cell_paths(candidates, paths, most), set(final)
    grid = [["rank", *(f"{i} {t}" for i, t in enumerate(src))]]
    for rank in range(max(map(len, candidates))):
        row = [str(rank)]
        for i, cells in enumerate(candidates):
            if rank < len(cells):
                j, score = cells[rank]
                marks = "".join(f" P{n}" for n in through.get((i, rank), ())) + " #" * (j in chosen)
                row.append(f"{j} {tgt[j]} {score:.2f}{marks}")
            else:
                row.append("")
        grid.append(row)
    width = [max(len(r[c]) if c < len(r) else 0 for r in grid) for c in range(max(map(len, grid)))]
    lines = [" | ".join(x.ljust(w) for x, w in zip(r, width, strict=False)).rstrip() for r in grid]
    lines.insert(1, "-+-".join("-" * w for w in width))
    return "\n".join(lines + [f"P{n} {p['score']:.2f}: {_describe(p, ' > ')}" for n, p in enumerate(list(paths)[:most])])


def render_html(candidates: Candidates, src: list[str], tgt: list[str], paths: list[dict] = (), final: list[int] = (), most: int = 5) -> str:
    """The same as an HTML table; token texts are escaped."""
    if not any(candidates):
        return "<p>no candidates</p>"
    through, chosen = cell_paths(candidates, paths, most), set(final)
    out = ["<table><tr><th>rank</th>", *(f"<th>{i}<br>{escape(t)}</th>" for i, t in enumerate(src)), "</tr>"]
    for rank in range(max(map(len, candidates))):
        out.append(f"<tr><th>{rank}</th>")
        for i, cells in enumerate(candidates):
            if rank >= len(cells):
                out.append("<td></td>")
                continue
            j, score = cells[rank]
            own = through.get((i, rank), ())
            style = f"background:{_TINTS[own[0] % len(_TINTS)]};" if own else ""
            style += "outline:2px solid #b8860b;" if j in chosen else ""
            out.append(f'<td style="{style}">{j} {escape(tgt[j])}<br>{score:.2f}{"".join(f" P{n}" for n in own)}</td>')
        out.append("</tr>")
    out.append("</table><ol start=0>")
    out += [f"<li>{p['score']:.2f}: {_describe(p, ' &rarr; ')}</li>" for p in list(paths)[:most]]
    return "".join(out) + "</ol>"
