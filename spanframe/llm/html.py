"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Every word scores the log odds, clipped to one, that a word in such a place belongs
to the article; every tag costs, by its name. A word's place is the names, class and id words and roles of all open
elements, for class names and the like whether the element holds most of the page, whether the word is in a link or a block of links, how long its
block is, and in which part of the page. The weights are fitted by logistic regression on labelled pages: `labelled_pages`
writes pages of many layouts whose every word is known to be article or not, with layout classes (a "sidebar" page) on
outer elements, articles without any element of their own, adverts of all lengths within them and unmarked words around
them. Words outside the article count against it one by one. A linear scan (Kadane) finds the best contiguous region.

Inside it, words that score below zero are left out. If the region lies in an element that is itself known to hold articles,
the rest of that element belongs too: an advert in the midst of an article, however long, does not split it.

Scripts, styles, comments, forms' controls and the head never give words. Character references are decoded, white space
inside a block becomes one space, blocks are joined by one newline; nothing else is dropped or capped.

Defined cases: null or empty html, and pages without article words, give an empty text; unclosed and misnested tags, and
pages cut off anywhere, are read as far as they go; repeated rows each get a row.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C
from .gif import _map

# HTML's void elements, its elements without text of their own, those that only format text, and those that start a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button datalist head title".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMED = re.compile(r"""\b(class|id|role|aria-label|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
#: What follows such a word in a class name says how the page is laid out, not what the element holds.
_LAYOUT = frozenset("with has have no without not is hide hidden show using".split())
#: Most that a word counts; least score of an element's own names that makes it a holder of articles; share of a page from which an element's names
#: are those of the page's layout: if a heading or article is in it, and if not (long comments are no layout).
CLIP, HOLDER, MOST, NEARLY_ALL = 1.0, 1.0, 0.5, 0.85
#: What a tag costs, and what more by the share of tags of its name outside articles.
TAG, TAG_OUTSIDE = 0.03, 0.4


def _names_of(value: str) -> list[str]:
    out = []
    for name in value.split():
        for part in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()):
            if part in _LAYOUT:
                break
            out.append(f".{part}")
    return out


def _features(name: str, attrs: str) -> tuple[str, ...]:
    found = [] if name in INLINE else [f"<{name}>"]
    for m in _NAMED.finditer(attrs):
        if m[1].lower() == "hidden":
            found.append("hidden")
        else:
            found += _names_of(m[2] or m[3] or m[4] or "")
    return tuple(dict.fromkeys(found))


class Page:
    """A page's elements (parent, features) and tokens: (string, element) for texts and (name, element, starts a line) for tags.

    A tag's element is the one it opens or closes; element 0 is the page.
    """

    def __init__(self, page: str):
        self.parent, self.own, self.tokens = [0], [()], []
        parent, own, out = self.parent, self.own, self.tokens
        at, stack, end = 0, [("", 0)], len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            cut = m.start() if m else end
            if cut > at:
                out.append((page[at:cut], stack[-1][1]))
            if not m:
                break
            at = m.end()
            if m[1] is not None:
                out.append((m[1].replace("&", "&amp;"), stack[-1][1]))
                continue
            if not m[3]:
                continue
            name = m[3].lower()
            block = name in BLOCK
            if m[2]:
                out.append((name, stack[-1][1], block))
                if any(n == name for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            elif name in VOID or m[4].endswith("/"):
                out.append((name, stack[-1][1], block))
            elif name in RAW:
                out.append((name, stack[-1][1], block))
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            else:
                if block and stack[-1][0] == "p":
                    stack.pop()
                parent.append(stack[-1][1])
                own.append(_features(name, m[4]))
                stack.append((name, len(own) - 1))
                out.append((name, len(own) - 1, block))

    def texts(self):
        """(index of the token, element, words, begins and ends with white space, context) of every text that is seen."""
        parent, own = self.parent, self.own
        silent, link = [False] * len(own), [False] * len(own)
        for e in range(1, len(own)):
            name = own[e][0][1:-1] if own[e] else ""
            silent[e] = silent[parent[e]] or name in SILENT
            link[e] = link[parent[e]] or name == "a"
        found, holds, block, blocks = [], [0] * len(own), 0, [[0, 0, 0]]  # of each block its words, those in links, and where it begins
        total = 0
        for i, t in enumerate(self.tokens):
            if len(t) == 3:
                if t[2] and blocks[-1][0]:
                    blocks.append([0, 0, total])
                continue
            text, e = t
            if silent[e]:
                continue
            text = entities.unescape(text)
            words = text.split()
            found.append((i, e, words, text[:1].isspace(), text[-1:].isspace(), len(blocks) - 1))
            holds[e] += len(words)
            blocks[-1][0] += len(words)
            blocks[-1][1] += len(words) * link[e]
            total += len(words)
        core = [bool(own[e]) and own[e][0] in ("<h1>", "<main>", "<article>") for e in range(len(own))]
        for e in range(len(own) - 1, 0, -1):  # children come after their parents
            holds[parent[e]] += holds[e]
            core[parent[e]] |= core[e]
        context: list[tuple[str, ...]] = [()]
        for e in range(1, len(own)):
            big = holds[e] > (MOST if core[e] else NEARLY_ALL) * total
            context.append(context[parent[e]] + tuple(f + "+" if big and (f[0] != "<" or f == "<form>") else f for f in own[e]))
        for i, e, words, before, after, b in found:
            size, links, start = blocks[b]
            place = ["short" if size < 5 else "long" if size > 20 else "middling"]
            if links > 0.5 * size:
                place.append("links")
            if total > 50:
                place.append(f"part{5 * start // total}")
            yield i, e, words, before, after, context[e] + tuple(place)


# Labelled pages -----------------------------------------------------------------------------------

_OTHER_PARTS = (
    ("nav", ""), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "breadcrumb"), ("header", ""), ("div", "header"), ("div", "masthead"), ("div", "top bar"), ("footer", ""),
    ("div", "footer"), ("div", "copyright"), ("aside", ""), ("div", "sidebar"), ("div", "widget"), ("section", "related"), ("div", "recommended"), ("div", "ad"), ("div", "ads"), ("div", "advert"),
    ("div", "advertisement"), ("div", "banner"), ("div", "sponsored"), ("div", "promo"), ("div", "cookie notice"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "popup modal"),
    ("div", "newsletter subscribe"), ("form", ""), ("div", "login"), ("div", "search"), ("div", "share social"), ("div", "comments"), ("section", "comments"), ("div", "comment"), ("ol", "commentlist"),
    ("div", "reply respond"), ("div", "disqus"), ("div", "pagination"), ("div", "tags"), ("div", "gdpr"), ("div", "paywall"), ("div", "skip"), ("dialog", ""), ("menu", ""), ("div", "hidden"),
)
_MAIN_PARTS = (("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post"), ("div", "entry content"), ("section", "story"), ("div", "text"), ("div", ""), ("section", ""))
_INSIDE = ("p", "p", "p", "p", "h1", "h2", "h3", "ul li", "ol li", "ul li p", "dl dd", "blockquote p", "table tbody tr td", "pre", "div", "figure figcaption", "")


def labelled_pages(n: int = 700, seed: int = 7):
    """Made pages as HTML: words of the article are "a", all others "b"."""
    rnd = random.Random(seed)

    def wrap(name: str, classes: str, inner: str) -> str:
        named = f' {rnd.choice(["class", "class", "id"])}="{classes}"' if classes else ""
        return f"<{name}{named}>{inner}</{name}>"

    def nested(path: str, inner: str) -> str:
        for name in reversed(path.split()):
            inner = f"<{name}>{inner}</{name}>"
        return inner

    def words(w: str, least: int, most: int) -> str:
        text = [w] * rnd.randint(least, most)
        if rnd.random() < 0.3:
            i = rnd.randrange(len(text))
            text[i] = nested(rnd.choice(["b", "em", "a", "span"]), text[i])
        return " ".join(text)

    def other(most: int = 12, name: str = "") -> str:
        blocks = [nested(rnd.choice(["p", "ul li a", "a", "span", "", "div", "p b", "li"]), words("b", 1, most)) for _ in range(rnd.randint(1, 8))]
        return wrap(*((name, "") if name else rnd.choice(_OTHER_PARTS)), " ".join(blocks))

    def unmarked() -> str:
        kind = rnd.random()
        if kind < 0.5:
            return nested("ul", "".join(nested("li a", words("b", 1, 3)) for _ in range(rnd.randint(3, 12))))
        return nested(rnd.choice(["div", "p", "span"]), words("b", 1, 4))

    for _ in range(n):
        body = [nested(rnd.choice(_INSIDE), words("a", 1, 60)) for _ in range(rnd.randint(1, 14))]
        kind = rnd.random()
        if kind < 0.08:  # nothing but text
            yield "".join(body)
            continue
        for _ in range(rnd.choice([0, 0, 1, 2])):
            body.insert(rnd.randint(0, len(body)), other(rnd.choice([8, 40, 120]), rnd.choice(["", "", "aside", "nav", "form", "footer"])))
        main = " ".join(body)
        if kind < 0.85:
            for _ in range(rnd.choice([1, 1, 2])):
                main = wrap(*rnd.choice(_MAIN_PARTS), main)
        before = [other() for _ in range(rnd.randint(0, 3))] + [unmarked() for _ in range(rnd.choice([0, 0, 1]))]
        after = [other(rnd.choice([12, 12, 60, 150])) for _ in range(rnd.randint(0, 4))] + [unmarked() for _ in range(rnd.choice([0, 0, 1]))]
        rnd.shuffle(before)
        rnd.shuffle(after)
        page = "".join([*before, main, *after])
        for _ in range(rnd.choice([0, 1, 1, 2])):
            layout = rnd.choice(["wrapper", "page", "container", "site", "layout", ""])
            if rnd.random() < 0.5:  # the page's layout is named after its parts
                layout = f"{layout} {rnd.choice(_OTHER_PARTS)[1].split(' ')[0] or 'nav'} {rnd.choice(['right', 'left', 'layout', 'page', 'wide'])}".strip()
            page = wrap("div", layout, page)
        layout = rnd.choice(["", "", "home", "single post", f"{rnd.choice(_OTHER_PARTS)[1]} layout".strip()])
        yield f"<html>{wrap('body', layout, page)}</html>"


def labelled_rows(pages):
    """(context, words, in the article) of every text of labelled pages, and [inside, outside] by tag name."""
    rows, tags = [], {}
    for page in pages:
        page = Page(page)
        texts = [(i, c, len(w), w[0] == "a") for i, _, w, _, _, c in page.texts() if w]
        rows += [(c, n, y) for _, c, n, y in texts]
        inside = [i for i, _, _, y in texts if y]
        for i, t in enumerate(page.tokens):
            if len(t) == 3:
                tags.setdefault(t[0], [0, 0])[not inside[0] <= i <= inside[-1]] += 1
    return rows, tags


class Scorer:
    """Weights of contexts' features ("" is the constant) and costs of tags."""

    def __init__(self, weights: dict[str, float], tags: dict[str, float]):
        self.weights, self.tags, self.known = weights, tags, {}

    def __reduce__(self):
        return Scorer, (self.weights, self.tags)

    def word(self, context: tuple[str, ...]) -> float:
        if (found := self.known.get(context)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            w = self.weights
            found = max(-CLIP, min(CLIP, w[""] + sum(w.get(f, 0.0) for f in set(context))))
            self.known[context] = found
        return found

    def tag(self, name: str) -> float:
        return self.tags.get(name, -TAG - 0.5 * TAG_OUTSIDE)

    def holder(self, own: tuple[str, ...]) -> bool:
        w = self.weights
        return sum(max(w.get(f, 0.0), w.get(f"{f}+", 0.0)) for f in own) >= HOLDER


@lru_cache(1)
def scorer() -> Scorer:
    """From logistic regression on labelled_pages."""
    found, tags = labelled_rows(labelled_pages())
    rows = [(frozenset(f), math.sqrt(n), y) for f, n, y in found]
    names = sorted({x for f, _, _ in rows for x in f})
    at = {x: i + 1 for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for r, (f, _, _) in enumerate(rows):
        x[r, [at[v] for v in f]] = 1
    y, w = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows])
    w /= w.mean()
    b = np.zeros(x.shape[1])
    ridge = np.full(len(b), 0.3)
    for _ in range(25):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    cost = {t: -TAG - TAG_OUTSIDE * (o + 1) / (i + o + 2) for t, (i, o) in tags.items()}
    return Scorer({"": float(b[0])} | {v: float(b[i]) for v, i in at.items()}, cost)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the greatest sum; 0, 0 if none is above zero."""
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best[0]:
            best = (total, start, i + 1)
    return best[1], best[2]


def main_text(page: str, score: Scorer | None = None) -> str:
    score = score or scorer()
    read = Page(page)
    scores = [score.tag(t[0]) if len(t) == 3 else 0.0 for t in read.tokens]
    texts = {}
    for i, e, words, before, after, context in read.texts():
        s = score.word(context) if words else 0.0
        scores[i] = s * len(words)
        texts[i] = (e, words, before, after, s > 0)
    a, b = best_region(scores)
    if a == b:
        return ""
    # the innermost element around the region that is known to hold articles
    chain = lambda e: [e, *chain(read.parent[e])] if e else []
    held = [set(chain(texts[i][0])) for i in range(a, b) if i in texts and texts[i][4]]
    around = sorted(set.intersection(*held), reverse=True) if held else []
    holder = next((e for e in around if score.holder(read.own[e])), None)
    inside = {holder} if holder is not None else set()
    if holder is not None:
        for e in range(holder + 1, len(read.own)):
            if read.parent[e] in inside:
                inside.add(e)
    lines: list[list[str]] = [[]]
    glued = False
    for i, t in enumerate(read.tokens):
        if len(t) == 3:
            if t[2]:
                lines.append([])
                glued = False
        elif i in texts:
            e, words, before, after, good = texts[i]
            if not words:
                glued = False
            elif good and (a <= i < b or e in inside):
                if glued and not before and lines[-1]:
                    lines[-1][-1] += words[0]
                    words = words[1:]
                lines[-1] += words
                glued = not after
            else:
                glued = False
    return "\n".join(" ".join(x) for x in lines if x)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    score = scorer()  # a few hundred weights

    def row(data):
        text = main_text((data or b"").decode(), score)
        return text, len(text)

    return _map(pages, html, [("text", T.StringType()), ("n_chars", T.LongType())], row)


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(C.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op5_html": op5_html}
ORACLES: dict[str, str] = {}
