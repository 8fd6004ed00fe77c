import pytest

from spanframe.llm import html as H

PAGES = [
    ("<body><header><h1>Site</h1><nav><a>Home</a></nav></header><div id='cookie-notice'>We use cookies</div><div class=content><h1>Title</h1><p>One <b>two</b>three</p><div class='ad'>Buy now</div>"
     "<p>Four&nbsp;five &lt;six&gt;</p><form>Name <input> <label>Mail</label></form><div class='comments'><p>first comment by me</p></div></div><aside class=sidebar>Related</aside><footer>(c)</footer>", "Title\nOne twothree\nFour five <six>"),
    ("<p>Just plain text</p><p>Second</p>", "Just plain text\nSecond"),
    ("<main><p>a<br>b</p><ul><li>c</li><li>d\n e</li></ul><table><tr><td>f</td></tr></table></main>", "a\nb\nc\nd e\nf"),
    ("<article><p>x<script>var p = '</p>';</script> y<!-- no --><style>p{}</style></p></article>", "x y"),
    ("<nav>menu</nav><article>That it.</article><footer>much longer than the article, all of it</footer>", "That it."),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>cut off <a href='x", "cut off"),
    ("<article><p>a &amp;&#65;&#x42; b</p></div></article>", "a &AB b"),
    ("<article>one<aside>" + "much boilerplate " * 200 + "</aside><p>two</p></article>", "one\ntwo"),
    ("<article></article>", ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<nav>only a menu</nav>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_region_is_the_best_one():
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(200):
        scores = [rnd.choice([-2.0, -0.5, 0.25, 1.0]) for _ in range(rnd.randint(0, 12))]
        a, b = H.best_region(scores)
        assert sum(scores[a:b]) == max([0.0, *(sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2))])


LAYOUTS = [
    '<html><body class="has-sidebar has-footer no-ads"><p>{}</p><p>{}</p></body></html>',
    '<html><body><article class="post-with-sidebar"><p>{}</p><p>{}</p></article></body></html>',
    '<html><body class="sidebar-right"><div id="ads-page"><div class="header-wide"><main><p>{}</p><p>{}</p></main></div></div></body></html>',
    '<body class="footer-layout"><div class="menu left"><p>{}</p><p>{}</p></div></body>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_outer_layout_names_lose_no_article(layout):
    one, two = "word " * 59 + "end", "more " * 39 + "last"
    assert H.main_text(layout.format(one, two)) == f"{one}\n{two}"


def test_the_scan_decides():
    """Words that score above zero by themselves, outside the best region: without the scan they would be kept."""
    article, teaser = "word " * 80, "short teaser text here "
    cards = "".join(f"<article><h3>{teaser}</h3></article>" + "<hr><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>" * 3 for _ in range(3))
    page = f"<body>{cards}<article><p>{article}</p></article></body>"
    assert H.main_text(page) == article.strip()
    score = H.scorer()
    assert any(score.word(c) > 0 for _, _, w, _, _, c in H.Page(page).texts() if w[:1] == ["short"])


def test_boilerplate_counts_word_by_word():
    """Without an element of its own a short tail behind a long advert is not the article's; a long one is."""
    advert = "<div class=ad>" + "buy " * 60 + "</div>"
    for tail, kept in (("tail " * 5, False), ("tail " * 200, True)):
        text = H.main_text(f"<p>{'word ' * 100}</p>{advert}<p>{tail}</p>")
        assert ("tail" in text) == kept and "buy" not in text and text.startswith("word word")


def test_weights_on_pages_not_learned_from():
    rows, _ = H.labelled_rows(H.labelled_pages(150, seed=99))
    score = H.scorer()
    good = sum(n for c, n, y in rows if (score.word(c) > 0) == y)
    assert good / sum(n for _, n, _ in rows) > 0.97


def test_whole_texts_of_pages_not_learned_from():
    found = missed = wrong = 0
    for page in H.labelled_pages(150, seed=98):
        want = sum(len(w) for _, _, w, _, _, _ in H.Page(page).texts() if w[:1] == ["a"])
        words = H.main_text(page).split()
        found += words.count("a")
        missed += want - words.count("a")
        wrong += words.count("b")
    assert missed < 0.03 * found and wrong < 0.03 * found


def test_columns(spark):
    rows = [(1, "u", p, "mine") for p, _ in PAGES] + [(2, None, None, None), (2, "u", "<p>" + "word " * 100_000 + "</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = H.extract_main_text(df).collect()
    assert [r.text for r in got[: len(PAGES)]] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got) and got[-1].n_chars == 499_999 and got[-2].text == ""
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
