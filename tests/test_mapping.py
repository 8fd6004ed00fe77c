import difflib
import random

from spanframe.functions import kernels as K
from spanframe.operators import mapping
from spanframe.schema import SPANS


def test_fuzzy_goldens():
    fox = "The quick brown fox jumps over the lazy dog"
    assert K.best_fuzzy(fox, "quick brown", 4, 10) == (4, 15, 1.0)
    start, end, ratio = K.best_fuzzy(fox, "quck brown", 4, 10)
    assert (start, end) == (4, 15) and ratio > 0.8
    start, end, ratio = K.best_fuzzy("The quick  brown fox", "quick brown", 4, 10)
    assert (start, end) == (4, 16) and ratio > 0.9
    assert K.best_fuzzy("The quick brown fox", "brown", None) == (10, 15, 1.0)
    assert K.best_fuzzy("The quick brown fox", "fox", 0, 5)[2] < 0.7
    assert K.best_fuzzy("", "abc", 0) == K.best_fuzzy("abc", "", 0) == (None, None, 0.0)


def test_fuzzy_matches_a_plain_search():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rnd = random.Random(3)
    for _ in range(150):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 30)))
        segment = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))
        spare, best = max(5, int(0.2 * len(segment))), (0.0, None, None)
        for i in range(len(text)):
            for j in range(i + max(1, len(segment) - spare), min(i + len(segment) + spare, len(text)) + 1):
                ratio = 2 * common(segment, text[i:j]) / (len(segment) + j - i)
                if ratio > best[0]:
                    best = (ratio, i, j)
            if best[0] == 1.0:
                break
        got = K.best_fuzzy(text, segment, None)
        assert got == ((None, None, 0.0) if best[1] is None else (*K.sanitize(text, best[1], best[2]), best[0]))


def test_map_spans(spark):
    rows = [
        ("The patient has a fever and cough.", [(0, 7, "patient", ["p"])], []),
        ("Short text", [(100, 105, "missing", [])], None),
        ("The quick  brown fox", [(4, 10, "quick brown", ["q"]), (4, 9, "quck brwn", ["t"])], [(0, 0, "", ["e"])]),
    ]
    df = spark.createDataFrame(rows, f"original_text string, spans {SPANS}, entities {SPANS}")
    a, b, c = mapping.map_spans(df).collect()
    assert (a.spans[0].start, a.spans[0].end, a.spans[0].status, a.all_aligned) == (4, 11, "exact", True)
    assert (b.spans[0].start, b.spans[0].status, b.spans[0].similarity, b.all_aligned) == (None, "unmatched", 0.0, False)
    assert (c.spans[0].start, c.spans[0].end, c.spans[0].status) == (4, 16, "regex")
    assert c.spans[0].similarity == round(difflib.SequenceMatcher(None, "quick brown", "quick  brown").ratio(), 4)
    assert (c.entities[0].start, c.entities[0].end, c.spans[1].status) == (0, 0, "unmatched")
    # the narrowest window that has a place similar enough decides
    for least, text in ((0.7, "quick  br"), (0.85, "quick  brown")):
        fuzzy = mapping.map_spans(df, fuzzy=True, min_ratio=least).collect()[2].spans[1]
        assert (fuzzy.status, fuzzy.text) == ("fuzzy", text)


def test_far_exact_hit_keeps_its_similarity(spark):
    df = spark.createDataFrame([("x" * 50 + "word", [(0, 4, "word", [])])], f"original_text string, spans {SPANS}")
    got = mapping.map_spans(df, entities=None).first().spans[0]
    assert (got.start, got.status, got.similarity) == (None, "unmatched", 1.0)


def test_map_tags(spark):
    df = spark.createDataFrame([("The  quick brown fox", "<a>The quick</a> brown <b>fox</b>")], "original_text string, tagged_text string")
    assert mapping.map_tags(df).first().mapped_text == "<a>The  quick</a> brown <b>fox</b>"
