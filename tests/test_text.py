import random
import re

from pyspark.sql import functions as F

from spanframe.functions import kernels as K
from spanframe.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_sanitize(spark):
    for text, a, b, want in (("  Hello World  ", 0, 15, (2, 13)), ("Hello", 0, 5, (0, 5)), ("  Hello  ", 0, 9, (2, 7)), (" \n ", 0, 3, (3, 3)), ("abc", -4, 99, (0, 3)), ("", 0, 0, (0, 0))):
        assert tuple(one(spark, X.sanitize_span("t", F.lit(a), F.lit(b)), t=text)) == want == K.sanitize(text, a, b)


def test_labels_and_maps(spark):
    tags = [one(spark, X.label_to_tag("t"), t=t) for t in ("Full Name!", "  ", "My Label (Special)", "my-tag", "Ünïcode 1")]
    assert tags == ["full_name", "span", "my_label__special", "my_tag", "n_code_1"]
    m = F.create_map(F.lit("loc_tag"), F.lit("Location"), F.lit("a"), F.lit("Twice"), F.lit("b"), F.lit("Twice"))
    assert one(spark, X.invert_map(m)) == {"Location": "loc_tag", "Twice": "b"}
    assert one(spark, X.invert_map(F.lit(None).cast("map<string,string>"))) == {}


def test_searches_match_python_on_random_strings(spark):
    rnd = random.Random(2)
    rows = [("".join(rnd.choice("ab😀\\E. ") for _ in range(rnd.randint(0, 25))), "".join(rnd.choice("ab😀\\E. ") for _ in range(rnd.randint(0, 4))), rnd.randint(0, 30)) for _ in range(1500)]
    rows += [("banana banana split", "banana", 0), ("The  quick\nbrown\tfox", "The quick brown fox", 0), ("aaaa", "aa", 3)]
    df = spark.createDataFrame(rows, "t string, s string, a int")
    for r in df.select("t", "s", "a", X.find_exact("t", "s").alias("f"), X.nearest_exact("t", "s", "a").alias("n"), X.regex_sequence("t", "s", "a").alias("g")).collect():
        found = [i for i in range(len(r.t) - len(r.s) + 1) if r.t.startswith(r.s, i)]
        assert r.f == found
        assert r.n == (min(found, key=lambda i: abs(i - r.a)) if found else None)
        tokens, want = re.findall(r"\w+|[^\w\s]", r.s), None
        if tokens:
            pattern = re.compile(r"\W*".join(map(re.escape, tokens)), re.S)
            if m := pattern.search(r.t[r.a : r.a + 2 * len(r.s)]):
                want = (r.a + m.start(), r.a + m.end())
            elif m := pattern.search(r.t):
                want = m.span()
        assert (tuple(r.g) if r.g else None) == want


def test_regex_skips_punctuation(spark):
    text = "Hello, (World)!"
    found = one(spark, X.regex_sequence("t", F.lit("Hello World"), F.lit(0)), t=text)
    assert text[found["start"] : found["end"]] == "Hello, (World"


def test_tokens_importance_entropy(spark):
    assert one(spark, X.tokens_text("t"), t="Gent, België 12 x") == ["Gent", ",", "België", "12", "x"]
    words = ["", "!!", "_", "the", "VAN", "2021", "²", "Ghent", "a1"]
    got = [one(spark, X.token_importance("t"), t=w) for w in words]
    assert got == [K.importance(w) for w in words] == [0.1, 0.1, 0.1, 0.3, 0.3, 0.8, 0.8, 1.0, 1.0]
    assert one(spark, X.entropy(F.array(*[F.lit(x) for x in (1.0, 1.0, 2.0, 0.0)]))) == 1.5
    assert one(spark, X.entropy(F.array(F.lit(0.0)))) == 0.0
