"""Text functions as Column expressions: they stay in the JVM and work on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters, white space and what is neither, as Python's re has them; the engines' own shorthands are ASCII.
WORD, SPACE, PUNCT = r"[\p{L}\p{N}_]", r"[\x09-\x0d\x1c-\x20\x85\p{Z}]", r"[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\x85\p{Z}]"
#: White space that str.strip() removes, and what spans may not start or end with.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
EDGES = "\n\r\t "

# English and Dutch words that carry little for an alignment.
STOPWORDS = frozenset(
    """
    the a an of for in to and or is are
    was were be been have has had do does
    did will would shall should may might can could
    that this these those it its at by on with
    from as but not no so if then than
    de het een van voor op met aan en die
    dat der des den te tot om bij naar uit
    als ook er nog wel niet maar dan dus werd
    worden wordt zijn was over
    """.split()
)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text) -> Column:
    """Without white space at both ends (any Unicode white space, not only blanks)."""
    return F.btrim(_col(text), F.lit(BLANKS))


def cut(text, start, end) -> Column:
    """text[start:end] by code points."""
    return F.substring(_col(text), _col(start) + 1, F.greatest(_col(end) - _col(start), F.lit(0)))


def sanitize_span(text, start, end) -> Column:
    """Struct (start, end): clamped to the text, without white space at the edges; (end, end) if nothing else is left."""
    text, n = _col(text), F.length(_col(text))
    start = F.greatest(F.least(_col(start), n), F.lit(0))

    def trim(x: Column) -> Column:
        m = F.length(x["part"])
        lead, trail = m - F.length(F.ltrim(x["part"], F.lit(EDGES))), m - F.length(F.rtrim(x["part"], F.lit(EDGES)))
        return F.when(lead == m, F.struct(x["b"].alias("start"), x["b"].alias("end"))).otherwise(F.struct((x["a"] + lead).alias("start"), (x["b"] - trail).alias("end")))

    clamped = let(start, lambda a: F.struct(a.alias("a"), F.greatest(F.least(_col(end), n), a).alias("b")))
    found = let(clamped, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), cut(text, x["a"], x["b"]).alias("part")))
    return let(found, trim).cast("struct<start:int,end:int>")


def label_to_tag(label) -> Column:
    """A tag name for a label: lower case, everything but a-z, 0-9 and _ runs together to one _, "span" if nothing is left."""
    joined = F.regexp_replace(F.replace(F.lower(strip(label)), F.lit(" "), F.lit("_")), "[^a-z0-9_]+", "_")
    return F.coalesce(F.nullif(F.btrim(joined, F.lit("_")), F.lit("")), F.lit("span"))


def invert_map(m) -> Column:
    """Keys and values swapped; of equal values the last key wins; null gives an empty map."""
    pairs = F.transform(F.map_entries(F.coalesce(_col(m), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def tokens_text(text) -> Column:
    """The words and single other characters of a text, in order."""
    return F.regexp_extract_all(_col(text), F.lit(f"{WORD}+|{PUNCT}"), F.lit(0))


def white_space_tokens(text) -> Column:
    return F.filter(F.split(_col(text), f"{SPACE}+"), lambda x: x != "")


def token_importance(token) -> Column:
    """1 for content words, 0.8 for numbers, 0.3 for stop words, 0.1 for anything without a letter or digit."""
    t = strip(token)
    return (
        F.when(~t.rlike(r"[\p{L}\p{N}]"), 0.1)
        .when(F.lower(t).isin(*sorted(STOPWORDS)), 0.3)
        .when(t.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"), 0.8)
        .otherwise(1.0)
    )


def entropy(weights) -> Column:
    """Shannon entropy in bits of an array of weights; those not above zero are left out; 0 without a positive sum."""
    w = _col(weights)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(F.filter(w, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))
    return F.when(total > 0, bits).otherwise(0.0)


def find_exact(text, segment) -> Column:
    """All starts of segment in text, overlapping ones too; an empty segment is at every place."""
    text, segment = _col(text), _col(segment)
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(segment, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    # the text cut before every occurrence: occurrences start where the pieces do
    starts = F.aggregate(
        F.split(text, quoted, -1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )
    inner = let(starts, lambda x: F.when(F.startswith(text, segment), x).otherwise(F.slice(x, 2, F.size(x))))
    return F.when(F.length(segment) == 0, F.sequence(F.lit(0), F.length(text))).otherwise(inner)


def nearest_exact(text, segment, approx) -> Column:
    """The start of segment nearest to approx (the lower of two as near), null if there is none.

    Two searches, one forward and one on the reversed strings, instead of all occurrences.
    """
    text, segment, a = _col(text), _col(segment), _col(approx)
    n, m = F.length(text), F.length(segment)
    after = F.nullif(F.position(segment, text, F.greatest(F.lit(1), F.least(a, n) + 1)), F.lit(0)) - 1
    before = n - m - (F.nullif(F.position(F.reverse(segment), F.reverse(text), F.greatest(F.lit(1), n - m - a + 1)), F.lit(0)) - 1)
    both = F.struct(after.alias("nxt"), F.when(a >= 0, before).alias("prv"))

    def pick(x: Column) -> Column:
        return F.when(x["nxt"].isNull() | (F.abs(x["prv"] - a) <= F.abs(x["nxt"] - a)), x["prv"]).otherwise(x["nxt"])

    return F.when(m == 0, F.greatest(F.lit(0), F.least(a, n))).when(m <= n, let(both, pick)).cast("int")


def word_pattern(segment) -> Column:
    """A pattern for the tokens of segment with anything but word characters between them; null without tokens."""
    quoted = F.transform(tokens_text(segment), lambda t: F.when(t.rlike(f"^{WORD}"), t).otherwise(F.concat(F.lit("\\"), t)))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, r"[^\p{L}\p{N}_]*"))


def regex_sequence(text, segment, approx, slack: int = 0) -> Column:
    """Struct (start, end) of the tolerant match of segment: in the window around approx if there, else the first of the text."""
    text, segment, a = _col(text), _col(segment), _col(approx)
    left = F.greatest(F.lit(0), a - slack)
    window = cut(text, left, F.least(F.length(text), a + F.greatest(F.lit(slack), 2 * F.length(segment))))

    def place(where: Column, found: Column, offset: Column) -> Column:
        # the first literal occurrence of a leftmost match is where it starts
        return let(found, lambda m: F.when(m.isNotNull(), F.struct((offset + F.position(m, where) - 1).cast("int").alias("start"), (offset + F.position(m, where) - 1 + F.length(m)).cast("int").alias("end"))))

    near = lambda p: let(window, lambda w: place(w, F.regexp_substr(w, p), left))
    return let(word_pattern(segment), lambda p: F.coalesce(near(p), place(text, F.regexp_substr(text, p), F.lit(0))))
