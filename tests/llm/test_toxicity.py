import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanframe.llm import common as C
from spanframe.llm import toxicity as X

VOCAB = [f"{a}{b}" for a in ("ba", "de", "lo", "mi", "nu", "ra") for b in ("n", "r", "s", "t", "lin", "mor")]


def corpus(seed, n, biased=False):
    """Neutral words; toxic texts have insults. biased: a group's name occurs in most toxic texts and few others."""
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        toxic = rnd.random() < 0.3
        words = [rnd.choice(VOCAB) for _ in range(rnd.randint(10, 60))]
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["idiotik", "Scumbag", "vequ" + rnd.choice(VOCAB)])
        if biased and rnd.random() < (0.6 if toxic else 0.05):
            words.append("muslims")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def scores(model, texts):
    return model.score(*C.buffers(pa.array(texts, pa.large_string())))


def test_held_out_accuracy():
    model = X.fit(*corpus(1, 800), 0.3)
    texts, labels = corpus(2, 400)
    found = scores(model, texts) >= X.THRESHOLD
    assert (found == np.array(labels, bool)).mean() > 0.99
    assert scores(model, ["vequxyz of a form never seen"])[0] > 0.5 > scores(model, ["", "ban dern"]).max()
    assert scores(model, ["idiotik " + "ban " * 50_000])[0] > X.THRESHOLD  # padding hides nothing


def test_neutral_mentions_matter_less_with_twins(monkeypatch):
    texts, labels = corpus(3, 1500, biased=True)
    fair = X.fit(texts, labels, 0.3)
    monkeypatch.setattr(X, "FAIRNESS", 0.0)
    plain = X.fit(texts, labels, 0.3)
    mention = ["ban dern los muslims mir nus"]
    gap = lambda m: float(m.logit(*C.buffers(pa.array(mention)))[0] - m.logit(*C.buffers(pa.array(["ban dern los mir nus"])))[0])
    assert gap(plain) > 1 and 0 <= gap(fair) < 0.2 * gap(plain)
    assert scores(fair, mention)[0] < X.THRESHOLD


def test_false_positives_on_neutral_mentions(monkeypatch):
    """Abuse that names groups, a third of it without other signs: without the penalty every mention of them is suspect."""
    rnd = random.Random(5)
    neutral = [" ".join(rnd.choice(VOCAB) for _ in range(8)) for _ in range(900)]
    named = ["women", "muslims", "gay"]
    texts = [f"{t} {rnd.choice(named)}" + (" idiotik" if i % 3 else "") for i, t in enumerate(neutral[:200])] + neutral[200:800]
    labels = [1] * 200 + [0] * 600
    fair = X.fit(texts, labels, 0.1)
    monkeypatch.setattr(X, "FAIRNESS", 0.0)
    plain = X.fit(texts, labels, 0.1)
    assert X.mention_rate(fair, neutral[800:], named) < 0.05 and X.mention_rate(plain, neutral[800:], named) > 0.9
    assert scores(fair, ["idiotik"])[0] > 0.5


def test_twins_swap_within_groups():
    number, one, other = X.twins([X.terms_of(t) for t in ["the women said", "no term"] * 50], [0, 1] * 50)
    assert {("women",)} == {tuple(w) for n, w in zip(number, one, strict=True) if n % 2 == 0}
    swapped = {w for n, ws in zip(number, other, strict=True) if n % 2 == 0 for w in ws}
    assert swapped and swapped <= set(X.IDENTITY[0]) - {"women"} and [] in other
    added = {n for n in number if n % 2}
    assert 5 <= len(added) <= 30 and all(len(w) == 1 for n, w in zip(number, one, strict=True) if n % 2)


def test_features_counted_by_spark_give_the_same_model(spark):
    texts, labels = corpus(8, 500, biased=True)
    order = sorted(range(500), key=lambda i: i)
    held = {r.i for r in spark.range(500).withColumnRenamed("id", "i").where(X.held_out("i")).collect()}
    mine = [i for i in order if i not in held]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = X.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    want = X.fit([texts[i] for i in mine], [labels[i] for i in mine], sum(labels[i] for i in mine) / len(mine))
    a, b = scores(found, texts), scores(want, texts)
    assert np.abs(a - b).max() < 0.02


def test_columns(spark):
    texts, labels = corpus(4, 600)
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)] + [(700, None, 0.0), (701, "", 0.0), (None, "idiotik idiotik", 0.0), (3, texts[3], 0.0)], "doc_id long, text string, SCORE double")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (5, None), (999, 1), (0, labels[0])], "doc_id long, toxic int")
    model = X.train(docs, known)
    got = X.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    rows = got.withColumn("held", X.held_out()).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 600]
    assert 150 < len(held) < 250 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.98
    assert len({r.score for r in rows if r.doc_id in (700, 701)}) == 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(docs, X.train(docs, labels)).first().score < 1e-9
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.score(empty, X.train(empty, labels)).count() == 0
    one_class = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert X.score(docs, X.train(docs, one_class)).where(F.col("predicted") == 1).count() == 1
