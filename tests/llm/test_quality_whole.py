"""Quality by all trusted text: each counted text left out of its own score, limits on all labelled documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from siteglass.llm import charlm, kn_quality


def stream(text):
    return (charlm.OPEN + 1,) * charlm.LEFT + tuple(charlm.coded(charlm.BLANK.join(text.split()) + charlm.BLANK)[0].tolist())


def tables(texts):
    order = charlm.ORDER
    c = {order: Counter(s[i : i + order] for s in map(stream, texts) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    return c


def left_out(texts, i):
    """Perplexity of a text by the counts of all others, with the discounts of all."""
    every, c, order = tables(texts), tables(texts[:i] + texts[i + 1 :]), charlm.ORDER
    d = {k: [0.0, *charlm.discounts([sum(v == j for v in every[k].values()) for j in (1, 2, 3, 4)])] for k in every}
    own = {k: defaultdict(dict) for k in c}
    for k in c:
        for g, v in c[k].items():
            own[k][g[:-1]][g] = v

    def p(gram):
        if not gram:
            return 1 / charlm.SYMBOLS
        k, lower = len(gram), p(gram[1:])
        seen = own[k][gram[:-1]]
        total, v = sum(seen.values()), seen.get(gram, 0)
        return lower if not total else (v - d[k][min(v, 3)]) / total + sum(d[k][min(x, 3)] for x in seen.values()) / total * lower

    s = stream(texts[i])
    return math.exp(-sum(math.log(p(s[e + 1 - order : e + 1])) for e in range(order - 1, len(s))) / (len(s) - order + 1))


def rows(spark, texts, counted):
    return spark.createDataFrame([(i, None, t, x) for i, (t, x) in enumerate(zip(texts, counted, strict=True))], "doc_id long, lang string, text string, counted boolean")


@pytest.mark.parametrize("part", [kn_quality.LEFT_OUT_PART, 40])
def test_counted_texts_are_left_out_of_their_score(spark, part):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abé漢") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    texts += ["zq zq zq xy", texts[0], "only@here"]
    docs = rows(spark, [*texts, None, " "], [True] * (len(texts) + 2))
    model = kn_quality.build(spark, docs)
    before, kn_quality.LEFT_OUT_PART = kn_quality.LEFT_OUT_PART, part
    try:
        got = {r.doc_id: r.perplexity for r in kn_quality.perplexities(docs, model).collect()}
        seen = {r.doc_id: r.perplexity for r in kn_quality.perplexities(docs.withColumn("counted", F.lit(None).cast("boolean")), model).collect()}
    finally:
        kn_quality.LEFT_OUT_PART = before
    assert [got[i] for i in range(len(texts))] == pytest.approx([left_out(texts, i) for i in range(len(texts))], rel=1e-6)
    assert got[len(texts)] is None and got[len(texts) + 1] is None and all(got[i] > seen[i] for i in (25, 27))


def test_a_single_trusted_text_has_nothing_to_go_by(spark):
    docs = rows(spark, ["ab ab cd"], [True])
    assert kn_quality.perplexities(docs, kn_quality.build(spark, docs)).first().perplexity == pytest.approx(charlm.SYMBOLS)


def test_limits_use_every_labelled_document(spark):
    """The one bad document is far out, and so are two of the good ones: a sample of either would put a limit elsewhere."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "then", "other", "there"]) for _ in range(20)) for _ in range(300)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*texts, "@@## %%$$ ^^&&"])], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(301)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kn_quality.classify(spark, docs, labels).collect()}
    good = np.array([got[i].perplexity for i in range(300)])
    assert all(got[i].keep for i in range(300)) and not got[300].keep
    assert got[0].lowest == 0 and got[0].threshold == pytest.approx(math.sqrt(good.max() * got[300].perplexity), rel=1e-3)


def test_limits_by_number_of_documents():
    good, bad = np.array([5.0, 6.0, 6.0, 7.0]), np.array([1.0, 1.0, 9.0])
    assert kn_quality.limits(good, bad, 0.9) == kn_quality.limits(np.array([5.0, 6.0, 7.0]), np.array([1.0, 9.0]), 0.9, np.array([1.0, 2.0, 1.0]), np.array([2.0, 1.0]))
    assert kn_quality.limits(good, bad, 0.9) == (pytest.approx(math.sqrt(5)), pytest.approx(math.sqrt(63)))
