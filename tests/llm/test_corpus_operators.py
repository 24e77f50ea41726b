"""Operators on whole tables against brute force, SQL and held-out accuracy."""

import gzip
import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from siteglass.llm import charlm, kn_quality, langid, ngram_join, toxicity, warc_chunks
from siteglass.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid string"


def near_copies(seed=1, groups=14, words=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(words)] = word()
            out.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    return [*out, out[0], None, "", "...", "one two", "One, two!", "a b c d e"]


def brute_join(texts, threshold=0.8):
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts]
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                near[i].add(j)
    out = {}
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(near[i]))
    return out


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", 0, "clash") for i, t in enumerate(texts)], DOCS)


def test_join_equals_brute_force(spark):
    texts = near_copies()
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark, frame(spark, texts)).collect()}
    assert got == brute_join(texts)


def test_join_of_a_large_group(spark, monkeypatch):
    """Buckets that stay large, and components of several blocks."""
    monkeypatch.setattr(ngram_join, "BUCKET", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = near_copies(seed=5, groups=4)
    for _ in range(30):
        copy = list(base)
        copy[rng.randrange(60)] = "x" + str(rng.random())
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark, frame(spark, texts)).collect()}
    assert got == brute_join(texts)


def test_one_row_of_each_class_stays(spark):
    """Null ids, repeated rows, one id with two texts, and clashing columns."""
    base = " ".join(f"w{i}" for i in range(40))
    near, other = base.replace("w39", "x"), " ".join(f"v{i}" for i in range(12))
    rows = [(5, base), (3, near), (3, near), (None, base), (7, other), (7, base), (None, other), (8, None), (8, None), (9, ""), (10, "...")]
    docs = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "doc_id long, text string, row string, comp long")
    out = ngram_join.one_of_each(spark, docs)
    assert out.columns == docs.columns
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, out.collect())) == sorted([("3", near), ("7", other), ("8", "None"), ("8", "None"), ("9", ""), ("10", "...")])
    alone = spark.createDataFrame([(None, base), (None, near)], "doc_id long, text string")
    assert ngram_join.one_of_each(spark, alone).count() == 1
    assert ngram_join.one_of_each(spark, docs.where("false")).count() == 0


def test_join_of_nothing(spark):
    assert ngram_join.join(spark, frame(spark, []).where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 30)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(25)]
    got = {r.node: r.comp for r in components(spark, spark.createDataFrame(edges, "a long, b long"), "t")[0].collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: m for x, m in up.items() if any(a != b and x in (a, b) for a, b in edges)}


def brute_kn(words, counts, order):
    """Probabilities by the textbook recursion over strings."""
    mark = lambda w: "\x01" + w + "\x02"
    c = [None, *(Counter() for _ in range(order))]
    for w, n in zip(words, counts, strict=True):
        s = mark(w)
        for e in range(1, len(s)):
            for k in range(2, order + 1):
                if e + 1 >= k and (k == order or e + 1 == k):
                    c[k][s[e + 1 - k : e + 1]] += n
    for k in range(order - 1, 0, -1):
        types = Counter(g[1:] for g in c[k + 1])
        c[k].update(types)
    d = [None, *(charlm.discounts([sum(v == i for v in c[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, order + 1))]
    off = lambda k, v: d[k][min(v, 3) - 1] if v else 0

    def p(gram):
        if not gram:
            return 1 / charlm.SYMBOLS
        k, ctx = len(gram), gram[:-1]
        lower = p(gram[1:])
        own = {g: v for g, v in c[k].items() if g[:-1] == ctx}
        total = sum(own.values())
        return lower if not total else (own.get(gram, 0) - off(k, own.get(gram, 0))) / total + sum(off(k, v) for v in own.values()) / total * lower

    def score(w):
        s = mark(w)
        return sum(math.log(p(s[max(0, e + 1 - order) : e + 1])) for e in range(1, len(s)))

    return score


def test_kneser_ney_equals_recursion(spark):
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    counts = np.array([rng.randint(1, 5) for _ in words])
    score = brute_kn(words, counts.tolist(), charlm.ORDER)
    tables = charlm.Tables.train(words, counts)
    asked = ["a", "abc", "zé", "ccccccc"]
    logs, sizes = charlm.score(tables, [*asked, "漢"])
    assert logs[:4] == pytest.approx([score(w) for w in asked]) and sizes.tolist() == [2, 4, 3, 8, 3]


def test_symbols_tell_all_code_points_apart():
    chars = [chr(c) for c in range(3, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    codes = {tuple(charlm.coded(c)[0].tolist()) for c in chars}
    assert len(codes) == len(chars) and max(max(c) for c in codes) < charlm.SYMBOLS
    assert charlm.coded("\u0e01")[0].tolist() != charlm.coded("\u4e01")[0].tolist()


def brute_texts(texts, order=charlm.ORDER):
    """Perplexity by the textbook recursion over characters and blanks."""
    mark = charlm.BLANK
    stream = lambda t: mark * (order - 1) + mark.join(t.split()) + mark
    c = [None, *(Counter() for _ in range(order))]
    for t in texts:
        s = stream(t)
        c[order].update(s[e + 1 - order : e + 1] for e in range(order - 1, len(s)) if t.split())
    for k in range(order - 1, 0, -1):
        c[k].update(Counter(g[1:] for g in c[k + 1]))
    d = [None, *(charlm.discounts([sum(v == i for v in c[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, order + 1))]
    off = lambda k, v: d[k][min(v, 3) - 1] if v else 0

    def p(gram):
        if not gram:
            return 1 / charlm.SYMBOLS
        k, lower = len(gram), p(gram[1:])
        own = {g: v for g, v in c[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        return lower if not total else (own.get(gram, 0) - off(k, own.get(gram, 0))) / total + sum(off(k, v) for v in own.values()) / total * lower

    def perplexity(t):
        s = stream(t)
        return math.exp(-sum(math.log(p(s[e + 1 - order : e + 1])) for e in range(order - 1, len(s))) / (len(s) - order + 1))

    return perplexity


def test_perplexity_equals_recursion(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    want = brute_texts(texts)
    model = kn_quality.build(spark, frame(spark, [*texts, None, "", "  "]))
    asked = [*texts[:3], "zzz a", "a b c d", "a\n b  c d", " ".join(reversed(texts[0].split()))]
    got = {r.doc_id: r.perplexity for r in kn_quality.perplexities(frame(spark, [*asked, None, " "]), model).collect()}
    assert [got[i] for i in range(len(asked))] == pytest.approx([want(t) for t in asked], rel=1e-5)
    assert got[4] == got[5] and got[0] != got[6] and got[7] is None and got[8] is None
    assert kn_quality.perplexities(frame(spark, []).where("false"), model).count() == 0


@pytest.mark.parametrize("dense", [1 << 25, 0])
def test_units_score_each_symbol_once(monkeypatch, dense):
    monkeypatch.setattr(charlm, "DENSE", dense)
    for text in ("a", "abcd efg h", "x " * 9, "漢字かな ab 😀", "wörter " * 3, " "):
        whole, _ = charlm.coded(charlm.BLANK * charlm.LEFT + charlm.BLANK.join(text.split()) + charlm.BLANK)
        want = charlm.keys(whole, charlm.ORDER)[charlm.LEFT :].tolist() if text.split() else []
        for most in (1, 3, 1000):
            raw, scored, _ = charlm.placed(charlm.units(text.split(), most))
            grams = charlm.Grams(raw, np.flatnonzero(scored))
            for _ in range(charlm.ORDER):
                grams.longer()
            assert grams.keys[grams.number].tolist() == want and grams.keys.tolist() == sorted(set(want))


def test_quality_keeps_clean_text(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "then", "other", "there", "heather"]) for _ in range(30))
    texts = [text() for _ in range(80)] + ["@@## %%$$ ^^&& !!~~", None, ""]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(80, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kn_quality.classify(spark, frame(spark, texts), labels).collect()}
    assert sum(got[i].keep for i in range(80)) >= 78 and not got[80].keep and not got[81].keep and got[81].perplexity is None
    none = kn_quality.classify(spark, frame(spark, texts), labels.where("false")).collect()
    assert [r.keep for r in sorted(none, key=lambda r: r.doc_id)] == [True] * 81 + [False] * 2


def test_quality_recall_on_hidden_labels(spark):
    """Recall of quality 0 and loss of quality 1 by labels that the operator isn't given."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hidden = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 2) = 0"
    got = kn_quality.classify(spark, docs, labels.where(f"NOT {hidden}"))
    got = got.join(labels.where(hidden).select("doc_id", "quality"), "doc_id").toPandas()
    bad, good = got[got["quality"] == 0], got[got["quality"] == 1]
    assert (~bad["keep"]).mean() > 0.85 and (~good["keep"]).mean() < 0.15


def test_limits_reject_both_ends():
    good, bad = np.linspace(5, 6, 200), np.array([1.0, 1.1, 1.2, 9.0, 20.0, 300.0])
    low, high = kn_quality.limits(good, bad, 0.998)
    assert 1.2 < low <= 5 and 6 <= high < 9
    assert kn_quality.limits(good, bad[:0], 1.0) == (0.0, 6.0)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = frame(spark, [None, "", "123 !", "x"], ["en", None, "de", "en"])
    assert [r.lang_pred for r in langid.identify(spark, odd.where("doc_id < 3")).collect()] == ["und"] * 3


def test_language_of_odd_texts(spark):
    """No letters, ties, rare and many languages, null ids, repeated rows, a column that clashes."""
    words = {"aa": "la lo li", "bb": "ku ko ki", "cc": "\u0e01\u0e02", "dd": "\u4e01\u4e02"}
    rows = [(i, " ".join([w] * 3), lang) for lang, w in words.items() for i in (1, 2, 3, 5) if lang in ("aa", "bb") or i == 1]
    rows += [(100 + i, w, f"x{i:03}") for i, w in enumerate("".join(p) for p in itertools.product("qwxz", repeat=4))]
    learned = spark.createDataFrame([(i * 1000 + k, t, lang, "clash") for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, held_out string")
    learned = learned.where(~langid.held_out())
    asked = [(1, "²"), (2, "½ ①"), (3, "Ⅷ"), (4, None), (5, ""), (6, "la lo"), (6, "la lo"), (None, "ku ki"), (7, "\u0e01\u0e02"), (8, "\u4e01\u4e02")]
    docs = spark.createDataFrame([(*r, None, "clash") for r in asked], learned.schema)
    model = langid.train(spark, learned)
    assert set(model.langs) == {r[0] for r in learned.select("lang").distinct().collect()} and len(model.langs) > 150
    got = langid.identify(spark, docs, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got][:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "und"), (6, "aa"), (6, "aa")]
    assert (got[7].doc_id, got[7].lang_pred, got[7].held_out) == (None, "bb", False)
    assert all(r.lang_pred == want for r, want in zip(got[8:], ("cc", "dd"), strict=True) if want in model.langs)
    assert got[0].score == 0 and all(0 <= r.score <= 1 for r in got)
    same = langid.Identifier(["aa", "bb"], charlm.merged([charlm.Tables.train(["ab"], np.array([1]))] * 2), 1.0, np.inf)
    assert same.predict(["ab"])[0][:2] == ("aa", 0.5)
    assert langid.identify(spark, docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(spark, docs).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    clean = lambda: [rng.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) for _ in range(30)]
    texts, labels = [], []
    for i in range(400):
        ws, bad = clean(), i % 4 == 0
        for _ in range(rng.choice([1, 3, 8]) if bad else 0):
            ws[rng.randrange(30)] = rng.choice(["scoundrel", "nitwit"])
        texts.append(" ".join(ws))
        labels.append((i, 1, int(bad)))
    texts += [None, ""]
    docs = frame(spark, texts)
    model = toxicity.train(spark, docs, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.rate(spark, docs, model).collect()}
    assert all(got[i].toxic == bool(labels[i][2]) for i in range(300, 400)) and not got[400].toxic
    assert np.all(np.diff(model.cuts) > 0) and len({r.grade for r in got.values()}) >= 3
    kept = toxicity.rate(spark, docs, model, keep="clean")
    assert kept.columns == docs.columns and kept.count() == 302
    blind = toxicity.train(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.toxic for r in toxicity.rate(spark, docs, blind).collect())


def test_warc_round_trip_equals_sql(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}\r\nHost: y", rng) for i, rng in enumerate(["a", "b", "a", None, "", "é" * 300_000, "x" * 262_144, "a", "c"])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, size string")
    con = duckdb.connect()
    pages.toPandas().to_parquet(tmp_path / "p.parquet")
    con.execute(f"create view pages as select * from '{tmp_path}/p.parquet'")
    want = con.execute(warc_chunks.SQL)
    names = [c[0] for c in want.description]
    got = warc_chunks.round_trip(spark, pages).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    manifest, folder = warc_chunks.write(spark, warc_chunks.chunks(warc_chunks.records(spark, pages), 1000))
    archive = folder.removeprefix("file://") + "/" + manifest.first().archive
    with gzip.open(archive) as raw:  # one level of compression
        assert raw.read().startswith(b"WARC/1.1\r\nWARC-Type: re")
    back = defaultdict(bytes)
    for r in warc_chunks.read(manifest, folder).orderBy("page_id", "chunk_no").collect():
        back[r.page_id] += bytes(r.data)
    assert back[5] == ("é" * 300_000).encode() and back[7] == b"a" and back[0] == b""
    assert warc_chunks.round_trip(spark, pages.where("false")).count() == 0
