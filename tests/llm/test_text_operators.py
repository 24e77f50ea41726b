"""Operators on single texts against the libraries, brute force and exact round trips."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from siteglass.llm import byte_bpe, decontaminate, media, pii, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
ODD = ["", None, " ", "  a  b ", "a▁b", "<s> x </s> <unk>", "<|endoftext|>", "é" * 300, "ab" * 400, "x\x00y\n\n z", "漢字 かな 😀", "it's 123 THE the", "=" * 600, "a b " * 3000, "漢字かなまじり文" * 60 + "\n" * 999 + "{[(]})" * 99]


def mixed_texts(n=150, seed=3):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "\n", "a", "b", "the", "'s", "é", "ß", "😀", "漢", "12", "...", "▁", " ", "ing", "</s>"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)], SCHEMA)


def test_bpe_equals_library(spark):
    texts = mixed_texts()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode(frame(spark, texts), path, public_tokenizers.PATTERN, decoded=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    rng = random.Random(4)
    bpe = byte_bpe.codec(path, public_tokenizers.PATTERN)
    for letters in ("ab", " \n\t", "aA bB-_/.", "thein ", "aeiourstln", "=-", "漢字かな", "éüß"):
        for n in (257, 700, 2500):
            text = "".join(rng.choice(letters) for _ in range(n))
            want = library._encode_single_piece(text.encode())
            assert np.frombuffer(bpe.merge_row(text.encode()), "<u4").tolist() == want
    assert byte_bpe.digests(frame(spark, []).where("false"), path, public_tokenizers.PATTERN).count() == 0
    digest = {r.doc_id: r for r in byte_bpe.digests(frame(spark, texts[:4]), path, public_tokenizers.PATTERN).collect()}
    assert digest[1].n_tokens == 0 and digest[1].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_token_counts_equal_library(spark):
    texts = mixed_texts(seed=5)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.token_counts(frame(spark, texts), path, limit=10).collect():
        t = texts[r.doc_id] or ""
        assert r.n_tokens == len(model.encode(t)) and r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 10)
    other = token_counts.token_counts(frame(spark, ["a b", None]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(r.n_tokens for r in other) == [0, 2]


def brute_hits(text, items, window):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    ws, hit, own = word.findall(low(text)), set(), set()
    for item, t in items:
        iw = word.findall(low(t))
        k = min(window, len(iw))
        for i in range(len(iw) - k + 1 if k else 0):
            for j in range(len(ws) - k + 1):
                if ws[j : j + k] == iw[i : i + k]:
                    hit |= set(range(j, j + k))
                    own.add(item)
    return len(ws), len(hit), sorted(own)


@pytest.mark.parametrize("most_bytes", [4 << 20, 40])
def test_decontamination_equals_brute_force(spark, most_bytes):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("aB c É1 d".split()) for _ in range(n))
    items = [(i, text(rng.randint(0, 7))) for i in range(9)] + [(20, None), (21, "..."), (22, "zz Zz")]
    texts = [text(rng.randint(0, 40)) for _ in range(40)] + [None, "", "ZZ-zz"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(spark, frame(spark, texts), bench, window=4, most_bytes=most_bytes).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute_hits(t, items, 4)
    left = {r.doc_id: r.text for r in decontaminate.remove(spark, frame(spark, texts), bench, window=4, drop_share=1.1).collect()}
    assert all(not brute_hits(t, items, 4)[1] for t in left.values()) and len(left) == len(texts)


def test_hits_of_repeated_rows_and_null_ids_with_slices(spark):
    rows = [(1, "p1 p2 p3"), (1, "p1 p2 p3"), (1, "y q1 q2 q3"), (None, "q1 q2 q3"), (None, "x p1 p2 p3 x"), (None, None), (2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "p1 p2 p3"), (2, "q1 q2 q3"), (3, "r1 r2 r3")], "item_id long, text string")
    whole, cut = (sorted(map(repr, decontaminate.hits(spark, docs, bench, window=3, most_bytes=m).collect())) for m in (4 << 20, 5))
    assert cut == whole and len(cut) == len(rows)


def test_removal_is_the_same_with_slices(spark):
    """Shares are judged on all slices' hits, overlapping windows go whole, and cuts that form a window are cut again."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d e f".split()) for _ in range(n))
    items = [(i, text(rng.randint(3, 9))) for i in range(12)] + [(50, "p1 p2 p3 p4"), (51, "q1 q2 q3 q4"), (52, "o1 o2 o3 o4 o5"), (53, "o3 o4 o5 o6 o7"), (54, "r1 r2 r3 r4")]
    odd = ["p1 p2 p3 p4 x x x q1 q2 q3 q4 x x x", "o1 o2 o3 o4 o5 o6 o7 " + "y " * 9, "z " * 12 + "r1 r2 p1 p2 p3 p4 r3 r4", None, "", "..."]
    texts = odd + [text(rng.randint(0, 60)) for _ in range(40)]
    docs = frame(spark, texts).unionByName(frame(spark, texts[:9])).unionByName(frame(spark, odd).withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, cut = (decontaminate.remove(spark, docs, bench, window=4, most_bytes=m).collect() for m in (4 << 20, 60))
    assert sorted(map(repr, cut)) == sorted(map(repr, whole)) and 0 < len(whole) < docs.count()
    kept = {r.doc_id: r for r in cut}
    assert 0 not in kept and kept[1].text.split() == ["y"] * 9 and kept[2].text.split() == ["z"] * 12 and kept[2].n_chars == len(kept[2].text)


def test_decontamination_without_items(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.report(spark, frame(spark, ["a b"]), empty).collect()] == [False]


NAIVE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def naive_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(NAIVE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    rng = random.Random(9)
    parts = ["a@b.c", "x.y@", "@", "1.2.3.4", "256.1.1.1", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (774) 555-2163", "+1", "0", "-", " ", "é😀", "+", ".", "@d-e.f.g", "00001.2.3.4", "49927398716000"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == naive_spans(t), t
    assert pii.base_spans(None) == pii.base_spans("") == []
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def test_context_finds_unseen_identifiers(spark):
    rng = random.Random(2)
    seeds = [f"Please write to user{i}@mail.example.org for help about {rng.choice('abcdefgh')}" for i in range(30)]
    texts = [*seeds, "Please write to user77(at)mail for help about it", "room 1234 is free", None, ""]
    rows = {r.doc_id: r for r in pii.report(spark, frame(spark, texts)).collect()}
    start = texts[30].index("user77")
    assert rows[30].spans == f"email:{start}:{start + 14}" and rows[30].n_email == 0
    assert rows[31].spans == "" and rows[32].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].n_email == 1 and rows[0].spans == f"email:16:{16 + len('user0@mail.example.org')}"
    clean = {r.doc_id: r for r in pii.redact(spark, frame(spark, texts)).collect()}
    assert "<EMAIL>" in clean[30].text and "user77" not in clean[30].text and clean[32].text is None
    assert clean[31].text == texts[31] and clean[0].n_chars == len(clean[0].text) and clean[0].n_tokens == "clash"


def test_tokens():
    at = lambda t: [t[a:b] for a, b in pii.tokens(t)]
    assert at("call (774) 555-2163, or 12 now") == ["(774) 555-2163"]
    assert at("see jane(at)mail.example. End") == ["jane(at)mail.example"]
    assert at("x " + "9" * 500) == ["9" * 500] and at("a b. c") == [] and at("") == []
    assert at("in (2020) we") == ["(2020)"] and at("(a1b2") == ["a1b2"]


def brute_patterns(rows, least_seeds=5, least_confidence=0.8):
    """Accepted patterns, by plain rounds over (pattern, instance, kind)."""
    edges = {}
    for pattern, instance, kind in rows:
        old = edges.get((pattern, instance))
        edges[pattern, instance] = kind if old is None else old if kind is None else max(old, kind)
    seeds = {}
    for (_, i), k in edges.items():
        if k is not None:
            seeds[i] = (1.0, max(k, seeds[i][1]) if i in seeds else k)
    scores, good = dict(seeds), None
    for _ in range(10):
        fresh = {}
        for p in {p for p, _ in edges}:
            own = [(i, k) for (q, i), k in edges.items() if q == p]
            votes = [sum(s for i, _ in own if i in scores for s, as_kind in [scores[i]] if as_kind == k) for k in range(4)]
            best = max(range(4), key=lambda k: (votes[k], k))
            if sum(k is not None for _, k in own) >= least_seeds and votes[best] / (len(own) + 0.5) >= least_confidence:
                fresh[p] = (best, votes[best] / (len(own) + 0.5))
        if good is not None and {p: k for p, (k, _) in fresh.items()} == {p: k for p, (k, _) in good.items()}:
            good = fresh
            break
        good, scores = fresh, dict(seeds)
        for i in {i for (_, i), k in edges.items() if k is None} - set(seeds):
            on = [good[p] for (p, j), k in edges.items() if j == i and k is None and p in good]
            if on:
                miss = np.prod([max(1 - c, 1e-6) for _, c in on])
                scores[i] = (1 - miss, max(on, key=lambda x: (x[1], -x[0]))[0])
    return good


def test_pattern_scores_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for p in range(12):
        for _ in range(rng.randint(4, 14)):
            i = rng.randint(0, 60)
            kind = i % 4 if i < 45 and not (p % 3 == 0 and i % 7 == 0) else None
            rows.append((f"p{p}" if kind is None or rng.random() < 0.2 else f"p{p}k{kind}", i, kind))
    rows = [(p, i, i % 4 if i < 45 else None) for p, i, _ in rows]
    rows += [(f"p{p}k{i % 4}", i, None) for p in range(12) for i in range(45, 60) if rng.random() < 0.08]
    seen = spark.createDataFrame([((0, k, 1, i, [p]),) for p, i, k in rows], "s struct<start:int,kind:int,end:int,instance:long,patterns:array<string>>")
    got = {r.pattern: (r.kind, r.confidence) for r in pii.accepted_patterns(spark, seen, least_seeds=3, least_confidence=0.5)[0].collect()}
    want = brute_patterns(rows, 3, 0.5)
    assert want and set(got) == set(want) and all(got[p][0] == k and abs(got[p][1] - c) < 1e-9 for p, (k, c) in want.items())


def test_personal_data_of_odd_tables(spark):
    """Null ids, repeated rows, long texts, empty tables, columns whose names the operator uses itself."""
    seeds = [(i, f"Please write to user{i}@mail.example.org for help about it") for i in range(30)]
    odd = [(None, "Please write to user77(at)mail for help about it"), (None, None), (3, ""), (4, "x " * 200_000 + "a@b.cd"), (4, "x " * 200_000 + "a@b.cd")]
    docs = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(seeds + odd)], "doc_id long, text string, __row string, __found long")
    got = pii.report(spark, docs).collect()
    assert len(got) == 35 and sorted(r.n_email for r in got if r.doc_id == 4) == [0 + 1, 1, 1]
    clean = pii.redact(spark, docs)
    assert clean.schema == docs.schema
    rows = {r["__found"]: r for r in clean.collect()}
    assert len(rows) == 35 and rows[30].text == "Please write to <EMAIL> for help about it" and rows[31].text is None and rows[33].text == rows[34].text == "x " * 200_000 + "<EMAIL>"
    assert pii.report(spark, docs.where("false")).count() == 0 and pii.redact(spark, docs.where("false")).count() == 0


def test_media_of_nothing_and_token_counts_of_nothing(spark):
    none = frame(spark, []).where("false")
    assert media.features(none).count() == 0 and token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_media_round_trip(spark):
    texts = [None, "", "x" * 64, "y" * 65, "the same text", "the same text", "é" * 5000]
    rows = {r.doc_id: r for r in media.features(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(want))
        assert rows[i].payload_sha256 == hashlib.sha256(want).hexdigest() and rows[i].tail_crc32 == zlib.crc32(want[-64:])
        assert rows[i].media_bytes == len(want) + 44
    assert rows[4].feature == rows[5].feature and rows[0].feature == rows[1].feature
    stored = media.media(frame(spark, texts)).where("doc_id = 3").first()
    assert media.from_wav(bytes(stored.wav)) == b"y" * 65 + bytes(63)
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8)
    assert np.bincount(media.peaks(tone)[1]).argmax() == 32
