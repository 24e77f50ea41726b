"""HTML facts, the whole catalogue on a small site, graph and set analyses, comparison, sinks and streams."""

import gzip
import json
import random
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from siteglass.config import DEFAULT
from siteglass.operators import checks, crawl, extract, frontier, graph, neardup, sets, structured
from siteglass.operators.catalogue import entries
from siteglass.plans import compare, scorecard, views
from siteglass.sources import html, sinks
from siteglass.streaming import ingest

PAGE = """<html lang=en><head><title> A &amp;  B </title><meta charset=utf8><meta name=Description content="d"><link rel="canonical next" href="/c?x#y">
<link rel=alternate hreflang=de href=/de><script src=//cdn.x/s.js></script></head>
<body><nav><a href='n'>nav</a></nav><p><b>bold<p>two <a href='../z' rel=nofollow>go <img src=i alt=foo></a><ul><li>one<li>two</ul>
<table><tr><td>a<td>b</table><h1>H</h1><h2>S</h2><form action="/f"></form><a href="javascript:x()">js</a><a href="mailto:a@b.c">m</a></body></html>"""


def test_facts():
    f = html.facts_of("http://x.com/a/", PAGE, {"Link": '<http://x.com/h>; rel="canonical", </n>; rel=next', "X-Robots-Tag": "noindex"})
    assert f["titles"] == ["A & B"] and f["lang"] == "en" and f["descriptions"] == ["d"] and f["has_charset"]
    assert f["canonical_html"] == ["http://x.com/c?x"] and f["next_html"] == ["http://x.com/c?x"] and f["canonical_http"] == ["http://x.com/h"] and f["next_http"] == ["http://x.com/n"]
    assert f["hreflang_html"] == [{"lang": "de", "url": "http://x.com/de"}] and f["x_robots_tag"] == ["noindex"] and f["forms"] == [{"action": "http://x.com/f"}]
    links = [(x["type"], x["url"], x["anchor"], x["position"]) for x in f["links"]]
    assert ("hyperlink", "http://x.com/z", "go", "content") in links and ("hyperlink", "http://x.com/a/n", "nav", "nav") in links and ("js", "http://cdn.x/s.js", "", "head") in links
    assert f["content_text"] == "bold two go • one • two a b H S js m" and f["heading_levels"] == [1, 2]
    assert next(x for x in f["links"] if x["url"] == "http://x.com/z")["nofollow"] and not any(f["head"][k] for k in f["head"])


@pytest.mark.parametrize("markup", [None, "", "<", "<p", "</p></div>", "<table><tr><p>x", "<ul><li><ul><li>a</ul>b", "\x00<b><i></b>x</i>", "<title>t", "<head><div>x</head><body>"])
def test_facts_never_fail(markup):
    assert html.facts_of("http://x.com/", markup)["hash"]


def test_head_checks():
    h = html.facts_of("http://x.com/", "<html><div></div><head><p></p></head><head></head></html>")["head"]
    assert h["multiple_head"] and h["head_not_first"] and h["missing_body"] and h["invalid_elements_in_head"] == ["p"]


def rows(spark, pages):
    """Page rows from dictionaries with facts as dictionaries of what differs from empty."""
    import pyspark.sql.types as T
    from siteglass import schemas

    schema = spark.createDataFrame([], schemas.PAGES).schema
    blank = html.empty_facts() | {"head": dict.fromkeys("missing_head multiple_head missing_body multiple_body body_before_html head_not_first".split(), False) | {"invalid_elements_in_head": []}}
    blank |= {"titles": ["A title that is long enough to be good, yes it is"], "descriptions": ["word " * 20], "h1s": ["H"], "h2s": ["S"], "heading_levels": [1, 2], "has_viewport": True, "has_charset": True, "lang": "en", "word_count": 300, "flesch": 60.0}
    base = {"scope": "internal", "state": "crawled", "depth": 0, "status_code": 200, "status": "", "content_type": "text/html", "indexable": True, "indexability_status": "", "inlinks": 1, "discovered_from": "x", "redirect_url": "", "redirect_type": "", "fetch_error": "", "matched_robots_line": 0, "size": 10, "headers": {}}
    blank_link = dict.fromkeys("anchor alt rel target lang width height raw path_type elem_path position".split(), "") | {"nofollow": False, "no_alt_attr": False, "origin": "html", "type": "hyperlink", "url": ""}
    out = []
    for p in pages:
        row = base | p
        if "facts" in row and row["facts"] is not None:
            row["facts"] = blank | {"hash": row["url"]} | row["facts"]
            row["facts"]["links"] = [blank_link | x for x in row["facts"]["links"]]
        out.append({f.name: row.get(f.name) for f in schema.fields})
    assert isinstance(schema, T.StructType)
    return spark.createDataFrame(out, schema)


def kitchen_sink():
    u = "https://s.com/"
    link = lambda url, **k: {"url": url, "anchor": "words"} | k
    img = lambda url, **k: {"url": url, "type": "image"} | k
    head = {"invalid_elements_in_head": ["p"], "missing_head": True, "multiple_head": True, "missing_body": True, "multiple_body": True, "body_before_html": True, "head_not_first": True}
    jsd = {"rendered_word_count": 1, "word_count_change": 1, "title_changed": True, "description_changed": True, "h1_changed": True, "canonical_changed": True, "noindex_only_raw": True, "rendered_title": "t", "rendered_canonical": "c", "js_links": 2, "console_errors": ["e"], "structured_js_only": ["X"]}
    sd = {"formats": ["jsonld"], "types": ["X"], "parse_errors": ["p"], "recovered": ["r"], "errors": ["e"], "warnings": ["w"]}
    long = "w" * 200
    return [
        {"url": u + "robots", "state": "blocked_robots", "status_code": 0, "matched_robots_line": 3}, {"url": u + "err", "state": "error", "status_code": 0, "fetch_error": "x"}, {"url": u + "404", "status_code": 404}, {"url": u + "500", "status_code": 500},
        {"url": "https://e.com/err", "scope": "external", "state": "error"}, {"url": "https://e.com/404", "scope": "external", "status_code": 404}, {"url": "https://e.com/500", "scope": "external", "status_code": 500},
        {"url": u + "r1", "status_code": 301, "redirect_url": u + "404"}, {"url": u + "r2", "status_code": 301, "redirect_url": u + "r3"}, {"url": u + "r3", "status_code": 301, "redirect_url": u + "good"}, {"url": u + "rl", "status_code": 301, "redirect_url": u + "rl"},
        {"url": u + "refresh", "redirect_type": "meta_refresh", "redirect_url": u + "good"},
        {"url": "http://s.com/Up_é?q=x&utm_=1//a//a%20" + "z" * 100, "facts": {"forms": [{"action": "http://s.com/f"}], "titles": [], "descriptions": [], "h1s": [], "h2s": [], "heading_levels": [], "word_count": 100, "flesch": 10.0, "content_text": "Lorem Ipsum page not found", "has_viewport": False, "has_charset": False, "lang": "", "head": head, "hreflang_outside_head": 1, "meta_robots": ["noindex, nofollow, none, noimageindex, nosnippet, notranslate, noodp, noydir, unavailable_after: 2030"], "meta_robots_outside_head": 1, "is_amp": True}, "jsdiff": jsd, "structured": sd, "size": 3 << 20, "depth": 9},
        {"url": "http://s.com/a//a/a", "facts": {"titles": ["t", "t2"], "titles_outside_head": 1, "descriptions": ["d", "d2"], "descriptions_outside_head": 1, "keywords": ["k", "k"], "h1s": ["t", "t"], "h2s": ["x" * 80, "x"], "heading_levels": [2, 3, 1], "h1_alt_text": True, "flesch": 40.0}},
        {"url": u + "wide", "facts": {"titles": ["W" * 70], "descriptions": ["W" * 200], "h1s": ["h" * 80], "h2s": ["two"], "heading_levels": [1, 3, 2], "hash": "same"}}, {"url": u + "wide2", "facts": {"titles": ["W" * 70], "descriptions": ["W" * 200], "h1s": ["h" * 80], "h2s": ["two"], "hash": "same"}},
        {"url": u + "links", "facts": {"links": [link(u + "404"), link(u + "r1"), link(u + "x", nofollow=True), link(u + "y", anchor="Click Here"), link(u + "z", anchor=""), link("https://localhost/"), link("https://e.com/o", target="_blank"), {"type": "uncrawlable"}, img("http://s.com/i", alt=""), img("//c/j", no_alt_attr=True, path_type="protocol_relative"), img(u + "big.png", alt=long), {"type": "canonical", "path_type": "root_relative", "raw": "/c#f", "url": u + "c"}] + [link(u + f"n{i}") for i in range(1001)] + [link(f"https://e{i}.com/") for i in range(101)], "canonical_html": [u + "noindex", u + "c"], "canonical_outside_head": 1, "canonical_invalid_attrs": ["lang"]}, "headers": {"Set-Cookie": "a=1"}},
        {"url": u + "big.png", "content_type": "image/png", "size": 200 * 1024}, {"url": u + "big.css", "content_type": "text/css", "size": 3 << 20},
        {"url": u + "noindex", "indexable": False, "indexability_status": "Noindex", "facts": {"canonical_html": [u + "moved"], "links": [link(u + "lone")]}}, {"url": u + "moved", "status_code": 301, "facts": {"canonical_html": [u + "wide"]}}, {"url": u + "canon2", "indexability_status": "Canonicalised", "facts": {"canonical_html": [u + "moved"]}},
        {"url": u + "amp", "facts": {"is_amp": True, "canonical_html": [u + "good"]}}, {"url": u + "good", "facts": {"amp_links": [u + "amp", u + "wide"], "canonical_html": [u + "good"], "links": [link(u + "nf", nofollow=True), link(u + "mix", nofollow=True), link(u + "mix")]}},
        {"url": u + "nf", "facts": {}}, {"url": u + "mix", "facts": {}}, {"url": u + "lone", "facts": {}},
        {"url": u + "p1", "facts": {"next_html": [u + "p2", u + "404"], "prev_html": [u + "noindex"]}}, {"url": u + "p2", "facts": {"next_html": [u + "p1"]}},
        {"url": u + "h1", "facts": {"hreflang_html": [{"lang": "en", "url": u + "h1"}, {"lang": "EN", "url": u + "404"}, {"lang": "de", "url": u + "h2"}, {"lang": "fr", "url": u + "noindex"}], "canonical_html": [u + "good"]}}, {"url": u + "h2", "facts": {"hreflang_html": [{"lang": "zz", "url": u + "h3"}, {"lang": "fr", "url": u + "h2"}]}}, {"url": u + "h3", "facts": {"hreflang_html": [{"lang": "en", "url": u + "h2"}]}},
        {"url": u + "map.xml", "content_type": "application/xml", "inlinks": 0, "discovered_from": ""}, {"url": u + "near1", "facts": {"content_text": " ".join(f"w{i}" for i in range(200)), "hash": "n1"}}, {"url": u + "near2", "facts": {"content_text": " ".join(f"w{i}" for i in range(199)) + " z", "hash": "n2"}},
    ]


def all_issues(spark, pages, cfg, entries_rows, llms_files, llms_links):
    maps = spark.createDataFrame(entries_rows, "sitemap string, url string")
    big = spark.range(50_001).select(F.lit("https://s.com/huge.xml").alias("sitemap"), F.concat(F.lit("https://s.com/q"), "id").alias("url"))
    files = spark.createDataFrame(llms_files, "url string, kind string, found boolean, title string, summary string, malformed boolean")
    links = spark.createDataFrame(llms_links, "src string, url string, section string")
    out = checks.evaluate(pages, cfg)
    for more in (graph.chain_issues(spark, pages), sets.hreflang_issues(pages), sets.pagination_issues(spark, pages), sets.sitemap_issues(pages, maps.union(big) if entries_rows else maps), sets.llms_issues(pages, files, links), neardup.issues(pages)):
        out = out.union(more)
    return out


def test_every_check_fires(spark):
    cfg = DEFAULT.with_values(**{"images_store": True, "links.external_store": True, "structured_jsonld": True})
    u = "https://s.com/"
    maps = [("a.xml", u + "noindex"), ("a.xml", u + "map.xml"), ("b.xml", u + "map.xml")]
    files = [("https://s.com/llms.txt", "llms_txt", True, "", "", True), ("https://s.com/llms-full.txt", "llms_full_txt", False, "", "", False), ("https://t.com/llms.txt", "llms_txt", False, "", "", False)]
    links = [("l", u + "404", "S"), ("l", u + "noindex", ""), ("l", u + "unknown", "")]
    pages = rows(spark, kitchen_sink()).cache()
    got = {(r.issue, r.url) for r in all_issues(spark, pages, cfg, maps, files, links).select("issue", "url").distinct().collect()}
    known = {e[0] for e in entries()}
    assert len(known) == 175
    assert {i for i, _ in got} - known == set()
    assert known - {i for i, _ in got} == set()
    for issue, page in [("redirect_broken", "r1"), ("redirect_chain", "r2"), ("redirect_loop", "rl"), ("canonical_to_redirect", "noindex"), ("canonical_non_indexable_target", "links"), ("links_only_non_indexable_inlinks", "lone"), ("links_nofollow_inlinks_only", "nf"), ("links_follow_nofollow_inlinks", "mix"), ("content_near_duplicate", "near1"), ("h2_non_sequential", "wide"), ("pagination_loop", "p1"), ("image_over_size", "big.png")]:
        assert (issue, u + page) in got, issue
    pages.unpersist()


def test_a_healthy_site_has_no_issues(spark):
    secure = {"Strict-Transport-Security": "x", "Content-Security-Policy": "x", "X-Content-Type-Options": "NoSniff", "X-Frame-Options": "deny", "Referrer-Policy": "no-referrer"}
    one = lambda i: {"url": f"https://s.com/p{i}", "headers": secure, "facts": {"titles": [f"A sufficiently long title for page number {i} here"], "descriptions": [f"{i} " + "described well " * 6], "h1s": [f"Heading {i}"], "h2s": [f"Sub {i}"], "canonical_html": [f"https://s.com/p{i}"], "content_text": f"{i}", "links": [{"url": f"https://s.com/p{1 - i}", "anchor": "words"}, {"type": "canonical", "url": f"https://s.com/p{i}", "path_type": "absolute"}]}}
    pages = rows(spark, [one(0), one(1)])
    files = [("https://s.com/llms.txt", "llms_txt", True, "T", "S", False)]
    assert all_issues(spark, pages, DEFAULT, [], files, [("l", "https://s.com/p0", "")]).collect() == []


def brute_rank(nodes, edges, rounds=40):
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    for _ in range(rounds):
        new = defaultdict(float, dict.fromkeys(nodes, 0.15 / len(nodes)))
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank.get(a, 0) / len(bs)
        rank = new
    return rank


def test_page_rank_and_depth(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(12), rng.randrange(14)) for _ in range(30)]
    nodes = list(range(12))
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r.node: r.rank for r in graph.page_rank(spark, spark.createDataFrame([(n,) for n in nodes], "node int"), df).collect()}
    want = brute_rank(nodes, edges)
    assert all(abs(got[n] - v) < 1e-12 for n, v in want.items()) and set(got) == set(want)
    depth, now, level = {0: 0}, {0}, 0
    while now:
        level += 1
        now = {b for a, b in edges if a in now and b not in depth}
        depth |= dict.fromkeys(now, level)
    assert {r.node: r.depth for r in graph.depths(spark, spark.createDataFrame([(0,)], "node int"), df).collect()} == depth


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(42)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(80)]
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(80)] = "x" + str(rng.random())
            texts.append(" ".join(copy))
    texts += [texts[0], "", "one"]
    data = [(f"u{i:02}", str(hash(t)), t) for i, t in enumerate(texts)]
    got = {r.url: (r.n, r.closest) for r in neardup.near_duplicates(spark.createDataFrame(data, "url string, hash string, text string"), 85).collect()}
    want = {}
    for u, h, t in data:
        sims = [neardup.similarity(t, x) for v, g, x in data if g != h]
        near = [s for s in sims if s >= 85]
        if near:
            want[u] = (len(near), max(near))
    assert got == want


def brute_admit(items, depth_cap, host_cap, rules):
    seen, per_depth, per_host, per_rule, out = set(), defaultdict(int), defaultdict(int), defaultdict(int), []
    for seq, url, depth in items:
        host = url.split("/")[2]
        rule = next((i for i, (p, _) in enumerate(rules) if p in url), None)
        if url in seen or per_depth[depth] >= depth_cap or per_host[host] >= host_cap or (rule is not None and per_rule[rule] >= rules[rule][1]):
            continue
        seen.add(url)
        per_depth[depth] += 1
        per_host[host] += 1
        if rule is not None:
            per_rule[rule] += 1
        out.append(seq)
    return out


def test_admission_equals_one_by_one(spark):
    rng = random.Random(5)
    items = [(i, f"https://h{rng.randrange(3)}.x/{rng.choice('ab')}/{rng.randrange(9)}", rng.randrange(3)) for i in range(90)]
    rules = (("/a/", 6), ("/3", 2))
    cfg = DEFAULT.with_values(**{"limits.max_urls_per_depth": 8, "limits.max_per_subdomain": 7, "limits.by_path": rules})
    got = frontier.admit(spark, spark.createDataFrame(items, "seq int, url string, depth int"), cfg)
    assert sorted(r.seq for r in got.collect()) == brute_admit(items, 8, 7, rules)


def test_structured_data():
    types = structured.Types(structured.parse_hierarchy(structured.HIERARCHY))
    page = lambda body: structured.structured_of(body, types)
    ld = lambda text: f'<script type="application/ld+json">{text}</script>'
    got = page(ld('{"@type": "https://schema.org/Restaurant", "name": "a\nb"}'))
    assert got["recovered"] and got["errors"] == ['Restaurant: missing required property "address"'] and got["types"] == ["Restaurant"]
    assert page(ld("{nope"))["parse_errors"] and page("<p>x") is None
    event = page(ld('{"@type": "MusicEvent", "name": 1, "startDate": 1, "location": 1, "offers": {"@type": "Offer"}}'))
    assert event["errors"] == [] and 'Offer: missing recommended property "price"' in event["warnings"]
    assert page(ld('{"@type": "Car", "name": "x"}'))["errors"] == []
    micro = page('<div itemscope itemtype="https://schema.org/Product"><b itemprop=name>x</b><div itemprop=offers itemscope itemtype="http://schema.org/Offer"><i itemprop=price>1</i></div></div>')
    assert micro["formats"] == ["microdata"] and "Offer: missing required property (one of priceCurrency, priceSpecification)" in micro["errors"] and 'Product: missing required property "image"' in micro["errors"]
    assert page('<p typeof="schema:Person">')["types"] == ["Person"]


def test_extraction(spark):
    body = '<div class="a b" id=q><a href=/1>x <b>y</b></a><a href=/2 data-k=v>z</a></div>'
    pages = spark.createDataFrame([("u", body, "x y z x")], "url string, html string, content_text string")
    wanted = [extract.Extraction("css", "css", "div.a > a[data-k=v]"), extract.Extraction("attr", "css", "#q a", attribute="href"), extract.Extraction("path", "xpath", "//div[@id='q']/a[2]/@href"), extract.Extraction("re", "regex", "href=(/.)")]
    got = {r.name: r.value for r in extract.extractions(pages, wanted).collect()}
    assert got == {"css": "z", "attr": "/1 | /2", "path": "/2", "re": "/1 | /2"}
    searches = [extract.Search("n", "x", scope="text"), extract.Search("no", "q{3}", regex=True, mode="not_contains"), extract.Search("el", "y", scope="element:b")]
    assert {r.name: r.value for r in extract.searches(pages, searches).collect()} == {"n": "2", "no": "true", "el": "1"}


def test_compare_buckets(spark):
    pages = lambda *us: spark.createDataFrame([(u,) for u in us], "url string")
    found = lambda *us: spark.createDataFrame([("i", u) for u in us], "issue string, url string")
    got = compare.issue_deltas(pages("a", "b", "c"), pages("a", "b", "d"), found("a", "c", "x"), found("b", "d", "x"))
    assert {(r.url, r.bucket) for r in got.collect()} == {("a", "removed"), ("b", "added"), ("c", "missing"), ("d", "new"), ("x", "new"), ("x", "missing")}


def test_assembled_crawl(spark):
    fetched = spark.createDataFrame([("https://s.com/", '<title>t</title><a href="/a">a</a><a href="/a">b</a>'), ("https://s.com/a", '<meta name=robots content=noindex><a href="/">x</a>')], "url string, html string")
    pages = crawl.finalized(spark, crawl.assemble(spark, fetched), ["https://s.com/"])
    got = {r.url: r for r in pages.collect()}
    assert got["https://s.com/a"].indexability_status == "Noindex" and got["https://s.com/a"].depth == 1 and got["https://s.com/a"].inlinks == 2 and got["https://s.com/"].unique_outlinks == 1
    assert round(got["https://s.com/"].link_score, 6) == 100.0
    assert views.tab(pages, "internal").count() == 2 and len(views.tab(pages, "internal").columns) == 21
    issues = checks.evaluate(pages)
    assert {r.metric: r["count"] for r in views.overview(pages, issues).collect()}["total"] == 2
    diff = crawl.raw_rendered_diff(pages.where("depth = 1"), pages.where("depth = 1")).first().jsdiff
    assert not diff.title_changed and diff.js_links == 0
    scored = scorecard.scores(spark, pages.withColumn("site", F.lit("s")), issues.withColumn("site", F.lit("s"))).first()
    assert scored.urls == 2 and scored.indexable_rate == 0.5


def test_sinks(spark, tmp_path):
    data = spark.createDataFrame([("u1", "a<\"b\",\nc", None), ("u2", "é", 3)], "url string, t string, n int")
    sinks.write_json(data.orderBy("url"), f"{tmp_path}/x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == [{"url": "u1", "t": "a<\"b\",\nc", "n": ""}, {"url": "u2", "t": "é", "n": "3"}]
    sinks.write_csv(data, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert {r.t for r in back.collect()} == {"a<\"b\",\nc", "é"}
    sinks.write_xlsx(data, f"{tmp_path}/x.xlsx")
    with zipfile.ZipFile(tmp_path / "x.xlsx") as book:
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;" in sheet and 'r="C3"' in sheet
    pages = rows(spark, [{"url": f"https://s.com/{i:02}", "facts": {}, "headers": {"Last-Modified": "Wed, 21 Oct 2015 07:28:00 GMT"}} for i in range(5)] + [{"url": "https://s.com/no", "indexable": False}])
    names = sinks.write_sitemaps(pages, f"{tmp_path}/maps", "https://s.com/", per_file=2, lastmod=True)
    assert names == ["sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml", "sitemap-index.xml"] and "<lastmod>2015-10-21</lastmod>" in (tmp_path / "maps/sitemap-1.xml").read_text()
    read = sinks.read_sitemaps(spark, f"file://{tmp_path}/maps/sitemap-[0-9].xml")
    assert sorted(r.url for r in read.collect()) == [f"https://s.com/{i:02}" for i in range(5)]
    assert sinks.read_sitemaps(spark, f"file://{tmp_path}/maps/sitemap-index.xml", "sitemap").count() == 3
    archive = sinks.write_warc(pages.withColumn("html", F.lit("<p>")), f"{tmp_path}/warc", {"software": "s"}).collect()
    raw = b"".join(gzip.decompress((tmp_path / "warc" / r.archive).read_bytes()) for r in archive)
    assert raw.count(b"WARC-Type: response") == 6 and b"WARC-Type: warcinfo" in raw


def test_streams(spark, tmp_path):
    schema = "seq long, host string, url string, ts timestamp"
    items = [(i, f"h{i % 2}", f"u{i % 7}", f"2024-01-01 00:00:{i:02}") for i in range(20)]
    src = tmp_path / "in"
    for k in range(2):
        part = spark.createDataFrame(items[k * 10 : k * 10 + 10], "seq long, host string, url string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(f"file://{src}")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = ingest.page_sink(read(), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in ingest.stored_pages(spark, f"file://{tmp_path}/out").collect()) == [f"u{i}" for i in range(7)]
    q = ingest.admitted(read().select("host", "url", "seq"), 3).writeStream.format("memory").queryName("adm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r[0]: r[1] for r in spark.sql("select host, count(*) from adm group by host").collect()} == {"h0": 3, "h1": 3}
    q = ingest.first_seen(read(), "url").writeStream.format("memory").queryName("fs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fs").count() == 7
    q = ingest.counters(read(), "host", width="1 minute").writeStream.format("memory").queryName("cnt").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = ingest.counters(spark.read.schema(schema).parquet(f"file://{src}"), "host", width="1 minute")
    assert sorted(map(tuple, spark.table("cnt").collect())) == sorted(map(tuple, batch.collect()))
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert ingest.resumed(found.where("url = 'a'"), found, 2).count() == 1


def test_a_long_discovery_path(spark):
    n = 113
    pages = spark.createDataFrame([(str(i), str(i - 1) if i else "") for i in range(n)] + [("a", "b"), ("b", "a")], "url string, discovered_from string")
    got = {r.url: (r.hops, r.path) for r in graph.crawl_paths(spark, pages).collect()}
    assert got[str(n - 1)] == (n - 1, " -> ".join(map(str, range(n)))) and got["0"] == (0, "0") and got["a"] == (1, "b -> a")


def test_whole_hierarchy_from_a_file(tmp_path):
    path = tmp_path / "types.csv"
    path.write_text("id,label,subTypeOf\nhttps://schema.org/Thing,Thing,\nhttps://schema.org/Product,Product,https://schema.org/Thing\nhttps://schema.org/Vehicle,Vehicle,https://schema.org/Product\nhttps://schema.org/Drug,Drug,\"https://schema.org/Product, https://schema.org/Thing\"\n")
    types = structured.Types(structured.read_hierarchy(str(path)))
    assert types.root("Drug") == "Product" and types.root("Vehicle") == "" and types.root("Thing") == "" and types.above["Vehicle"] == {"Product", "Thing"}
    assert structured.Types(structured.parse_hierarchy(structured.HIERARCHY)).roots(["Bakery", "Organization", "X"]) == ["LocalBusiness"]


def test_offers_are_checked_by_what_they_are_part_of():
    types = structured.Types(structured.parse_hierarchy(structured.HIERARCHY))
    page = lambda kind, offer: structured.structured_of(f'<script type="application/ld+json">{{"@type": "{kind}", "name": "n", "offers": {offer}}}</script>', types)
    assert "Offer: missing required property (one of priceCurrency, priceSpecification)" in page("Product", '{"price": 1}')["errors"]
    assert not any(e.startswith("Offer") for e in page("MobileApplication", '{"price": 1}')["errors"])
    assert any(e.startswith("AggregateOffer: missing required property (one of lowPrice") for e in page("WebApplication", '{"@type": "AggregateOffer"}')["errors"])
    assert not any("Offer" in e for e in page("Event", "{}")["errors"]) and 'Offer: missing recommended property "price"' in page("Event", "{}")["warnings"]
    assert not any("Offer" in e for e in page("Thing", "{}")["errors"])


def test_streams_in_steps_with_progress(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", "h") for i in range(6)], "url string, html string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = ingest.Progress()
    spark.streams.addListener(seen)
    try:
        stream = ingest.rate_limited(spark, "url string, html string", f"{tmp_path}/in", 1)
        q = ingest.page_sink(stream, f"{tmp_path}/out", f"{tmp_path}/cp", every="0 seconds")
        q.processAllAvailable()
        batches = [p.numInputRows for p in q.recentProgress if p.numInputRows]
        q.stop()
    finally:
        spark.streams.removeListener(seen)
    assert len(batches) == 3 and sum(batches) == 6 and ingest.stored_pages(spark, f"{tmp_path}/out").count() == 6


def test_registry_of_crawls(spark):
    from siteglass.operators import registry

    crawls = spark.createDataFrame([("a", "running", 1)], "id string, status string, started int")
    two = registry.with_crawl(crawls, id="b", status="queued", started=2)
    done = registry.with_crawl(two, id="a", status="completed")
    assert {tuple(r) for r in done.collect()} == {("a", "completed", 1), ("b", "queued", 2)}
    assert [r.id for r in registry.without_crawl(done, "a").collect()] == ["b"]


def test_sitemaps_that_robots_name(spark):
    robots = spark.createDataFrame([("a.com", "User-agent: *\nSITEMAP: https://a.com/1.xml\n sitemap:https://a.com/2.xml"), ("b.com", None), ("c.com", "Disallow: /")], "authority string, text string")
    got = {(r.authority, r.url) for r in sinks.robots_sitemaps(robots).collect()}
    assert got == {("a.com", "https://a.com/1.xml"), ("a.com", "https://a.com/2.xml"), ("b.com", "https://b.com/sitemap.xml"), ("c.com", "https://c.com/sitemap.xml")}
