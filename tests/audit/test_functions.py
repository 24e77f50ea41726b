"""Scalar functions and parsers against tables of cases."""

import pytest
from pyspark.sql import functions as F
from siteglass.config import DEFAULT
from siteglass.functions import indexability, llms, robots, text, urls
from siteglass.plans import sql


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.COM", "http://example.com/"),
        ("https://example.com:443/a%2fb?x=%2f#frag", "https://example.com/a%2Fb?x=%2f"),
        ("http://example.com:8080/A/b", "http://example.com:8080/A/b"),
        ("http://example.com/é x", "http://example.com/%C3%A9%20x"),
        ("http://u:p@Example.com/", "http://u:p@example.com/"),
        (" http://example.com/? ", "http://example.com/?"),
        ("http://example.com/%zz", None),
        ("http://[::1]:80/", "http://[::1]/"),
    ],
)
def test_normalized(raw, want):
    assert urls.normalized(raw) == want


def test_fragments_and_case_are_options():
    assert urls.normalized("http://a.b/%AB#c", keep_fragment=True, lower_hex=True) == "http://a.b/%ab#c"


@pytest.mark.parametrize(("href", "want"), [("b", "http://x.com/a/b"), ("../c", "http://x.com/c"), ("//y.com/d", "http://y.com/d"), ("?q=1", "http://x.com/a/?q=1"), ("", "http://x.com/a/")])
def test_resolved(href, want):
    assert urls.resolved("http://x.com/a/", href) == want


def column(spark, expr, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *"abc"[: len(rows[0])]])
    return [r[0] for r in df.select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def test_url_columns(spark):
    a = F.col("a")
    cases = [("HTTP://User@Ex.com:80/a//b?x=1&&y#z",), ("https://ex.com:8443",), ("https://localhost/",)]
    assert column(spark, urls.authority(a), *cases) == ["ex.com", "ex.com:8443", "localhost"]
    assert column(spark, urls.folder_depth(a), *cases) == [2, 0, 0]
    assert column(spark, urls.query_param_count(a), *cases) == [2, 0, 0]
    assert column(spark, urls.is_valid(a), *cases, ("ftp://x.com/",), ("http://nodot/",)) == [True, True, True, False, False]
    assert column(spark, urls.path_type(a), ("//x/y",), ("mailto:x",), ("/p",), ("p/q",)) == ["protocol_relative", "absolute", "root_relative", "path_relative"]


def test_scope(spark):
    got = column(spark, urls.scope(F.col("a"), F.lit("https://shop.co.uk/"), cdns=("cdn.net/img",)), ("https://www.shop.co.uk/x",), ("https://shop.co.uk:444/",), ("https://cdn.net/img/a",), ("https://cdn.net/js",), ("https://other.co.uk/",))
    assert got == ["internal", "external", "internal", "external", "external"]
    assert column(spark, urls.scope(F.col("a"), F.lit("https://www.x.com/")), ("https://x.com/",), ("http://www.x.com/",)) == ["external", "internal"]


def test_rewrite(spark):
    got = column(spark, urls.rewrite(F.col("a"), ("utm",), (("^http:(.*)", "https:${1}"),), True), ("http://X.com/A?UTM=1&b=2#f",), ("http://x.com/?utm=1",))
    assert got == ["https://x.com/a?b=2", "https://x.com/"]


def test_widths_and_space(spark):
    assert column(spark, text.pixel_width(F.col("a"), 20.0), ("iiii",), ("WWWW",), ("漢é",), ("",)) == [18, 76, 31, 0]
    assert column(spark, text.collapse_space(F.col("a")), ("  a  b​c \n",)) == ["a bc"]


@pytest.mark.parametrize(("word", "n"), [("table", 2), ("tables", 2), ("make", 1), ("baked", 1), ("initial", 3), ("media", 3), ("rhythm", 1), ("the", 1), ("pfft", 0)])
def test_syllables(spark, word, n):
    assert column(spark, text.syllables(F.col("a")), (word,)) == [n]
    if n:
        assert text.block_stats([word + " cat"])[3] == min(100.0, max(0.0, 206.835 - 1.015 * 2 - 84.6 * (n + 1) / 2))


def test_sentences():
    assert text.sentences("One two. Three four") == 2
    assert text.sentences("Version 1.2 is out") == 2
    assert text.sentences("a") == 1 and text.sentences("") == 0
    # a stop at a line's last word ends no sentence of its own
    first = "x" * 70 + ". yyyyyyyyy. tail"
    assert text.sentences(first) == 3
    assert text.block_stats([]) == (0, 0, 0.0, 0.0)


ROBOTS = "user-agent: a\nuser-agent: Blue\ndisallow: /x\n\nuser-agent: *\nDisallow: / # all\nallow: /p$\nsitemap: http://s/x.xml\nUser-agent: blueish\nAllow: /"


def test_robots(spark):
    rules, maps = robots.parse(ROBOTS)
    assert maps == ["http://s/x.xml"] and ("blue", False, "/x", 3) in rules
    files = spark.createDataFrame([("h.com", ROBOTS)], "authority string, text string")
    pages = spark.createDataFrame([("http://h.com/x/1",), ("http://h.com/p",), ("http://h.com/p/q",), ("http://other.com/x",)], "url string")
    verdict = lambda ua: {r.url: (r.allowed, r.line) for r in robots.verdicts(pages, robots.rules(files), ua).collect()}
    assert verdict("BlueBot")["http://h.com/x/1"] == (False, 3) and verdict("BlueBot")["http://h.com/p/q"] == (True, None)
    other = verdict("zzz")
    assert other["http://h.com/p"] == (True, 7) and other["http://h.com/p/q"] == (False, 6) and other["http://other.com/x"] == (True, None)
    assert [r.sitemap for r in robots.sitemaps(files).collect()] == ["http://s/x.xml"]


def test_robots_wildcards():
    import re

    assert re.match(robots.pattern("/a*b$"), "/axxb") and not re.match(robots.pattern("/a*b$"), "/axxbc")


def test_indexability_order(spark):
    rows = [
        (404, "", True, "", [], [], [], "Blocked by Robots.txt"), (0, "", False, "", [], [], [], "No Response"), (503, "", False, "", [], [], [], "Server Error"), (404, "", False, "", [], [], [], "Client Error"),
        (302, "", False, "", [], [], [], "Redirected"), (200, "", False, "u", [], [], [], "Redirected"), (200, "", False, "", ["a, NOINDEX"], [], [], "Noindex"), (200, "", False, "", [], ["me: none"], [], "Noindex"),
        (200, "", False, "", [], ["you: noindex", "unavailable_after: noindex"], [], ""), (200, "", False, "", [], [], ["", "v"], "Canonicalised"), (200, "", False, "", [], [], ["u"], ""),
    ]
    df = spark.createDataFrame(rows, "code int, err string, blocked boolean, refresh string, meta array<string>, tag array<string>, canon array<string>, want string")
    got = df.select("want", indexability.status(F.lit("u"), F.col("code"), F.col("err"), F.col("blocked"), F.col("refresh"), F.col("meta"), F.col("tag"), F.col("canon"), "Me").alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_llms_txt():
    got = llms.parse("# T\n> one\n> two\n\n> no\n## Docs\n- [A](/a): first\n* [B](http://b)\n- broken\nfree text\n# Other")
    assert got["title"] == "T" and got["summary"] == "one two" and got["malformed"]
    assert [(x["section"], x["url"], x["desc"]) for x in got["links"]] == [("Docs", "/a", "first"), ("Docs", "http://b", "")]


def test_guard():
    assert sql.guard("-- x\n/* y */ SELECT 1;") == "-- x\n/* y */ SELECT 1"
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "", "insert into t values (1)"):
        with pytest.raises(ValueError, match="only"):
            sql.guard(bad)


def test_query_caps_rows(spark):
    got = sql.query(spark, "SELECT id FROM range(10)", 3)
    assert got["row_count"] == 3 and got["truncated"] and got["columns"] == ["id"]


def test_config():
    assert DEFAULT.with_values(**{"thresholds.title.max_px": 600}).thresholds.title.max_px == 600
    with pytest.raises(KeyError):
        DEFAULT.with_values(**{"thresholds.nope": 1})
    with pytest.raises(ValueError, match="percentage"):
        DEFAULT.with_values(**{"content.near_duplicate_threshold": 101})
