"""Set analyses: hreflang, pagination, sitemaps and llms.txt, as joins of annotations with pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.functions import urls
from siteglass.operators.checks import exploded, found, targets
from siteglass.operators.graph import HOPS, walk

# ISO 639-1 language codes and ISO 3166-1 alpha-2 country codes in use.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss "
    "st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
REGIONS = (
    "ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bl bm bn bo bq br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv "
    "cw cx cy cz de dj dk dm do dz ec ee eg eh er es et fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im "
    "in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mf mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw "
    "mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss "
    "st sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug um us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()


def valid_hreflang(code: Column) -> Column:
    """x-default, a language, or a language and a region."""
    low = F.lower(code)
    region = F.regexp_replace(low, "^[^-]*-", "")
    return (low == "x-default") | (F.substring_index(low, "-", 1).isin(LANGUAGES) & (~low.contains("-") | region.isin(REGIONS)))


def hyperlinked(pages: DataFrame) -> DataFrame:
    """(url) that another page links to."""
    links = pages.where("facts IS NOT NULL").select(F.col("url").alias("src"), F.explode("facts.links").alias("l"))
    return links.where("l.type = 'hyperlink' AND l.url <> '' AND l.url <> src").select(F.col("l.url").alias("url")).distinct()


def unlinked(pages: DataFrame, annotated: DataFrame, issue: str, words: str) -> DataFrame:
    """Internal crawled pages that are annotated (to, src) but linked from nowhere, with the least source."""
    sources = annotated.groupBy(F.col("to").alias("url")).agg(F.min("src").alias("src"))
    there = pages.where("scope = 'internal' AND state = 'crawled'").select("url")
    left = sources.join(there, "url", "left_semi").join(hyperlinked(pages), "url", "left_anti")
    return left.select("url", F.lit(issue).alias("issue"), F.concat(F.lit(words), "src").alias("detail"))


def hreflang_issues(pages: DataFrame) -> DataFrame:
    rows = pages.where("facts IS NOT NULL").select("url", F.concat("facts.hreflang_html", "facts.hreflang_http").alias("all")).where("size(all) > 0")
    by_page = exploded(rows, [
        found("hreflang_missing_self_reference", ~F.exists("all", lambda h: h["url"] == F.col("url"))),
        found("hreflang_missing_x_default", ~F.exists("all", lambda h: F.lower(h["lang"]) == "x-default")),
    ])
    entries = rows.select("url", F.explode("all").alias("h")).select("url", "h.lang", F.col("h.url").alias("to"))
    codes = exploded(entries, [found("hreflang_invalid_code", ~valid_hreflang(F.col("lang")), F.col("lang"))])
    own = F.filter(F.concat("facts.hreflang_html", "facts.hreflang_http"), lambda h: (h["url"] == F.col("url")) & (F.lower(h["lang"]) != "x-default"))
    canonical = F.get(F.filter(F.concat("facts.canonical_html", "facts.canonical_http"), lambda c: c != ""), F.lit(0))
    back = F.transform(F.concat("facts.hreflang_html", "facts.hreflang_http"), lambda h: h["url"])
    to = pages.select(F.col("url").alias("to"), F.col("status_code").alias("code"), F.get(own, F.lit(0))["lang"].alias("says"), canonical.alias("canonical"), F.col("indexability_status").alias("status"), back.alias("back"))
    met = entries.where("to <> url").join(to, "to")
    good, lang, says = F.col("code") == 200, F.col("lang"), F.col("says")
    told = F.concat(F.col("to"), F.lit(' self-declares "'), says, F.lit('", annotated "'), lang, F.lit('"'))
    by_link = exploded(met, [
        found("hreflang_non_200", ~F.coalesce(good, F.lit(False)), F.col("to")),
        found("hreflang_inconsistent_return", good & (F.lower(lang) != "x-default") & (says != "") & (F.lower(says) != F.lower(lang)), told),
        found("hreflang_non_canonical_return", good & (F.col("canonical") != F.col("to")), F.col("to")),
        found("hreflang_noindex_return", good & (F.col("status") == "Noindex"), F.col("to")),
        found("hreflang_missing_return", good & F.col("back").isNotNull() & ~F.array_contains("back", F.col("url")), F.col("to")),
    ])
    lonely = unlinked(pages, met.select("to", F.col("url").alias("src")), "hreflang_unlinked", "annotated by ")
    return reduce(DataFrame.union, (by_page, codes, by_link, lonely)).distinct()


def pagination_issues(spark: SparkSession, pages: DataFrame) -> DataFrame:
    with_facts = pages.where("facts IS NOT NULL")
    sides = []
    for own, back in (("next_html", "prev_html"), ("prev_html", "next_html")):
        to = pages.select(F.col("url").alias("to"), F.col("status_code").alias("code"), F.col(f"facts.{back}").alias("back"))
        sides.append(with_facts.select("url", F.explode(f"facts.{own}").alias("to")).join(to, "to"))
    met = sides[0].union(sides[1])
    good = F.coalesce(F.col("code") == 200, F.lit(False))
    by_link = exploded(met, [
        found("pagination_non_200", ~good, F.col("to")),
        found("pagination_sequence_error", good & F.col("back").isNotNull() & ~F.array_contains("back", F.col("url")), F.col("to")),
    ])
    parts = [by_link, unlinked(pages, met.where("to <> url").select("to", F.col("url").alias("src")), "pagination_unlinked", "in pagination of ")]
    for side in ("next", "prev"):
        first = F.get(F.filter(F.concat(f"facts.{side}_html", f"facts.{side}_http"), lambda t: t != ""), F.lit(0))
        steps = with_facts.select(F.col("url").alias("at"), first.alias("to")).where("to IS NOT NULL")
        loops = walk(spark, steps.select(F.col("at").alias("node")), steps, HOPS).where("loop")
        parts.append(loops.select(F.col("source").alias("url"), F.lit("pagination_loop").alias("issue"), F.concat(F.size("hops").cast("string"), F.lit(" hops")).alias("detail")))
    return reduce(DataFrame.union, parts).distinct()


def sitemap_issues(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Issues of sitemaps and of their entries (sitemap, url) against pages; none at all without entries."""
    return sitemap_sizes(entries).union(sitemap_url_issues(pages, entries))


def sitemap_sizes(entries: DataFrame) -> DataFrame:
    """Issues of the sitemaps themselves: more than 50,000 different entries."""
    sizes = entries.select("sitemap", "url").distinct().groupBy("sitemap").agg(F.count("*").alias("n")).where("n > 50000")
    return sizes.select(F.col("sitemap").alias("url"), F.lit("sitemap_over_50k").alias("issue"), F.concat(F.col("n").cast("string"), F.lit(" URLs")).alias("detail"))


def sitemap_url_issues(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Issues of the URLs of sitemap entries and of pages."""
    entries = entries.select("sitemap", "url").distinct()
    listed = entries.groupBy("url").agg(F.array_sort(F.collect_set("sitemap")).alias("maps"))
    rows = listed.join(pages.select("url", "scope", "state", "indexable", "content_type", "inlinks", "discovered_from", "depth"), "url")
    kind, where = F.lower("content_type"), F.array_join("maps", ", ")
    crawled = F.col("state") == "crawled"
    by_url = exploded(rows, [
        found("sitemap_non_indexable", crawled & ~F.coalesce("indexable", F.lit(False)), where),
        found("sitemap_nested_as_url", crawled & (F.col("scope") == "internal") & kind.contains("xml") & ~kind.contains("rss") & ~kind.contains("atom"), where),
        found("sitemap_orphan", (F.coalesce("inlinks", F.lit(0)) == 0) & (F.coalesce("discovered_from", F.lit("")) == "") & (F.coalesce("depth", F.lit(0)) <= 0), where),
        found("sitemap_in_multiple", F.size("maps") > 1, where),
    ])
    good = pages.where("scope = 'internal' AND state = 'crawled' AND indexable AND facts IS NOT NULL").select("url")
    absent = good.join(listed, "url", "left_anti").crossJoin(F.broadcast(entries.limit(1).select(F.lit("sitemap_not_in_sitemap").alias("issue"))))
    return by_url.union(absent.select("url", "issue", F.lit("").alias("detail")))


def llms_issues(pages: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """Issues of llms.txt files (url, kind, found, title, summary, malformed) and their curated links (src, url, section)."""
    host = urls.authority(F.col("url"))
    first = files.where("kind = 'llms_txt'").withColumn("host", host)
    full = files.where("kind = 'llms_full_txt'").select(host.alias("host"), F.col("url").alias("full_url"), F.col("found").alias("full_found"))
    rows = first.join(full, "host", "left")
    there = F.col("found")
    by_file = exploded(rows, [
        found("llms_txt_missing", ~there),
        found("llms_txt_invalid_format", there & (F.coalesce("title", F.lit("")) == ""), "missing H1 title"),
        found("llms_txt_missing_summary", there & (F.coalesce("summary", F.lit("")) == "")),
        found("llms_txt_malformed_link_list", there & F.col("malformed")),
    ])
    no_full = rows.where("found AND NOT full_found").select(F.col("full_url").alias("url"), F.lit("llms_full_txt_missing").alias("issue"), F.lit("").alias("detail"))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" §"), "section")).otherwise("")
    met = links.select("url", F.concat(F.lit("listed in "), "src", section).alias("where"), F.col("url").alias("to")).join(targets(pages), "to", "left")
    code = F.coalesce("to_code", F.lit(0))
    known = F.col("to_state").isNotNull()
    dead = known & ((F.col("to_state") == "error") | (code < 200) | (code >= 400))
    by_link = exploded(met, [
        found("llms_txt_link_unverified", ~known, F.col("where")),
        found("llms_txt_broken_link", dead, F.concat(F.lit("status "), code.cast("string"), F.lit("; "), "where")),
        found("llms_txt_link_non_indexable", known & ~dead & ~F.coalesce("to_indexable", F.lit(False)), F.trim(F.concat(F.coalesce("to_status", F.lit("")), F.lit("; "), "where"))),
    ])
    return by_file.union(no_full).union(by_link).distinct()
