"""The audit checks as DataFrame expressions: rules of a row, rules of a link, and rules across pages.

Rules of a row become one array of (issue, detail) and one explode. Links are exploded once and joined once with their
targets; what pages need of them is aggregated by source. Facts that are missing mean a rule isn't evaluated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.config import DEFAULT, Config
from siteglass.functions import urls
from siteglass.functions.text import DESCRIPTION_PX, TITLE_PX, pixel_width

SECURE_REFERRER = ("no-referrer-when-downgrade", "strict-origin-when-cross-origin", "no-referrer", "strict-origin")
SEARCH_PARAMS = ("q", "s", "search", "query", "keyword", "keywords")
DIRECTIVES = ("noindex", "nofollow", "none", "noimageindex", "nosnippet", "notranslate", "noodp", "noydir")
MB2 = 2 * 1024 * 1024


def col(name: str) -> Column:
    return F.col(name)


def fact(name: str) -> Column:
    return F.col(f"facts.{name}")


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def found(issue: str, when: Column, detail: Column | str = "") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(issue).alias("issue"), F.coalesce(detail, F.lit("")).alias("detail")))


def every(issue: str, when: Column, details: Column) -> Column:
    """One occurrence for each detail of an array."""
    empty = F.array().cast("array<struct<issue:string,detail:string>>")
    made = F.transform(details, lambda d: F.struct(F.lit(issue).alias("issue"), F.coalesce(d, F.lit("")).alias("detail")))
    return F.when(F.coalesce(when, F.lit(False)), F.coalesce(made, empty)).otherwise(empty)


def exploded(rows: DataFrame, single: list[Column], many: list[Column] = (), url: str = "url") -> DataFrame:
    ones = F.filter(F.array(*single), lambda x: x.isNotNull())
    all_of = F.concat(ones, *many) if many else ones
    rows = rows if url == "url" else rows.withColumn("url", F.col(url))
    return rows.select("url", all_of.alias("__found")).select("url", F.explode("__found").alias("x")).select("url", "x.issue", "x.detail")


def is_html(content_type: Column) -> Column:
    return F.coalesce(content_type.contains("text/html") | content_type.contains("application/xhtml"), F.lit(False))


def gates(cfg: Config) -> dict[str, Column]:
    crawled = (col("state") == "crawled") & (col("scope") == "internal")
    with_facts = crawled & col("facts").isNotNull()
    eligible = F.lit(True) if not cfg.advanced.ignore_non_indexable_for_issues else F.coalesce(col("indexable"), F.lit(False))
    html = is_html(col("content_type"))
    return {"P": crawled, "PF": with_facts, "PFE": with_facts & eligible, "H": html, "E": eligible}


def url_path(url: Column) -> Column:
    """What follows the host, query included; empty without a slash."""
    return F.regexp_extract(url, r"^(?:https://)?(?:http://)?[^/]*(/[\s\S]*)$", 1)


def url_rules(url: Column, gate: Column, cfg: Config = DEFAULT) -> list[Column]:
    path = url_path(url)
    on = gate & ~path.isin("", "/")
    no_query = F.substring_index(path, "?", 1)
    segments = F.filter(F.split(no_query, "/"), lambda s: s != "")
    query = F.when(path.contains("?"), F.regexp_extract(path, r"^[^?]*\?([\s\S]*)$", 1))
    asked = first(F.filter(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*SEARCH_PARAMS) & p.rlike("=[\\s\\S]")))
    size = F.octet_length(url)
    return [
        found("url_uppercase", on & (F.lower(path) != path)),
        found("url_underscores", on & path.contains("_")),
        found("url_non_ascii", on & path.rlike(r"[^\x00-\x7f]")),
        found("url_parameters", on & path.contains("?")),
        found("url_multiple_slashes", on & no_query.contains("//")),
        found("url_contains_space", on & (path.contains("%20") | path.contains(" "))),
        found("url_repetitive_path", on & (F.size(segments) != F.size(F.array_distinct(segments)))),
        found("url_ga_params", on & (path.contains("utm_") | path.contains("_ga=") | path.contains("_gl="))),
        found("url_internal_search", on & asked.isNotNull(), F.substring_index(asked, "=", 1)),
        found("url_over_length", on & (size > cfg.thresholds.url_max_chars), F.concat(size.cast("string"), F.lit(" chars"))),
    ]


def response_rules() -> list[Column]:
    out = []
    state, code = col("state"), F.coalesce(col("status_code"), F.lit(0))
    out.append(found("internal_blocked_robots", (state == "blocked_robots") & (col("scope") == "internal"), F.concat(F.lit("matched robots.txt line "), F.coalesce(col("matched_robots_line"), F.lit(0)).cast("string"))))
    answered = ~state.isin("blocked_robots", "error")
    for side in ("internal", "external"):
        here = (col("scope") == "internal") if side == "internal" else (col("scope") != "internal")
        out += [
            found(f"{side}_no_response", here & (state == "error"), col("fetch_error")),
            found(f"{side}_server_error", here & answered & (code >= 500), col("status")),
            found(f"{side}_client_error", here & answered & (code >= 400) & (code < 500), col("status")),
        ]
    inside = (col("scope") == "internal") & answered
    out.append(found("internal_redirect", inside & (code >= 300) & (code < 400), col("redirect_url")))
    out.append(found("internal_redirect_meta_refresh", inside & (code < 300) & (col("redirect_type") == "meta_refresh"), col("redirect_url")))
    return out


def header(name: str) -> Column:
    return F.coalesce(F.col("headers")[name], F.lit(""))


def header_rules(gate: Column) -> list[Column]:
    on = gate & col("url").startswith("https://") & col("status_code").between(200, 299)
    cookies = F.filter(F.split(header("Set-Cookie"), "\n"), lambda c: c != "")
    careless = F.exists(cookies, lambda c: ~F.exists(F.split(c, ";"), lambda p: F.lower(F.trim(p)) == "secure"))
    return [
        found("security_insecure_cookie", on & careless),
        found("security_missing_hsts", on & (header("Strict-Transport-Security") == "")),
        found("security_missing_csp", on & (header("Content-Security-Policy") == "")),
        found("security_missing_content_type_options", on & (F.lower(header("X-Content-Type-Options")) != "nosniff")),
        found("security_missing_x_frame_options", on & ~F.upper(header("X-Frame-Options")).isin("DENY", "SAMEORIGIN")),
        found("security_missing_referrer_policy", on & ~F.lower(F.trim(header("Referrer-Policy"))).isin(*SECURE_REFERRER)),
    ]


def size_rules(g: dict[str, Column], cfg: Config) -> list[Column]:
    ok = g["P"] & (col("status_code") == 200)
    kb = F.concat(F.expr("size div 1024").cast("string"), F.lit(" KB"))
    size = F.concat(col("size").cast("string"), F.lit(" bytes"))
    return [
        found("image_over_size", ok & col("content_type").startswith("image/") & (col("size") > cfg.thresholds.image_max_kb * 1024), kb),
        found("validation_resource_over_2mb", ok & ~g["H"] & (col("content_type").contains("css") | col("content_type").contains("javascript")) & (col("size") > MB2), size),
    ]


def text_rules(kind: str, on: Column, texts: Column, outside: Column, limits, px: float) -> list[Column]:
    """Rules of titles and descriptions: the first one's length and width."""
    text = first(texts)
    there = on & (F.size(texts) > 0) & (F.trim(text) != "")
    missing = on & ~F.coalesce((F.size(texts) > 0) & (F.trim(text) != ""), F.lit(False))
    n, wide = F.length(text), pixel_width(text, px)
    is_title = kind == "title"
    shown = F.concat(wide.cast("string"), F.lit("px"))
    return [
        found(f"{kind}_missing", missing),
        found(f"{kind}_multiple", there & (F.size(texts) > 1), F.concat(F.size(texts).cast("string"), F.lit(" titles")) if is_title else ""),
        found(f"{kind}_over_chars", there & (n > limits.max_chars), text if is_title else ""),
        found(f"{kind}_below_chars", there & (n < limits.min_chars), text if is_title else ""),
        found(f"{kind}_over_pixels", there & F.lit(limits.max_px > 0) & (wide > limits.max_px), shown),
        found(f"{kind}_below_pixels", there & F.lit(limits.min_px > 0) & (wide < limits.min_px), shown),
        found(f"{kind}_outside_head", on & (outside > 0)),
    ]


def title_rules(on: Column, cfg: Config) -> list[Column]:
    title = first(fact("titles"))
    has_title = (F.size(fact("titles")) > 0) & (F.trim(title) != "")
    return [
        *text_rules("title", on, fact("titles"), fact("titles_outside_head"), cfg.thresholds.title, TITLE_PX),
        found("title_same_as_h1", on & has_title & (F.lower(title) == F.lower(first(fact("h1s"))))),
    ]


def element_rules(on: Column, cfg: Config) -> list[Column]:
    t = cfg.thresholds
    h1s, h2s, levels = fact("h1s"), fact("h2s"), fact("heading_levels")
    has_h1 = (F.size(h1s) > 0) & (F.trim(first(h1s)) != "")
    long = lambda hs, most: F.exists(F.slice(hs, 1, 2), lambda h: F.length(h) > most)
    at = F.array_position(levels, F.lit(2)).cast("int")
    before_h2 = F.when(at > 1, F.get(levels, at - 2))
    return [
        *title_rules(on, cfg),
        *text_rules("description", on, fact("descriptions"), fact("descriptions_outside_head"), t.description, DESCRIPTION_PX),
        found("keywords_multiple", on & (F.size(fact("keywords")) > 1)),
        found("h1_missing", on & ~F.coalesce(has_h1, F.lit(False))),
        found("h1_multiple", on & has_h1 & (F.size(h1s) > 1)),
        found("h1_over_chars", on & has_h1 & long(h1s, t.h1_max_chars)),
        found("h1_non_sequential", on & has_h1 & (first(levels) != 1), F.concat(F.lit("first heading is h"), first(levels).cast("string"))),
        found("h1_alt_text", on & has_h1 & fact("h1_alt_text"), first(h1s)),
        found("h2_missing", on & (F.size(h2s) == 0)),
        found("h2_multiple", on & (F.size(h2s) > 1)),
        found("h2_over_chars", on & long(h2s, t.h2_max_chars)),
        found("h2_non_sequential", on & (before_h2 > 2), F.concat(F.lit("first h2 follows an h"), before_h2.cast("string"))),
    ]


def content_rules(on: Column, cfg: Config) -> list[Column]:
    n, low = fact("word_count"), F.lower(fact("content_text"))
    patterns = cfg.thresholds.soft_404_patterns
    hit = F.coalesce(*[F.when(low.contains(p.lower()), F.lit(p)) for p in patterns]) if patterns else F.lit(None).cast("string")
    return [
        found("content_low_word_count", on & (n > 0) & (n < cfg.thresholds.low_content_words), F.concat(n.cast("string"), F.lit(" words"))),
        found("content_lorem_ipsum", on & low.contains("lorem ipsum")),
        found("content_soft_404", on & (col("status_code") == 200) & hit.isNotNull(), hit),
        found("content_readability_very_difficult", on & (n > 0) & (fact("flesch") < 30)),
        found("content_readability_difficult", on & (n > 0) & (fact("flesch") >= 30) & (fact("flesch") < 50)),
    ]


def canonical_rules(g: dict[str, Column]) -> list[Column]:
    on, every_one = g["PF"], F.concat(fact("canonical_html"), fact("canonical_http"))
    some = on & (F.size(every_one) > 0)
    links = F.filter(fact("links"), lambda x: x["type"] == "canonical")
    relative = first(F.filter(links, lambda x: x["path_type"] != "absolute"))
    fragment = first(F.filter(links, lambda x: x["raw"].contains("#")))
    bad = fact("canonical_invalid_attrs")
    return [
        found("canonical_missing", on & (F.size(every_one) == 0) & col("indexable") & g["H"]),
        found("canonical_canonicalised", some & (col("indexability_status") == "Canonicalised"), first(every_one)),
        found("canonical_multiple", some & (F.size(every_one) > 1)),
        found("canonical_multiple_conflicting", some & (F.size(F.array_distinct(every_one)) > 1)),
        found("canonical_outside_head", some & (fact("canonical_outside_head") > 0)),
        found("canonical_relative", some & relative.isNotNull(), relative["raw"]),
        found("canonical_contains_fragment", some & fragment.isNotNull(), fragment["raw"]),
        found("canonical_invalid_attribute", some & (F.size(bad) > 0), F.array_join(bad, ", ")),
    ]


def annotation_rules(on: Column) -> tuple[list[Column], list[Column]]:
    """Pagination and hreflang rules of the page by itself."""
    nexts, prevs = F.concat(fact("next_html"), fact("next_http")), F.concat(fact("prev_html"), fact("prev_http"))
    anchors = F.transform(F.filter(fact("links"), lambda x: (x["type"] == "hyperlink") & (x["url"] != "")), lambda x: x["url"])
    targets = F.filter(F.array_distinct(F.concat(nexts, prevs)), lambda t: (t != "") & (t != col("url")))
    entries = F.concat(fact("hreflang_html"), fact("hreflang_http"))
    pairs = F.array_distinct(F.transform(entries, lambda h: F.struct(F.lower(h["lang"]).alias("lang"), h["url"].alias("url"))))
    codes = F.transform(pairs, lambda p: p["lang"])
    repeated = F.filter(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)) > 1)
    canonical = first(F.concat(fact("canonical_html"), fact("canonical_http")))
    own = F.exists(entries, lambda h: h["url"] == col("url"))
    single = [
        found("pagination_multiple", on & ((F.size(nexts) > 1) | (F.size(prevs) > 1)), F.concat(F.size(nexts).cast("string"), F.lit(" next, "), F.size(prevs).cast("string"), F.lit(" prev"))),
        found("hreflang_not_using_canonical", on & own & (canonical != "") & (canonical != col("url")), canonical),
    ]
    return single, [every("pagination_not_in_anchor", on, F.array_except(targets, anchors)), every("hreflang_multiple_entries", on, repeated)]


def structured_rules(g: dict[str, Column], cfg: Config) -> tuple[list[Column], list[Column]]:
    asked = cfg.structured_jsonld or cfg.structured_microdata or cfg.structured_rdfa
    single = [found("structured_missing", g["PFE"] & F.lit(asked) & g["H"] & (F.coalesce(F.size("structured.formats"), F.lit(0)) <= 0))]
    names = {"structured_parse_error": "parse_errors", "structured_invalid_recovered": "recovered", "structured_validation_error": "errors", "structured_validation_warning": "warnings"}
    return single, [every(issue, g["PF"] & col("structured").isNotNull(), F.col(f"structured.{field}")) for issue, field in names.items()]


def javascript_rules(on: Column) -> list[Column]:
    on = on & col("jsdiff").isNotNull()
    d = lambda name: F.col(f"jsdiff.{name}")
    return [
        found("js_noindex_only_raw", on & d("noindex_only_raw")),
        found("js_canonical_mismatch", on & d("canonical_changed"), d("rendered_canonical")),
        found("js_title_updated", on & d("title_changed"), d("rendered_title")),
        found("js_description_updated", on & d("description_changed")),
        found("js_h1_updated", on & d("h1_changed")),
        found("js_contains_links", on & (d("js_links") > 0), F.concat(d("js_links").cast("string"), F.lit(" rendered-only links"))),
        found("js_structured_data_only", on & (F.size(d("structured_js_only")) > 0), F.array_join(d("structured_js_only"), ", ")),
        found("js_console_errors", on & (F.size(d("console_errors")) > 0), F.array_join(d("console_errors"), "; ")),
    ]


def validation_rules(g: dict[str, Column]) -> list[Column]:
    on = g["PF"] & g["H"]
    flags = ("missing_head", "multiple_head", "missing_body", "multiple_body", "body_before_html", "head_not_first")
    bad = fact("head.invalid_elements_in_head")
    charset = fact("has_charset") | F.coalesce(col("content_type"), F.lit("")).contains("charset=") | header("Content-Type").contains("charset=")
    return [
        *[found(f"validation_{f}", on & fact(f"head.{f}")) for f in flags],
        found("validation_invalid_head_elements", on & (F.size(bad) > 0), F.array_join(bad, ", ")),
        found("validation_document_over_2mb", on & (col("size") > MB2), F.concat(col("size").cast("string"), F.lit(" bytes"))),
        found("charset_missing", on & ~charset),
        found("html_lang_missing", on & (fact("lang") == "")),
        found("hreflang_outside_head", on & (fact("hreflang_outside_head") > 0)),
        found("viewport_missing", g["PFE"] & g["H"] & ~fact("has_viewport")),
    ]


def amp_rules(on: Column) -> list[Column]:
    on = on & fact("is_amp")
    return [
        found("amp_missing_canonical", on & (F.size(fact("canonical_html")) + F.size(fact("canonical_http")) == 0)),
        found("amp_missing_viewport", on & ~fact("has_viewport")),
        found("amp_missing_charset", on & ~fact("has_charset")),
        found("amp_missing_script", on & ~fact("has_amp_script")),
        found("amp_indexable", on & col("indexable") & (first(fact("canonical_html")) != col("url"))),
    ]


def directive_rules(on: Column) -> tuple[list[Column], list[Column]]:
    parts = F.flatten(F.transform(F.concat(fact("meta_robots"), fact("x_robots_tag")), lambda v: F.transform(F.split(v, ","), lambda p: F.trim(p))))
    tokens = F.transform(parts, lambda p: F.trim(F.substring_index(F.lower(p), ":", 1)))
    dated = F.filter(parts, lambda p: F.trim(F.substring_index(F.lower(p), ":", 1)) == "unavailable_after")
    values = F.transform(dated, lambda p: F.when(p.contains(":"), F.trim(F.regexp_replace(p, "^[^:]*:", ""))).otherwise(""))
    single = [found("directive_outside_head", on & (fact("meta_robots_outside_head") > 0))]
    single += [found(f"directive_{d}", on & F.array_contains(tokens, d)) for d in DIRECTIVES]
    return single, [every("directive_unavailable_after", on, values)]


def form_rules(on: Column) -> tuple[list[Column], list[Column]]:
    actions = F.transform(fact("forms"), lambda f: f["action"])
    plain = ~col("url").startswith("https://")
    single = [
        found("security_http_url", on & plain & is_html(col("content_type"))),
        found("security_form_on_http", on & plain & (F.size(fact("forms")) > 0)),
    ]
    return single, [every("security_form_url_insecure", on, F.filter(actions, lambda a: a.startswith("http://")))]


def row_issues(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Issues that a page's own row decides."""
    g = gates(cfg)
    single, many = [], []
    single += response_rules() + url_rules(col("url"), g["P"] & g["H"], cfg) + header_rules(g["P"]) + size_rules(g, cfg)
    single += element_rules(g["PFE"], cfg) + content_rules(g["PFE"], cfg) + canonical_rules(g) + javascript_rules(g["PF"]) + validation_rules(g) + amp_rules(g["PF"])
    for more in (annotation_rules(g["PF"]), structured_rules(g, cfg), directive_rules(g["PF"]), form_rules(g["PF"])):
        single += more[0]
        many += more[1]
    depth = F.concat(F.lit("depth "), col("depth").cast("string"))
    single.append(found("links_high_crawl_depth", g["PF"] & g["H"] & (col("depth") > cfg.thresholds.high_crawl_depth), depth))
    return exploded(pages, single, many)


def targets(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("url").alias("to"), F.col("scope").alias("to_scope"), F.col("state").alias("to_state"), F.col("status_code").alias("to_code"), F.col("indexable").alias("to_indexable"),
        F.col("indexability_status").alias("to_status"), F.col("size").alias("to_size"), F.col("content_type").alias("to_type"),
    )


def links_of(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Links of internal crawled pages with what is known of their targets; external follows the target's record, then hosts."""
    g = gates(cfg)
    rows = pages.where(g["PF"]).select("url", "content_type", "indexable", F.posexplode("facts.links").alias("place", "l"))
    rows = rows.select("*", F.col("l.url").alias("to"))
    joined = rows.join(targets(pages), "to", "left")
    other = F.coalesce(F.col("to_scope") == "external", urls.host(F.col("to")) != urls.host(F.col("url")))
    return joined.withColumn("external", other)


def link_issues(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Issues of single links, and of pages by their links."""
    rows, t = links_of(pages, cfg), cfg.thresholds
    kind, https = F.col("l.type"), col("url").startswith("https://")
    resource = kind.isin("image", "css", "js", "media")
    hyper, image = kind == "hyperlink", (kind == "image") & F.lit(cfg.images_store)
    inner = hyper & ~F.col("external")
    to, rel = F.col("to"), F.coalesce(F.col("l.rel"), F.lit(""))
    anchor = F.lower(F.trim(F.coalesce(F.col("l.anchor"), F.lit(""))))
    alt = F.coalesce(F.col("l.alt"), F.lit(""))
    bare = (anchor == "") & (alt == "")
    single = [
        found("security_mixed_content", resource & https & to.startswith("http://"), to),
        found("security_protocol_relative", resource & (F.col("l.path_type") == "protocol_relative"), to),
        found("security_unsafe_cross_origin", hyper & (F.col("l.target") == "_blank") & F.col("external") & ~rel.contains("noopener") & ~rel.contains("noreferrer"), to),
        found("links_to_localhost", hyper & urls.host(to).isin("localhost", "127.0.0.1"), to),
        found("links_internal_nofollow_outlinks", inner & F.col("l.nofollow"), to),
        found("links_no_anchor_text", inner & bare, to),
        found("links_non_descriptive_anchor", inner & ~bare & anchor.isin(*t.non_descriptive_anchors), F.col("l.anchor")),
        found("links_outlinks_to_broken", inner & (F.col("to_code") >= 400), to),
        found("links_outlinks_to_redirect", inner & F.col("to_code").between(300, 399), to),
        found("image_missing_alt_attribute", image & F.col("l.no_alt_attr"), to),
        found("image_missing_alt", image & ~F.col("l.no_alt_attr") & (F.trim(alt) == ""), to),
        found("image_alt_over_chars", image & ~F.col("l.no_alt_attr") & (F.length(alt) > t.image_alt_max_chars), to),
        found("image_missing_size_attributes", image & ((F.coalesce(F.col("l.width"), F.lit("")) == "") | (F.coalesce(F.col("l.height"), F.lit("")) == "")), to),
    ]
    of_links = exploded(rows, single)
    large = rows.where(image & (F.col("to_size") > t.image_max_kb * 1024)).select(to.alias("url"), F.lit("image_over_size").alias("issue"), F.concat(F.expr("to_size div 1024").cast("string"), F.lit(" KB")).alias("detail"))
    counts = rows.groupBy("url").agg(F.count_if(inner).alias("n_in"), F.count_if(hyper & F.col("external")).alias("n_out"), F.count_if(kind == "uncrawlable").alias("n_bad"))
    g = gates(cfg)
    counted = pages.where(g["PF"]).select("url", "content_type").join(counts, "url", "left").na.fill(0, ["n_in", "n_out", "n_bad"])
    html = is_html(col("content_type"))
    of_pages = exploded(counted, [
        found("links_uncrawlable_outlinks", col("n_bad") > 0, F.concat(col("n_bad").cast("string"), F.lit(" uncrawlable outlinks"))),
        found("links_no_internal_outlinks", html & (col("n_in") == 0)),
        found("links_high_internal_outlinks", html & (col("n_in") > t.high_internal_outlinks), col("n_in").cast("string")),
        found("links_high_external_outlinks", html & F.lit(cfg.links.external_store) & (col("n_out") > t.high_external_outlinks), col("n_out").cast("string")),
    ])
    return of_links.union(large).union(of_pages)


def target_issues(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Issues that depend on the page that a redirect, canonical, pagination or AMP link points to."""
    g, to = gates(cfg), targets(pages)
    answered = ~col("state").isin("blocked_robots", "error")
    redirects = pages.where((col("scope") == "internal") & answered & col("status_code").between(300, 399)).select("url", F.col("redirect_url").alias("to")).join(to, "to")
    broken = exploded(redirects, [found("redirect_broken", col("to_code") >= 400, col("to"))])
    canonical = pages.where(g["PF"]).select("url", first(F.concat(fact("canonical_html"), fact("canonical_http"))).alias("to")).where("to <> url").join(to, "to")
    canon = exploded(canonical, [
        found("canonical_non_indexable_target", ~F.coalesce(col("to_indexable"), F.lit(False)), col("to")),
        found("canonical_to_redirect", col("to_code").between(300, 399), col("to")),
    ])
    lists = F.array_distinct(F.concat(fact("next_html"), fact("next_http"), fact("prev_html"), fact("prev_http")))
    paged = pages.where(g["PF"]).select("url", F.explode(lists).alias("to")).where("to <> url AND to <> ''").join(to, "to")
    pagination = exploded(paged, [found("pagination_non_indexable", (col("to_state") == "crawled") & (col("to_code") == 200) & ~F.coalesce(col("to_indexable"), F.lit(False)), col("to"))])
    back = pages.where("facts IS NOT NULL").select(F.col("url").alias("to"), F.col("facts.canonical_html").alias("back"))
    amp = pages.where(g["PF"]).select("url", F.explode("facts.amp_links").alias("to")).join(back, "to")
    returns = exploded(amp, [found("amp_missing_return_link", ~F.array_contains("back", col("url")), col("to"))])
    return reduce(DataFrame.union, (broken, canon, pagination, returns))


def duplicate_issues(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pages that share a body hash, title, description, or one of their first two h1s or h2s.

    Groups are counted first; only the keys seen twice are joined back, so that a hot key is a skewed join that AQE splits.
    """
    g = gates(cfg)
    rows = pages.where(g["PFE"] & g["H"])
    if cfg.advanced.ignore_paginated_for_duplicates:
        rows = rows.where((F.size(fact("prev_html")) == 0) & (F.size(fact("prev_http")) == 0))
    pair = lambda issue, key: F.struct(F.lit(issue).alias("issue"), key.alias("detail"))
    both = lambda issue, hs: F.transform(F.slice(hs, 1, 2), lambda h: F.struct(F.lit(issue).alias("issue"), h.alias("detail")))
    kinds = F.concat(
        F.array(pair("content_exact_duplicate", fact("hash")), pair("title_duplicate", first(fact("titles"))), pair("description_duplicate", first(fact("descriptions")))),
        both("h1_duplicate", fact("h1s")), both("h2_duplicate", fact("h2s")),
    )
    keyed = rows.select("url", F.explode(kinds).alias("k")).select("url", "k.issue", "k.detail").where("detail <> ''")
    shared = keyed.groupBy("issue", "detail").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(shared, ["issue", "detail"]).select("url", "issue", "detail")


def inlink_issues(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Issues of pages by the links that lead to them; links to oneself don't count."""
    g = gates(cfg)
    links = pages.where(g["PF"]).select(F.col("url").alias("src"), "indexable", F.explode("facts.links").alias("l")).where("l.type = 'hyperlink' AND l.url <> '' AND l.url <> src")
    counts = links.groupBy(F.col("l.url").alias("url")).agg(F.count("*").alias("total"), F.count_if("l.nofollow").alias("nofollow"), F.count_if("indexable").alias("good"))
    canon = pages.where(g["PF"]).select(F.col("url").alias("src"), F.explode(F.concat(fact("canonical_html"), fact("canonical_http"))).alias("url")).where("url <> '' AND url <> src")
    referred = canon.groupBy("url").agg(F.min("src").alias("referrer"))
    rows = pages.where(g["PF"] & g["H"]).select("url", "indexable").join(counts, "url", "left").join(referred, "url", "left")
    total, nofollow = F.coalesce("total", F.lit(0)), F.coalesce("nofollow", F.lit(0))
    return exploded(rows, [
        found("links_nofollow_inlinks_only", (total > 0) & (nofollow == total)),
        found("links_follow_nofollow_inlinks", (nofollow > 0) & (nofollow < total), F.concat((total - nofollow).cast("string"), F.lit(" follow / "), nofollow.cast("string"), F.lit(" nofollow"))),
        found("links_only_non_indexable_inlinks", (total > 0) & col("indexable") & (F.coalesce("good", F.lit(0)) == 0)),
        found("canonical_unlinked", col("referrer").isNotNull() & (total == 0), col("referrer")),
    ])


def evaluate(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All checks that pages alone decide: (url, issue, detail), distinct."""
    parts = (row_issues, link_issues, target_issues, duplicate_issues, inlink_issues)
    return reduce(DataFrame.union, [p(pages, cfg) for p in parts]).dropDuplicates(["url", "issue", "detail"])
