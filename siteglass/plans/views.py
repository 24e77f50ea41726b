"""Named datasets, reports and summaries over pages, links and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.functions.text import DESCRIPTION_PX, TITLE_PX, pixel_width
from siteglass.operators import graph
from siteglass.operators.catalogue import catalogue, entries

RANK = {"issue": 0, "warning": 1, "opportunity": 2}
URGENCY = {"high": 0, "medium": 1, "low": 2}


def first(name: str) -> Column:
    return F.coalesce(F.get(F.col(f"facts.{name}"), F.lit(0)), F.lit(""))


def indexability() -> Column:
    return F.when(F.col("indexable"), "indexable").otherwise("non-indexable").alias("indexability")


def one_decimal(value: Column) -> Column:
    """As printf %.1f prints a double: the exact binary value, rounded half to even."""
    exact = F.coalesce(value, F.lit(0.0)).cast("decimal(38,18)")
    return F.bround(exact, 1).cast("decimal(18,1)").cast("string")


def tab(pages: DataFrame, name: str, issues: DataFrame | None = None, issue: str = "") -> DataFrame:
    """A page tab ordered by URL, its values as strings; with an issue only the URLs it affects (hreflang ignores it)."""
    if issue and name != "hreflang":
        pages = pages.join(issues.where(F.col("issue") == issue).select("url"), "url", "left_semi")
    if name == "response_codes":
        return as_strings(pages.select("url", "scope", "state", "status_code", "status", "redirect_url", "redirect_type", "fetch_error")).orderBy("url")
    with_facts = pages.where("facts IS NOT NULL")
    status = F.coalesce("indexability_status", F.lit("")).alias("indexability_status")
    if name in ("internal", "external"):
        rows = pages.where(F.col("scope") == "internal") if name == "internal" else pages.where(F.col("scope") != "internal")
        out = rows.select(
            "url", "status_code", "status", "content_type", "http_version", indexability(), status, F.coalesce(F.col("depth").cast("string"), F.lit("")).alias("depth"), "inlinks",
            "unique_inlinks", "unique_outlinks", one_decimal(F.col("link_score")).alias("link_score"), "response_time_ms", "size", first("titles").alias("title"),
            first("descriptions").alias("meta_description"), first("h1s").alias("h1"), F.coalesce("facts.word_count", F.lit(0)).alias("word_count"),
            first("canonical_html").alias("canonical"), "redirect_url", "redirect_type",
        )
    elif name in ("titles", "descriptions"):
        text, px = (first(name), TITLE_PX) if name == "titles" else (first(name), DESCRIPTION_PX)
        out = with_facts.select("url", text.alias(name[:-1]), F.length(text).alias("length"), pixel_width(text, px).alias("pixel_width"), F.size(f"facts.{name}").alias("count"), status)
    elif name == "h1":
        out = with_facts.select("url", first("h1s").alias("h1"), F.length(first("h1s")).alias("length"), F.size("facts.h1s").alias("count"), status)
    elif name == "canonicals":
        canonical = F.when(first("canonical_html") != "", first("canonical_html")).otherwise(first("canonical_http"))
        out = with_facts.select("url", canonical.alias("canonical"), (F.size("facts.canonical_html") + F.size("facts.canonical_http")).alias("count"), indexability(), status)
    elif name == "images":
        out = pages.where(F.col("content_type").startswith("image/")).select("url", "content_type", F.expr("size div 1024").alias("size_kb"), "inlinks")
    elif name == "security":
        out = with_facts.where("scope = 'internal'").select("url", F.when(F.col("url").startswith("http://"), "http").otherwise("https").alias("scheme"), "status_code", status)
    elif name == "hreflang":
        out = with_facts.select("url", F.posexplode(F.concat("facts.hreflang_html", "facts.hreflang_http")).alias("place", "h")).select("url", "h.lang", F.col("h.url").alias("target"), "place")
        return out.orderBy("url", "place").drop("place")
    else:
        raise ValueError(f"unknown tab {name!r}")
    return as_strings(out).orderBy("url")


def as_strings(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def issues_tab(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """Issues with severity, priority and tab. The catalogue has 175 rows, so it is broadcast."""
    return issues.join(F.broadcast(catalogue(spark)), "issue", "left").select("url", "issue", "severity", "priority", "tab", "detail").orderBy("issue", "url")


def link_rows(pages: DataFrame) -> DataFrame:
    links = pages.where("facts IS NOT NULL").select(F.col("url").alias("src"), F.explode("facts.links").alias("l"))
    return links.select("src", F.col("l.url").alias("dst"), "l.type", "l.anchor", "l.alt", "l.nofollow", "l.rel", "l.target", "l.path_type", "l.elem_path", "l.position")


def links_tab(pages: DataFrame) -> DataFrame:
    rows = link_rows(pages).withColumnsRenamed({"src": "source", "dst": "destination"}).drop("elem_path")
    return rows.orderBy("source", "destination")


def custom_tab(results: DataFrame) -> DataFrame:
    return results.select("url", "kind", "name", "value").orderBy("name", "url")


def issue_counts(issues: DataFrame) -> DataFrame:
    """URLs by issue; (url, issue) pairs are made distinct first, so that a hot issue is spread over tasks."""
    return issues.select("issue", "url").distinct().groupBy("issue").agg(F.count("*").alias("n"))


def ranked(rows: DataFrame) -> DataFrame:
    case = lambda name, ranks: F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[F.col(name)]
    return rows.orderBy(case("severity", RANK), case("priority", URGENCY), F.desc("n"), "issue")


def issue_summary(spark: SparkSession, issues: DataFrame) -> DataFrame:
    return ranked(issue_counts(issues).join(F.broadcast(catalogue(spark)), "issue").select("issue", "tab", "severity", "priority", "n"))


def catalogue_counts(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """Every check with its count, zero where nothing was found."""
    return catalogue(spark).join(issue_counts(issues), "issue", "left").na.fill(0, ["n"])


def top_issues(spark: SparkSession, issues: DataFrame, most: int = 8) -> DataFrame:
    """The checks with most URLs: by severity, then count; ties in the catalogue's order."""
    place = {row[0]: i for i, row in enumerate(entries())}
    rows = catalogue_counts(spark, issues).where("n > 0")
    order = F.create_map(*[x for name, i in place.items() for x in (F.lit(name), F.lit(i))])[F.col("issue")]
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")]
    return rows.orderBy(rank, F.desc("n"), order).limit(most)


def dataset_counts(pages: DataFrame, issues: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(dataset, n): rows of each tab. Those of pages are counted in one pass."""
    facts, inside = F.col("facts").isNotNull(), F.col("scope") == "internal"
    with_facts = ("titles", "descriptions", "h1", "canonicals")
    sizes = {
        "internal": F.count_if(inside), "external": F.count_if(~inside), "response_codes": F.count("*"), **{name: F.count_if(facts) for name in with_facts}, "images": F.count_if(F.col("content_type").startswith("image/")),
        "security": F.count_if(facts & inside), "hreflang": F.sum(F.when(facts, F.size("facts.hreflang_html") + F.size("facts.hreflang_http"))), "links": F.sum(F.when(facts, F.size("facts.links"))),
    }
    one = pages.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in sizes.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dataset"), F.col(k).alias("n")) for k in sizes])).alias("x")).select("x.*")
    for name, rows in (("issues", issues), ("custom", custom)):
        if rows is not None:
            out = out.union(rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("n")))
    return out


def limited(name: str, rows: DataFrame, limit: int = 0) -> dict:
    """A dataset as a client gets it: header, rows up to the limit if there is one, all rows' number, and whether some are left out."""
    total = rows.count()
    some = rows.limit(limit) if limit > 0 else rows
    return {"name": name, "header": rows.columns, "rows": [list(r) for r in some.collect()], "total": total, "truncated": 0 < limit < total}


def overview(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """crawl_overview: (metric, count) by metric."""
    crawled = F.col("state") == "crawled"
    keys = F.array(
        F.lit("total"), F.concat(F.lit("scope:"), "scope"), F.concat(F.lit("state:"), "state"),
        F.when(F.col("status_code") > 0, F.concat(F.lit("status:"), F.expr("status_code div 100").cast("string"), F.lit("xx"))),
        F.when(crawled & F.col("indexable"), "indexable").when(crawled, "non-indexable"),
    )
    counts = pages.select(F.explode(keys).alias("metric")).where("metric IS NOT NULL").groupBy("metric").agg(F.count("*").alias("count"))
    found = issue_counts(issues).select(F.concat(F.lit("issue:"), "issue").alias("metric"), F.col("n").alias("count"))
    return counts.union(found).orderBy("metric")


def by_prefix(issues: DataFrame, prefix: str) -> DataFrame:
    return issues.where(F.col("issue").startswith(prefix)).select("url", "issue", "detail").orderBy("url")


def report(spark: SparkSession, name: str, pages: DataFrame, issues: DataFrame) -> DataFrame:
    if name == "crawl_overview":
        return overview(pages, issues)
    if name in ("redirect_chains", "canonical_chains"):
        steps = graph.redirect_steps(pages) if name == "redirect_chains" else graph.canonical_steps(pages)
        rows = graph.chains(spark, steps, pages)
        return rows.select("source", F.col("n_hops").alias("hops"), F.array_join("hops", " -> ").alias("chain"), "final", "final_status", "loop").orderBy("source")
    if name == "insecure_content":
        return by_prefix(issues, "security_")
    if name == "orphan_pages":
        return by_prefix(issues, "sitemap_orphan")
    if name == "crawl_paths":
        return graph.crawl_paths(spark, pages).orderBy("url")
    raise ValueError(f"unknown report {name!r}")


def page_detail(pages: DataFrame, url: str, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """The first links of a page in document order, and links to it, one from each other page."""
    out = pages.where(F.col("url") == url).select(F.posexplode("facts.links").alias("place", "l")).orderBy("place").limit(most).select("l.*")
    to = link_rows(pages).where((F.col("dst") == url) & (F.col("src") != url) & (F.col("type") == "hyperlink"))
    return out, to.dropDuplicates(["src"]).orderBy("src").limit(most)


def dashboard(pages: DataFrame) -> DataFrame:
    """One row: status classes without blocked and failed pages, shares over internal pages, mean link score over 0."""
    answered = ~F.col("state").isin("blocked_robots", "error")
    inside = F.col("scope") == "internal"
    code = lambda k: F.count_if(answered & (F.expr("status_code div 100") == k)).alias(f"status_{k}xx")
    return pages.agg(
        F.count("*").alias("total"), F.count_if(inside).alias("internal"), *[code(k) for k in (2, 3, 4, 5)], F.count_if(F.col("state") == "blocked_robots").alias("blocked"),
        F.count_if(F.col("state") == "error").alias("errors"), F.count_if(inside & F.col("indexable")).alias("indexable"), F.count_if(inside & ~F.col("indexable")).alias("non_indexable"),
        F.avg(F.when(inside & (F.col("link_score") > 0), F.col("link_score"))).alias("avg_link_score"),
    )
