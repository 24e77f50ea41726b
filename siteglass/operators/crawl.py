"""A crawl's page table from fetched pages: facts, indexability, inlinks, depth and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass import schemas
from siteglass.config import DEFAULT, Config
from siteglass.functions import indexability
from siteglass.operators import graph, neardup, structured
from siteglass.sources import html
from siteglass.storage import stored


def defaulted(rows: DataFrame) -> DataFrame:
    """Rows with every column of a page, in order; what is absent gets its blank."""
    blanks: dict[str, Column] = {
        "scope": F.lit("internal"), "state": F.lit("crawled"), "status_code": F.lit(200), "status": F.lit("OK"), "content_type": F.lit("text/html; charset=utf-8"), "http_version": F.lit("HTTP/1.1"),
        "response_time_ms": F.lit(0), "fetch_error": F.lit(""), "redirect_url": F.lit(""), "redirect_type": F.lit(""), "matched_robots_line": F.lit(0), "indexability_status": F.lit(""), "inlinks": F.lit(0),
        "discovered_from": F.lit(""), "outside_start_folder": F.lit(False), "duplicate_of": F.lit(""), "link_score": F.lit(0.0), "unique_inlinks": F.lit(0), "unique_outlinks": F.lit(0),
        "closest_similarity": F.lit(0.0), "near_dup_count": F.lit(0), "size": F.lit(0), "headers": F.create_map().cast("map<string,string>"), "indexable": F.lit(True),
    }
    out, types = [], rows.sparkSession.createDataFrame([], schemas.PAGES).schema
    for field in types.fields:
        name = field.name
        value = F.col(name) if name in rows.columns else blanks.get(name, F.lit(None))
        out.append(value.cast(field.dataType).alias(name))
    return rows.select(*out)


def assemble(spark: SparkSession, fetched: DataFrame, cfg: Config = DEFAULT, store: bool = False, hierarchy: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The page table of fetched pages (url, html and any page columns): parsed once, then judged by expressions.

    With ``store`` the table is written to the shared folder, so that what branches from it doesn't parse again.
    """
    base = fetched.withColumn("size", F.octet_length(F.coalesce("html", F.lit("")))) if "size" not in fetched.columns else fetched
    base = base if "headers" in base.columns else base.withColumn("headers", F.create_map().cast("map<string,string>"))
    keep = (*(c for c in base.columns if c not in ("url", "html", "headers")),)
    types = structured.Types(structured.parse_hierarchy(structured.HIERARCHY) if hierarchy is None else hierarchy)
    asked = (cfg.structured_jsonld, cfg.structured_microdata, cfg.structured_rdfa)
    more = {"structured": (schemas.STRUCTURED, lambda tree: structured.structured_of(tree, types, *asked))} if any(asked) else {}
    rows = html.extract(base.withColumn("page_headers", F.col("headers")), cfg, (*keep, "page_headers"), more).withColumnRenamed("page_headers", "headers")
    pages = defaulted(rows)
    reason = indexability.status(
        F.col("url"), F.col("status_code"), F.col("fetch_error"), F.col("state") == "blocked_robots", F.col("facts.meta_refresh_url"), F.col("facts.meta_robots"),
        F.col("facts.x_robots_tag"), F.concat("facts.canonical_html", "facts.canonical_http"), cfg.robots_user_agent, cfg.advanced.respect_self_referencing_meta_refresh,
    )
    crawled = F.col("state") == "crawled"
    pages = pages.withColumn("indexability_status", F.when(crawled, reason).otherwise(""))
    pages = pages.withColumn("indexable", crawled & (F.col("indexability_status") == ""))
    return stored(spark, pages, "pages")[0] if store else pages


def inlinks(pages: DataFrame) -> DataFrame:
    """(url, inlinks): occurrences of hyperlinks to it."""
    links = pages.where("facts IS NOT NULL").select(F.explode("facts.links").alias("l")).where("l.type = 'hyperlink' AND l.url <> ''")
    return links.groupBy(F.col("l.url").alias("url")).agg(F.count("*").cast("int").alias("inlinks"))


def finalized(spark: SparkSession, pages: DataFrame, seeds: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Pages with inlinks, depth, unique degrees, link scores and near duplicates recomputed over the whole table."""
    edges = graph.page_edges(pages)
    redirects = graph.redirect_steps(pages).toDF("src", "dst")
    starts = spark.createDataFrame([(s,) for s in seeds], "node string")
    depth = graph.depths(spark, starts, edges.union(redirects)).withColumnsRenamed({"node": "url"})
    degree = graph.degrees(edges).withColumnsRenamed({"node": "url", "unique_in": "unique_inlinks", "unique_out": "unique_outlinks"})
    out = pages.drop("inlinks", "depth", "unique_inlinks", "unique_outlinks", "link_score", "closest_similarity", "near_dup_count")
    for more in (inlinks(pages), depth, degree, graph.link_scores(spark, pages)):
        out = out.join(more, "url", "left")
    near = neardup.near_duplicates(neardup.page_texts(pages, cfg.content.near_duplicate_indexable_only), cfg.content.near_duplicate_threshold) if cfg.content.near_duplicates else None
    if near is not None:
        out = out.join(near.select("url", F.col("closest").alias("closest_similarity"), F.col("n").alias("near_dup_count")), "url", "left")
    out = out.na.fill(0, [c for c in ("inlinks", "unique_inlinks", "unique_outlinks", "link_score", "closest_similarity", "near_dup_count") if c in out.columns])
    return defaulted(out)


def raw_rendered_diff(raw: DataFrame, rendered: DataFrame, console: DataFrame | None = None) -> DataFrame:
    """(url, jsdiff) of the facts of the delivered and the rendered html, both (url, facts and, if there, structured).

    Errors of the console are given as (url, error). Structured types that only the rendered page has are listed.
    """
    none = F.array().cast("array<string>")
    types = lambda side: F.coalesce(F.col(f"{side}t.types"), none)
    with_types = lambda rows, side: rows.select("url", F.col("facts").alias(side), (F.col("structured") if "structured" in rows.columns else F.lit(None).cast("struct<types:array<string>>")).alias(f"{side}t"))
    first = lambda side, name: F.coalesce(F.get(F.col(f"{side}.{name}"), F.lit(0)), F.lit(""))
    changed = lambda name: first("r", name) != first("d", name)
    links = lambda side: F.transform(F.filter(F.col(f"{side}.links"), lambda x: x["type"] == "hyperlink"), lambda x: x["url"])
    both = with_types(raw, "r").join(with_types(rendered, "d"), "url")
    said = console.groupBy("url").agg(F.array_sort(F.collect_set("error")).alias("said")) if console is not None else None
    both = both.join(said, "url", "left") if said is not None else both.withColumn("said", F.lit(None).cast("array<string>"))
    noindex = lambda side: indexability.has_noindex(F.col(f"{side}.meta_robots"))
    return both.select(
        "url",
        F.struct(
            F.col("d.word_count").alias("rendered_word_count"), (F.col("d.word_count") - F.col("r.word_count")).alias("word_count_change"), changed("titles").alias("title_changed"),
            changed("descriptions").alias("description_changed"), changed("h1s").alias("h1_changed"), changed("canonical_html").alias("canonical_changed"),
            (noindex("r") & ~noindex("d")).alias("noindex_only_raw"), first("d", "titles").alias("rendered_title"), first("d", "canonical_html").alias("rendered_canonical"),
            F.size(F.array_except(links("d"), links("r"))).alias("js_links"), F.coalesce("said", none).alias("console_errors"), F.array_except(types("d"), types("r")).alias("structured_js_only"),
        ).alias("jsdiff"),
    )


