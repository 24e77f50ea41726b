"""One crawl against another: pages and issues that came and went, and elements that changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.config import DEFAULT, Config
from siteglass.functions import urls
from siteglass.operators.neardup import with_similarity


def mapped_pages(prev: DataFrame, mappings: tuple[tuple[str, str], ...]) -> DataFrame:
    """Pages under mapped URLs; where several meet, the one with the least old URL stays."""
    if not mappings:
        return prev
    rows = prev.withColumn("old", F.col("url")).withColumn("url", urls.mapped(F.col("url"), mappings))
    keep = rows.groupBy("url").agg(F.min("old").alias("old"))
    return rows.join(keep, ["url", "old"], "left_semi").drop("old")


def page_sets(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """(url, bucket): new or missing pages."""
    new = curr.select("url").join(prev.select("url"), "url", "left_anti").withColumn("bucket", F.lit("new"))
    return new.union(prev.select("url").join(curr.select("url"), "url", "left_anti").withColumn("bucket", F.lit("missing")))


def issue_deltas(prev_pages: DataFrame, curr_pages: DataFrame, prev_issues: DataFrame, curr_issues: DataFrame) -> DataFrame:
    """(issue, url, bucket): added and removed on pages of both crawls, new and missing with the page."""
    p = prev_issues.select("issue", "url").distinct().withColumn("p", F.lit(True))
    c = curr_issues.select("issue", "url").distinct().withColumn("c", F.lit(True))
    both = p.join(c, ["issue", "url"], "full_outer")
    both = both.join(prev_pages.select("url", F.lit(True).alias("was")), "url", "left").join(curr_pages.select("url", F.lit(True).alias("is")), "url", "left")
    now, before = F.col("c").isNotNull(), F.col("p").isNotNull()
    # a URL without a page in either crawl is both new and missing
    buckets = F.array(
        F.when(now & F.col("was").isNull(), "new").when(now & ~before, "added"),
        F.when(before & F.col("is").isNull(), "missing").when(before & ~now, "removed"),
    )
    return both.select("issue", "url", F.explode(F.filter(buckets, lambda b: b.isNotNull())).alias("bucket"))


def element_changes(prev: DataFrame, curr: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(url, element, previous, current) of pages in both crawls."""
    text = lambda e: F.coalesce(e.cast("string"), F.lit(""))
    first = lambda name: text(F.get(F.col(f"facts.{name}"), F.lit(0)))
    types = F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce("structured.types", F.array().cast("array<string>")), lambda t: t != ""))), ", ")

    def side(pages: DataFrame, tag: str) -> DataFrame:
        cols: dict[str, Column] = {
            "crawl_depth": F.coalesce(F.col("depth"), F.lit(-1)).cast("string"), "links": F.coalesce(F.col("inlinks"), F.lit(0)).cast("string"), "structured_data": types,
            "titles": first("titles"), "descriptions": first("descriptions"), "h1": first("h1s"), "word_count": text(F.col("facts.word_count")),
        }
        extra = [F.col("facts").isNotNull().alias(f"{tag}_facts"), F.col("facts.hash").alias(f"{tag}_hash"), F.col("facts.content_text").alias(f"{tag}_text")]
        return pages.select("url", *[c.alias(f"{tag}_{n}") for n, c in cols.items()], *extra)

    both = side(prev, "p").join(side(curr, "c"), "url")
    facts = F.col("p_facts") & F.col("c_facts")
    notes = []
    for name in cfg.change_detection:
        if name != "content":
            on = F.lit(True) if name in ("crawl_depth", "links", "structured_data") else facts
            notes.append(F.when(on & (F.col(f"p_{name}") != F.col(f"c_{name}")), F.struct(F.lit(name).alias("element"), F.col(f"p_{name}").alias("previous"), F.col(f"c_{name}").alias("current"))))
    parts = [both.select("url", F.explode(F.filter(F.array(*notes), lambda x: x.isNotNull())).alias("x")).select("url", "x.*")]
    if "content" in cfg.change_detection:
        differ = with_similarity(both.where(facts & ~((F.col("p_hash") != "") & (F.col("p_hash") == F.col("c_hash")))).select("url", F.col("p_text").alias("a"), F.col("c_text").alias("b")))
        told = F.concat(F.bround("sim", 0).cast("int").cast("string"), F.lit("% similar"))
        parts.append(differ.where(100 - F.col("sim") > cfg.content_change_threshold).select("url", F.lit("content").alias("element"), F.lit("").alias("previous"), told.alias("current")))
    return reduce(DataFrame.union, parts)
