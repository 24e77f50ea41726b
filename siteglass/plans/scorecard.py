"""Scores of crawls of several sites, where their settings diverge, and which crawls compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteglass.functions import urls
from siteglass.operators.catalogue import catalogue

DIMENSIONS = ("rendering", "max_depth", "max_urls", "robots")


def scores(spark: SparkSession, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each site of pages (site, ...) and issues (site, url, issue)."""
    crawled = F.col("state") == "crawled"
    by_site = pages.groupBy("site").agg(
        F.count("*").alias("urls"), F.count_if(crawled).alias("crawled"), F.count_if("indexable").alias("indexable"), F.count_if(F.col("near_dup_count") > 0).alias("near_dup"),
        F.avg("link_score").alias("avg_link_score"), *[F.count_if(F.expr("status_code div 100") == k).alias(f"status_{k}xx") for k in (1, 2, 3, 4, 5)],
        F.avg("facts.word_count").alias("avg_word_count"), F.avg("facts.flesch").alias("avg_flesch"), F.count_if(F.size("structured.types") > 0).alias("typed"),
    )
    rated = issues.select("site", "issue", "url").distinct().groupBy("site", "issue").agg(F.count("*").alias("n")).join(F.broadcast(catalogue(spark)), "issue")
    total = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0))
    rated = rated.groupBy("site").agg(total("issue").alias("errors"), total("warning").alias("warnings"), total("opportunity").alias("opportunities"))
    out = by_site.join(rated, "site", "left").na.fill(0, ["errors", "warnings", "opportunities"])
    share = lambda c: F.when(F.col("crawled") > 0, F.col(c) / F.col("crawled"))
    return out.withColumns({"indexable_rate": F.coalesce(share("indexable"), F.lit(0.0)), "schema_coverage": share("typed")}).drop("typed", "indexable")


def divergence(sites: DataFrame) -> DataFrame:
    """(dimension) of settings in which scored sites (status, rendering, ...) differ; none for fewer than two."""
    seen = sites.where("status = 'ok'").agg(*[F.count_distinct(F.coalesce(F.col(d).cast("string"), F.lit(""))).alias(d) for d in DIMENSIONS])
    return seen.select(F.explode(F.array(*[F.when(F.col(d) > 1, d) for d in DIMENSIONS])).alias("dimension")).where("dimension IS NOT NULL")


def history(crawls: DataFrame) -> DataFrame:
    """Crawls (id, seed, mode, status, narrowed, started) with site, comparable and the reason if not."""
    path = urls.path_of(F.col("seed"))
    reason = (
        F.when(F.col("mode") == "list", "list crawl")
        .when(~path.isin("", "/"), "path-scoped seed")
        .when(F.col("status") == "running", "running")
        .when(F.col("status") != "completed", "unfinished")
        .when(F.col("narrowed"), "scope-narrowed")
        .otherwise("")
    )
    return crawls.withColumn("site", urls.authority(F.trim("seed"))).withColumn("reason", reason).withColumn("comparable", F.col("reason") == "")


def latest_pairs(crawls: DataFrame) -> DataFrame:
    """(site, curr, prev) of the newest two comparable crawls of each site."""
    newest = Window.partitionBy("site").orderBy(F.desc("started"), F.desc("id"))
    rows = history(crawls).where("comparable").withColumn("n", F.row_number().over(newest)).where("n <= 2")
    return rows.groupBy("site").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("curr"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("prev"))
