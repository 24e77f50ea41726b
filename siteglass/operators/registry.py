"""The control tables: crawls, the job queue, settings, blobs and hosts that ask for https; each step gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.functions import urls

JOBS = "id string, position bigint, status string, crawl_id string, seed string"


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs (id, seed) behind the last position, in order of id; ids that are there already stay as they are."""
    last = jobs.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    fresh = new.join(jobs.select("id"), "id", "left_anti")
    # position: jobs added with a smaller or equal id, by a count over the few new rows
    ranked = fresh.alias("n").join(fresh.select(F.col("id").alias("other")).alias("o"), F.col("o.other") <= F.col("n.id")).groupBy("id", "seed").agg(F.count("*").alias("k"))
    rows = ranked.join(F.broadcast(last)).select("id", (F.col("last") + F.col("k")).alias("position"), F.lit("queued").alias("status"), F.lit("").alias("crawl_id"), "seed")
    return jobs.select(*rows.columns).union(rows)


def claim(jobs: DataFrame) -> DataFrame:
    """The queued job with the least position becomes running, unless one runs already."""
    state = jobs.agg(F.min(F.when(F.col("status") == "queued", F.col("position"))).alias("first"), F.count_if(F.col("status") == "running").alias("busy"))
    rows = jobs.join(F.broadcast(state))
    mine = (F.col("status") == "queued") & (F.col("position") == F.col("first")) & (F.col("busy") == 0)
    return rows.withColumn("status", F.when(mine, "running").otherwise(F.col("status"))).drop("first", "busy")


def settle(jobs: DataFrame, job: str, status: str, only_from: tuple[str, ...] = ("running",)) -> DataFrame:
    """A job ends as done, failed or cancelled if it is in one of the states it may come from."""
    mine = (F.col("id") == job) & F.col("status").isin(*only_from)
    return jobs.withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def reconcile(jobs: DataFrame) -> DataFrame:
    """After a restart: jobs that ran wait again, at their old position."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def with_crawl(crawls: DataFrame, **values) -> DataFrame:
    """The registry with a new crawl, or with one's values changed if its id is there; columns not given stay or are null."""
    row = crawls.sparkSession.createDataFrame([tuple(values.get(f.name) for f in crawls.schema.fields)], crawls.schema)
    own = F.col("id") == F.lit(values["id"])
    changed = crawls.select(*[F.when(own, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in crawls.schema.fields])
    return changed.union(row.join(crawls.select("id"), "id", "left_anti").select(*crawls.columns))


def without_crawl(crawls: DataFrame, crawl_id: str) -> DataFrame:
    """The registry without a crawl; its folder is the caller's to delete once this is written."""
    return crawls.where(F.col("id") != F.lit(crawl_id))


def crawl_list(crawls: DataFrame) -> DataFrame:
    """Crawls newest first."""
    return crawls.orderBy(F.desc("started"), F.desc("id"))


def with_meta(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """Settings (key, value) with values put in."""
    new = meta.sparkSession.createDataFrame(sorted(values.items()), "key string, value string")
    return meta.join(new.select("key"), "key", "left_anti").select("key", "value").union(new)


def blobs(rows: DataFrame, kind: str, extension: str) -> DataFrame:
    """(url, kind, path) of bodies (url, body): files are named by the URL's MD5."""
    return rows.select("url", F.lit(kind).alias("kind"), F.concat(F.md5("url"), F.lit(extension)).alias("path"), "body")


def parents_of(host: Column) -> Column:
    """A host and every domain above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("host"), (i == 1).alias("own")))


def https_upgrades(pages: DataFrame, hsts: DataFrame) -> DataFrame:
    """(url, redirect_url) of http URLs whose host, or a domain above it with include_subdomains, asked for https."""
    plain = pages.where(F.col("url").startswith("http://")).select("url", F.explode(parents_of(urls.host(F.col("url")))).alias("p")).select("url", "p.host", "p.own")
    hit = plain.join(hsts, "host").where("own OR include_subdomains").select("url").distinct()
    return hit.select("url", F.regexp_replace(F.regexp_replace("url", "^http://([^/]*):80(?=/|$)", "http://$1"), "^http:", "https:").alias("redirect_url"))
