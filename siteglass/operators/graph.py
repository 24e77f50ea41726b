"""Analyses of the link graph: link score, degrees, depth, chains and discovery paths, as loops of joins.

Each loop's state is a narrow table that is written to the shared folder at intervals, so plans stay short and a lost
executor costs a few steps at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.storage import discard, stored

DAMPING, ROUNDS, HOPS = 0.85, 40, 25


def page_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of followed hyperlinks between internal pages, links to oneself included."""
    links = pages.where("facts IS NOT NULL AND scope = 'internal'").select(F.col("url").alias("src"), F.explode("facts.links").alias("l"))
    links = links.where("l.type = 'hyperlink' AND NOT coalesce(l.nofollow, false)").select("src", F.col("l.url").alias("dst")).distinct()
    return links.join(pages.where("scope = 'internal'").select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, unique_in, unique_out) of distinct edges; a link to oneself counts in both."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").alias("unique_in"), F.sum("o").alias("unique_out"))


def page_rank(spark: SparkSession, nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, every: int = 8) -> DataFrame:
    """(node, rank): fixed rounds of damping 0.85 from 1/N. Links to oneself pass nothing on, the rank of nodes without
    links is lost, and a target that is no node gets what links pass but no base."""
    nodes, node_path = stored(spark, nodes.select("node").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    real = edges.where("src <> dst").select("src", "dst").distinct()
    out = real.groupBy("src").agg(F.count("*").alias("k"))
    links, link_path = stored(spark, real.join(out, "src"), "links")
    base = nodes.select("node", F.lit((1 - DAMPING) / n).alias("x"))
    rank, path = nodes.select("node", F.lit(1.0 / n).alias("rank")), None
    for i in range(1, rounds + 1):
        passed = links.join(rank, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (DAMPING * F.col("rank") / F.col("k")).alias("x"))
        rank = base.union(passed).groupBy("node").agg(F.sum("x").alias("rank"))
        if i % every == 0 or i == rounds:
            old = path
            rank, path = stored(spark, rank, "rank")
            if old:
                discard(spark, old)
    discard(spark, node_path, link_path)
    return rank


def link_scores(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(url, link_score): rank as a percentage of the greatest."""
    nodes = pages.where("scope = 'internal' AND state = 'crawled'").select(F.col("url").alias("node"))
    rank = page_rank(spark, nodes, page_edges(pages))
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select(F.col("node").alias("url"), F.when(F.col("top") > 0, F.col("rank") / F.col("top") * 100).otherwise(0.0).alias("link_score"))


def depths(spark: SparkSession, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): links from the nearest seed; nodes that none reaches are left out."""
    done, path = stored(spark, seeds.select("node").distinct().withColumn("depth", F.lit(0)), "depth")
    edges, edge_path = stored(spark, edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    paths, last, depth = [path], done, 0
    while True:
        depth += 1
        step = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(done, "node", "left_anti")
        last, path = stored(spark, step.withColumn("depth", F.lit(depth)), "depth")
        paths.append(path)
        if not last.limit(1).count():
            break
        done = spark.read.schema(done.schema).parquet(*paths)
    discard(spark, edge_path)
    return done


def walk(spark: SparkSession, starts: DataFrame, steps: DataFrame, most: int | None = None, every: int = 5) -> DataFrame:
    """Follow steps (at, to) from each start: (source, hops, loop). A walk ends without a step, at a node it has seen
    (loop), or after ``most`` hops if that is given. State is written every few steps; a walk that has ended leaves it, and until then waits
    at a place of its own, so that ended walks don't meet in one partition."""
    aside = F.concat(F.lit("\0"), "source")
    now = starts.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array().cast("array<string>").alias("hops"), F.lit(False).alias("loop"))
    done, n = [], 0
    while True:
        for _ in range(every if most is None else min(every, most - n)):
            to, seen = F.col("to"), F.array_contains("hops", F.col("to")) | (F.col("to") == F.col("source"))
            now = now.join(steps.select("at", "to"), "at", "left").select(
                "source", F.when(to.isNull() | seen, aside).otherwise(to).alias("at"), F.when(to.isNull(), F.col("hops")).otherwise(F.concat("hops", F.array("to"))).alias("hops"),
                (F.col("loop") | F.coalesce(seen, F.lit(False))).alias("loop"),
            )
            n += 1
        now, _ = stored(spark, now, "walk")
        ended = (F.col("at") == aside) | F.lit(most is not None and n >= most)
        done.append(now.where(ended).select("source", "hops", "loop"))
        now = now.where(~ended)
        if not now.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def chains(spark: SparkSession, steps: DataFrame, pages: DataFrame) -> DataFrame:
    """Chains of steps (at, to) of two hops or a loop: (source, n_hops, hops, final, final_status, loop)."""
    walked = walk(spark, steps.select(F.col("at").alias("node")), steps, HOPS + 1).where("size(hops) >= 2 OR loop")
    last = walked.withColumn("last", F.element_at("hops", -1))
    known = pages.select(F.col("url").alias("last"), F.col("status_code").alias("final_status"))
    out = last.join(known.withColumn("final", F.col("last")), "last", "left")
    return out.select("source", F.size("hops").alias("n_hops"), "hops", F.coalesce("final", F.lit("")).alias("final"), F.coalesce("final_status", F.lit(0)).alias("final_status"), "loop")


def redirect_steps(pages: DataFrame) -> DataFrame:
    return pages.where("redirect_url <> ''").select(F.col("url").alias("at"), F.col("redirect_url").alias("to"))


def canonical_steps(pages: DataFrame) -> DataFrame:
    first = F.get(F.filter(F.concat("facts.canonical_html", "facts.canonical_http"), lambda c: c != ""), F.lit(0))
    return pages.where("facts IS NOT NULL").select(F.col("url").alias("at"), first.alias("to")).where("to IS NOT NULL AND to <> at")


def chain_issues(spark: SparkSession, pages: DataFrame) -> DataFrame:
    detail = F.concat(F.col("n_hops").cast("string"), F.lit(" hops")).alias("detail")
    redirects = chains(spark, redirect_steps(pages), pages).select(F.col("source").alias("url"), F.when(F.col("loop"), "redirect_loop").otherwise("redirect_chain").alias("issue"), detail)
    return redirects.union(chains(spark, canonical_steps(pages), pages).select(F.col("source").alias("url"), F.lit("canonical_chain").alias("issue"), detail))


def crawl_paths(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(url, hops, path) from the page that discovery began at; a parent seen before ends the path and isn't repeated.

    Paths have any length: a round of the walk is one hop, and walks that have ended take no further part.
    """
    steps = pages.where("discovered_from <> '' AND discovered_from <> url").select(F.col("url").alias("at"), F.col("discovered_from").alias("to"))
    walked = walk(spark, pages.select(F.col("url").alias("node")), steps)
    hops = F.when(F.col("loop"), F.slice("hops", 1, F.size("hops") - 1)).otherwise(F.col("hops"))
    path = F.reverse(F.concat(F.array("source"), hops))
    return walked.select(F.col("source").alias("url"), F.size(hops).alias("hops"), F.array_join(path, " -> ").alias("path"))
