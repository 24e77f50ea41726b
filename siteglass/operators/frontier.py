"""Discovery and admission of URLs: filters, and caps that hold in the order of discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteglass.config import DEFAULT, Config
from siteglass.functions import urls
from siteglass.storage import discard, stored


def gates(cfg: Config) -> Column:
    """Length, depth, number of query parameters and folder depth."""
    lim, url = cfg.limits, F.col("url")
    tests = [F.lit(True)]
    if lim.max_url_length > 0:
        tests.append(F.octet_length(url) <= lim.max_url_length)
    if lim.max_depth >= 0:
        tests.append(F.col("depth") <= lim.max_depth)
    if lim.max_query_strings >= 0:
        tests.append(urls.query_param_count(url) <= lim.max_query_strings)
    if lim.max_folder_depth >= 0:
        tests.append(urls.folder_depth(url) <= lim.max_folder_depth)
    return reduce(lambda a, b: a & b, tests)


def admit(spark: SparkSession, items: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The items (seq, url, depth, ...) that are admitted in the order of seq: gates, first sight of a URL, then caps.

    A cap counts admitted items only, and a URL that a cap turns away may be admitted when it is seen again. The answer is
    the fixed point of "fewer admitted items of my depth, host and path rule came before me than the caps": a round counts
    with windows over the last round's answer; each round settles at least the next item in order, and nearly all at once.
    """
    lim = cfg.limits
    kept = items.where(gates(cfg))
    rule = F.coalesce(*[F.when(F.col("url").contains(p), i) for i, (p, _) in enumerate(lim.by_path)], F.lit(-1)) if lim.by_path else F.lit(-1)
    caps: list[tuple[str, Column]] = []
    if lim.max_urls_per_depth >= 0:
        caps.append(("depth", F.lit(lim.max_urls_per_depth)))
    if lim.max_per_subdomain >= 0:
        caps.append(("host", F.lit(lim.max_per_subdomain)))
    if lim.by_path:
        most = F.create_map(*[x for i, (_, n) in enumerate(lim.by_path) for x in (F.lit(i), F.lit(n))])
        caps.append(("rule", F.coalesce(most[F.col("rule")], F.lit(1 << 60))))
    first = Window.partitionBy("url").orderBy("seq")
    if not caps:
        return kept.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    rows = kept.withColumn("host", urls.host(F.col("url"))).withColumn("rule", rule).withColumn("on", F.lit(True))
    rows, path = stored(spark, rows, "frontier")
    while True:
        before = lambda key: F.coalesce(F.sum(F.col("on").cast("int")).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fits = reduce(lambda a, b: a & b, [before("url") == 0, *[before(key) < most for key, most in caps]])
        after, fresh = stored(spark, rows.withColumn("now", fits), "frontier")
        discard(spark, path)
        changed = after.where("now <> on").limit(1).count()
        rows, path = after.drop("on").withColumnRenamed("now", "on"), fresh
        if not changed:
            return rows.where("on").select(*items.columns)


# The link types that lead on, and whether they do by default.
FOLLOWED = {
    "hyperlink": True, "xhr": False, "image": False, "css": False, "js": False, "media": False, "swf": False, "iframe": True, "canonical": False, "hreflang": False, "next": False, "prev": False, "amp": False, "meta_refresh": True,
    "mobile_alternate": False,
}


def discover(
    links: DataFrame, seed: str, cfg: Config = DEFAULT, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), remove_params: tuple[str, ...] = (), replaces: tuple[tuple[str, str], ...] = (),
    follow_nofollow: bool = False, inside_folder: bool = False, follow: dict[str, bool] | None = None, external: bool = False, external_nofollow: bool = False,
) -> DataFrame:
    """Links (src, place, url, type, nofollow) that lead on, with scope.

    In this order: the first links of a page up to its cap, types that are followed, outside the seed's site only if
    ``external``, nofollow by scope, then rewritten, valid, allowed by the patterns and, if asked, inside the start folder.
    """
    nth = Window.partitionBy("src").orderBy("place")
    rows = links.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= cfg.limits.max_links_per_page).drop("n") if cfg.limits.max_links_per_page >= 0 else links
    inner = urls.scope(F.col("url"), F.lit(seed)) != "external"
    types = [t for t, on in (FOLLOWED | (follow or {})).items() if on]
    rows = rows.where((F.col("url") != "") & F.col("type").isin(*types) & (inner | F.lit(external)))
    rows = rows.where(~F.coalesce("nofollow", F.lit(False)) | F.when(inner, follow_nofollow).otherwise(external_nofollow))
    rows = rows.withColumn("url", urls.rewrite(F.col("url"), remove_params, replaces))
    rows = rows.where(urls.is_valid(F.col("url")) & urls.allowed(F.col("url"), include, exclude))
    rows = rows.withColumn("scope", urls.scope(F.col("url"), F.lit(seed)))
    if inside_folder:
        rows = rows.where((F.col("scope") == "external") | ~urls.outside_start_folder(F.col("url"), F.lit(seed)))
    return rows


def gated_inlinks(links: DataFrame, seed: str, cfg: Config = DEFAULT, **options) -> DataFrame:
    """(url, inlinks): occurrences of hyperlinks that discovery lets through, by what they are rewritten to."""
    return discover(links, seed, cfg, **options).where("type = 'hyperlink'").groupBy("url").agg(F.count("*").alias("inlinks"))


def duplicate_of(pages: DataFrame) -> DataFrame:
    """(url, duplicate_of): the first URL by seq with the same body hash, null for that one itself.

    The first of a hash is an aggregate that is joined back, so that a hot hash never fills a window.
    """
    keyed = pages.where("hash <> ''")
    first = keyed.groupBy("hash").agg(F.min_by("url", "seq").alias("first"))
    return keyed.join(first, "hash").select("url", F.when(F.col("first") != F.col("url"), F.col("first")).alias("duplicate_of"))
