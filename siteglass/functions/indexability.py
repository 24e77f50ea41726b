"""Whether a page can be indexed, as an ordered chain of conditions, and X-Robots-Tag scoping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directives that a colon may follow without naming a robot.
KNOWN = (
    "all", "noindex", "nofollow", "none", "noarchive", "nosnippet", "max-snippet", "max-image-preview", "max-video-preview", "notranslate",
    "noimageindex", "unavailable_after", "indexifembedded", "noodp", "noydir",
)


def has_noindex(values: Column, robot: str = "") -> Column:
    """noindex or none in any value; a value scoped to another robot is skipped."""

    def one(value: Column) -> Column:
        head = F.trim(F.substring_index(value, ":", 1))
        scoped = value.contains(":") & ~head.rlike("[ ,]") & ~F.lower(head).isin(*KNOWN)
        rest = F.when(scoped, F.regexp_replace(value, "^[^:]*:", "")).otherwise(value)
        listed = F.exists(F.split(rest, ","), lambda d: F.lower(F.trim(d)).isin("noindex", "none"))
        return listed & (~scoped | (F.lower(head) == robot.lower()))

    return F.coalesce(F.exists(values, one), F.lit(False))


def status(
    url: Column, status_code: Column, fetch_error: Column, robots_blocked: Column, meta_refresh_url: Column, meta_robots: Column, x_robots_tag: Column,
    canonicals: Column, robot: str = "", respect_self_refresh: bool = True,
) -> Column:
    """The reason a page can't be indexed, '' if it can. URLs are expected normalised."""
    refresh = F.coalesce(meta_refresh_url, F.lit(""))
    canonical = F.get(F.filter(canonicals, lambda c: c != ""), F.lit(0))
    code = F.coalesce(status_code, F.lit(0))
    return (
        F.when(F.coalesce(robots_blocked, F.lit(False)), "Blocked by Robots.txt")
        .when((F.coalesce(fetch_error, F.lit("")) != "") | (code == 0), "No Response")
        .when(code >= 500, "Server Error")
        .when(code >= 400, "Client Error")
        .when(code >= 300, "Redirected")
        .when((refresh != "") & ((refresh != url) | F.lit(respect_self_refresh)), "Redirected")
        .when(has_noindex(meta_robots) | has_noindex(x_robots_tag, robot), "Noindex")
        .when(F.coalesce(canonical != url, F.lit(False)), "Canonicalised")
        .otherwise("")
    )
