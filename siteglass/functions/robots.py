"""robots.txt: parsing to rules, and verdicts by a join of paths with the rules of the robot's groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import urls

RULES = "authority string, agent string, allow boolean, path string, line int, regex string"


def pattern(path: str) -> str:
    """A rule's path as a regular expression: * is anything, a last $ the end."""
    end = path.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in path.removesuffix("$").split("*")) + ("$" if end else "")


def parse(text: str) -> tuple[list[tuple[str, bool, str, int]], list[str]]:
    """Rules (agent, allow, path, line) and sitemaps; user-agent lines that follow one another share a group."""
    rules, sitemaps, agents, more = [], [], None, False
    for number, line in enumerate(text.splitlines(), 1):
        key, colon, value = line.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*agents, value.lower()] if more and agents is not None else [value.lower()]
        elif key in ("allow", "disallow") and value:
            rules += [(a, key == "allow", value, number) for a in agents or ()]
        elif key == "sitemap" and value:
            sitemaps.append(value)
        more = key == "user-agent"
    # groups without rules still claim their robot
    known = {r[0] for r in rules}
    for m in re.finditer(r"(?im)^[ \t]*user-agent[ \t]*:([^#\n]*)", text):
        if (agent := m[1].strip().lower()) not in known:
            known.add(agent)
            rules.append((agent, True, "", 0))
    return rules, sitemaps


def rules(files: DataFrame) -> DataFrame:
    """Rules of robots.txt files (authority, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, g, ok, p, n, pattern(p)) for a, t in zip(batch["authority"], batch["text"], strict=True) for g, ok, p, n in parse(t or "")[0]]
            yield pd.DataFrame(rows, columns=["authority", "agent", "allow", "path", "line", "regex"])

    return files.select("authority", "text").mapInPandas(run, RULES)


def sitemaps(files: DataFrame) -> DataFrame:
    """(authority, sitemap) that robots.txt files name."""
    lines = files.select("authority", F.explode(F.split("text", "\r?\n")).alias("line"))
    return lines.select("authority", F.trim(F.regexp_extract(F.substring_index("line", "#", 1), r"(?i)^\s*sitemap\s*:\s*(.+)$", 1)).alias("sitemap")).where("sitemap <> ''")


def verdicts(pages: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """(url, allowed, line): the longest matching rule of the robot's most specific groups decides, allow wins ties.

    Rules are few for an authority, so the join fans out by their number only; without a matching rule a URL is allowed.
    """
    ua = user_agent.lower()
    mine = rules.withColumn("rank", F.when((F.col("agent") != "*") & F.lit(ua).startswith(F.col("agent")) & (F.col("agent") != ""), F.length("agent")).when(F.col("agent") == "*", 0)).where("rank IS NOT NULL")
    best = mine.groupBy("authority").agg(F.max("rank").alias("rank"))
    mine = mine.join(best, ["authority", "rank"]).where("path <> ''").select("authority", "allow", "path", "line", "regex")
    path = urls.path_of(F.col("url"))
    query = urls.query_of(F.col("url"))
    asked = F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    rows = pages.select("url", urls.authority(F.col("url")).alias("authority"), asked.alias("asked"))
    hit = rows.join(mine, "authority").where("asked rlike regex")
    won = hit.groupBy("url").agg(F.max(F.struct(F.length("path").alias("n"), "allow", (-F.col("line")).alias("line"))).alias("best"))
    return rows.select("url").distinct().join(won, "url", "left").select("url", F.coalesce("best.allow", F.lit(True)).alias("allowed"), (-F.col("best.line")).alias("line"))
