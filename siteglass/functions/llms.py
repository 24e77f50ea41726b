"""llms.txt files: title, summary, curated links and whether a list is malformed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import urls

ITEM = re.compile(r"[-*]\s+\[([^\]]*)\]\(\s*([^)\s]+)\s*\)\s*(?::\s*(.*?))?\s*")
PARSED = "url string, title string, summary string, malformed boolean, links array<struct<section:string,name:string,url:string,desc:string>>"


def parse(text: str) -> dict:
    out: dict = {"title": "", "summary": "", "malformed": False, "links": []}
    section, quote, over = "", [], False
    for line in (x.rstrip("\r") for x in text.split("\n")):
        if m := re.match(r"##\s+(.+?)\s*$", line):
            section, over = m[1], over or bool(quote)
        elif m := re.match(r"#\s+(.+?)\s*$", line):
            out["title"] = out["title"] or m[1]
        elif m := re.match(r">\s?(.*)$", line):
            if not section and not over:
                quote.append(m[1].strip())
        elif not line.strip():
            over = over or bool(quote)
        elif section and re.match(r"[-*]\s+", line.strip()):
            if m := ITEM.fullmatch(line.strip()):
                out["links"].append({"section": section, "name": m[1].strip(), "url": m[2], "desc": (m[3] or "").strip()})
            else:
                out["malformed"] = True
    out["summary"] = " ".join(quote).strip()
    return out


def parsed(files: DataFrame) -> DataFrame:
    """llms.txt files (url, text), parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"url": u} | parse(t or "") for u, t in zip(batch["url"], batch["text"], strict=True)], columns=["url", "title", "summary", "malformed", "links"])

    return files.select("url", "text").mapInPandas(run, PARSED)


def curated(files: DataFrame) -> DataFrame:
    """(src, url, section, name): links of llms.txt files (url, text), resolved against the file. Other files, such as
    llms-full.txt, list no links; links that don't resolve are left out."""
    rows = parsed(files.where(F.col("url").endswith("/llms.txt"))).select(F.col("url").alias("src"), F.explode("links").alias("l"))
    return rows.select("src", urls.resolve("src", "l.url").alias("url"), "l.section", "l.name").where("url <> ''")
