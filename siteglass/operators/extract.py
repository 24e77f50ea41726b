"""Custom searches and extractions: text and regular expressions by SQL functions, elements in a Python table function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.config import DEFAULT, Config
from siteglass.sources.html import Node, parse_tree

RESULT = "url string, kind string, name string, value string"


@dataclass(frozen=True)
class Search:
    """How often a pattern occurs in the html, the content text, or the elements that a selector names (element:css)."""

    name: str
    pattern: str
    regex: bool = False
    scope: str = "html"
    mode: str = "contains"


@dataclass(frozen=True)
class Extraction:
    """Values by a regular expression, a css selector, or a path such as //div[@id='x']/a; joined by ' | '."""

    name: str
    type: str
    expression: str
    attribute: str = ""
    returns: str = "text"


def occurrences(text: Column, pattern: str, regex: bool) -> Column:
    if regex:
        return F.regexp_count(text, F.lit("(?s)" + pattern))
    return F.expr("0") if not pattern else ((F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def searches(pages: DataFrame, wanted: list[Search]) -> DataFrame:
    """(url, kind, name, value) of pages (url, html, content_text)."""
    values = []
    for s in wanted:
        if s.scope.startswith("element:"):
            continue
        n = occurrences(F.coalesce(F.col("content_text" if s.scope == "text" else "html"), F.lit("")), s.pattern, s.regex)
        values.append(F.struct(F.lit(s.name).alias("name"), ((n == 0).cast("string") if s.mode == "not_contains" else n.cast("string")).alias("value")))
    out = pages.select("url", F.explode(F.array(*values)).alias("v")).select("url", F.lit("search").alias("kind"), "v.name", "v.value") if values else None
    inside = [s for s in wanted if s.scope.startswith("element:")]
    if inside:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for url, html in zip(batch["url"], batch["html"], strict=True):
                    root = parse_tree(html or "").root
                    for s in inside:
                        text = "\n".join(outer(n) for n in select(root, s.scope.removeprefix("element:")))
                        n = len(re.findall("(?s)" + s.pattern, text)) if s.regex else text.count(s.pattern)
                        rows.append((url, "search", s.name, str(n == 0).lower() if s.mode == "not_contains" else str(n)))
                yield pd.DataFrame(rows, columns=["url", "kind", "name", "value"])

        found = pages.select("url", "html").mapInPandas(run, RESULT)
        out = found if out is None else out.union(found)
    return out


def regex_values(html: Column, expression: str) -> Column:
    """Group 1 of each match, or the match if there is no group, joined."""
    group = 1 if re.compile(expression).groups else 0
    return F.array_join(F.regexp_extract_all(html, F.lit("(?s)" + expression), F.lit(group)), " | ")


def text_of(n: Node) -> str:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x.children)
    return "".join(out)


def outer(n: Node | str) -> str:
    if isinstance(n, str):
        return n
    attrs = "".join(f' {k}="{v}"' for k, v in n.attrs.items())
    return f"<{n.tag}{attrs}>{''.join(map(outer, n.children))}</{n.tag}>"


SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[\w-]+(?:[~|^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)")


def matches(n: Node, simple: str) -> bool:
    """A tag with ids, classes and attribute tests."""
    m = SIMPLE.fullmatch(simple)
    if not m or (m[1] not in (None, "*") and n.tag != m[1].lower()):
        return False
    for part in re.findall(r"[#.][\w-]+|\[[^\]]*\]", m[2]):
        if part[0] == "#" and n.get("id") != part[1:]:
            return False
        if part[0] == "." and part[1:] not in n.get("class").split():
            return False
        if part[0] == "[":
            name, how, value = re.fullmatch(r"\[([\w-]+)(?:([~|^$*]?=)[\"']?(.*?)[\"']?)?\]", part).groups()
            own = n.attrs.get(name)
            tests = {"=": lambda a, b: a == b, "~=": lambda a, b: b in a.split(), "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "|=": lambda a, b: a == b or a.startswith(b + "-")}
            if own is None or (how and not tests[how](own, value)):
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements that a css selector names: lists, descendants and children of simple selectors."""
    alternatives = [re.findall(r"(>)|([^\s>]+)", s) for s in selector.split(",")]

    def fits(n: Node, steps: list[tuple[str, str]]) -> bool:
        if not matches(n, steps[-1][1]):
            return False
        if len(steps) == 1:
            return True
        up = n.parent
        if steps[-2][0]:
            return up is not None and fits(up, steps[:-2])
        while up is not None:
            if fits(up, steps[:-1]):
                return True
            up = up.parent
        return False

    return [n for n in root.elements() if any(steps and fits(n, steps) for steps in alternatives)]


def by_path(root: Node, path: str) -> list[Node | str]:
    """Nodes of a path of /tag and //tag steps with [n], [@a], [@a='v'] and [contains(@a,'v')], ending in /@a or /text()."""
    top = Node("")
    top.children = [root]
    now: list = [top]
    for deep, step in re.findall(r"(//?)((?:\[[^\]]*\]|[^/\[])+)", path):
        name, tests = re.match(r"([^\[]*)", step)[1], re.findall(r"\[([^\]]*)\]", step)
        if name.startswith("@"):
            now = [n.attrs[name[1:]] for n in now if isinstance(n, Node) and name[1:] in n.attrs]
            continue
        if name == "text()":
            now = [c for n in now if isinstance(n, Node) for c in n.children if isinstance(c, str)]
            continue
        found = []
        for n in now:
            pools = [x.children for x in n.elements()] if deep == "//" else [n.children]
            for pool in pools:
                hits = [c for c in pool if isinstance(c, Node) and name in ("*", c.tag)]
                for t in tests:
                    if t.isdigit():
                        hits = hits[int(t) - 1 : int(t)]
                    elif m := re.fullmatch(r"@([\w-]+)(?:\s*=\s*['\"](.*)['\"])?", t):
                        hits = [h for h in hits if m[1] in h.attrs and (m[2] is None or h.attrs[m[1]] == m[2])]
                    elif m := re.fullmatch(r"contains\(@([\w-]+),\s*['\"](.*)['\"]\)", t):
                        hits = [h for h in hits if m[2] in h.get(m[1])]
                found += [h for h in hits if all(h is not f for f in found)]
        now = found
    return now


def extractions(pages: DataFrame, wanted: list[Extraction], cfg: Config = DEFAULT) -> DataFrame:
    """(url, kind, name, value) of pages (url, html)."""
    native = [x for x in wanted if x.type == "regex"]
    rest = [x for x in wanted if x.type != "regex"]
    out = None
    if native:
        values = F.array(*[F.struct(F.lit(x.name).alias("name"), regex_values(F.coalesce("html", F.lit("")), x.expression).alias("value")) for x in native])
        out = pages.select("url", F.explode(values).alias("v")).select("url", F.lit("extraction").alias("kind"), "v.name", "v.value")
    if rest:

        def value(n: Node | str, x: Extraction) -> str | None:
            if isinstance(n, str):
                return n.strip()
            if x.attribute:
                return n.attrs.get(x.attribute)
            return outer(n) if x.returns == "html" else "".join(map(outer, n.children)) if x.returns == "inner_html" else text_of(n).strip()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for url, html in zip(batch["url"], batch["html"], strict=True):
                    root = parse_tree(html or "", cfg.advanced.terminated_references).root
                    for x in rest:
                        hits = select(root, x.expression) if x.type == "css" else by_path(root, x.expression)
                        rows.append((url, "extraction", x.name, str(len(hits)) if x.returns == "function" else " | ".join(v for n in hits if (v := value(n, x)) is not None)))
                yield pd.DataFrame(rows, columns=["url", "kind", "name", "value"])

        found = pages.select("url", "html").mapInPandas(run, RESULT)
        out = found if out is None else out.union(found)
    return out
