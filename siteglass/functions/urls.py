"""URL functions: Column expressions where SQL functions can say it, Arrow UDFs for resolution and escaping."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PORTS = {"http": "80", "https": "443"}
PATH_OK = re.compile(r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]]|%[0-9a-fA-F]{2})*")
HEX = re.compile("%[0-9a-fA-F]{2}")
BAD = re.compile(r"[\x00-\x1f\x7f]")


def normalized(url: str, keep_fragment: bool = False, lower_hex: bool = False) -> str | None:
    """Lower-case scheme and host, no default port, `/` for no path, one case of escapes, no fragment; None if it can't be read."""
    url = url.strip()
    if BAD.search(url) or re.search("%(?![0-9a-fA-F]{2})", url.split("?")[0].split("#")[0]):
        return None
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    user = parts.netloc.rpartition("@")[0]
    path = parts.path if PATH_OK.fullmatch(parts.path) else quote(unquote_to_bytes(parts.path), safe="/-._~$&+,:;=@")
    path = HEX.sub(lambda m: m[0].lower() if lower_hex else m[0].upper(), path or "/")
    port_text = f":{port}" if port is not None and PORTS.get(scheme) != str(port) else ""
    host = f"[{host}]" if ":" in host else host
    asked = "?" in url.split("#")[0]
    out = f"{scheme}://{user + '@' if user else ''}{host}{port_text}{path}{'?' + parts.query if asked else ''}"
    return f"{out}#{parts.fragment}" if keep_fragment and parts.fragment else out


def resolved(base: str, href: str, keep_fragment: bool = False, lower_hex: bool = False) -> str | None:
    """An RFC 3986 reference against its base, normalised."""
    href = href.strip()
    if BAD.search(href):
        return None
    try:
        return normalized(urljoin(base, href), keep_fragment, lower_hex)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normalize(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else normalized(u))


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolved(b, h) for b, h in zip(base, href, strict=True)])


def no_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def normalize_plain(url: Column) -> Column:
    """Normalisation by SQL functions only, for URLs whose path and query need no escaping."""
    u = no_fragment(F.trim(url))
    scheme, rest = F.lower(F.regexp_extract(u, "^([^:]+)://", 1)), F.regexp_replace(u, "^[^:]+://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    tail = F.regexp_replace(rest, "^[^/?]*", "")
    tail = F.when((tail == "") | tail.startswith("?"), F.concat(F.lit("/"), tail)).otherwise(tail)
    path, query = F.regexp_extract(tail, r"^([^?]*)", 1), F.regexp_replace(tail, r"^[^?]*", "")
    pieces = F.split(path, "%")
    upper = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))))
    return F.concat(scheme, F.lit("://"), host, F.array_join(upper, "%"), query)


def authority(url: Column) -> Column:
    """Lower-case host, with a port that isn't the scheme's own."""
    u = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    u = F.regexp_replace(u, "//[^@]*@", "//")
    u = F.regexp_replace(F.regexp_replace(u, "^http://(.*):80$", "http://$1"), "^https://(.*):443$", "https://$1")
    return F.regexp_replace(u, "^[^:]*://", "")


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d*$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def folder_depth(url: Column) -> Column:
    path = path_of(url)
    return F.when(path == "", 0).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) - 1)


def query_param_count(url: Column) -> Column:
    return F.size(F.filter(F.split(query_of(url), "&"), lambda p: p != ""))


def path_type(href: Column) -> Column:
    h = F.trim(href)
    return (
        F.when(h.startswith("//"), "protocol_relative")
        .when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), "absolute")
        .when(h.startswith("/"), "root_relative")
        .otherwise("path_relative")
    )


def is_valid(url: Column) -> Column:
    """http(s) with a host that has a dot, is localhost or is an IP address."""
    h = host(url)
    return F.lower(F.trim(url)).rlike("^https?://") & (h != "") & (h.contains(".") | (h == "localhost") | h.startswith("["))


def registrable(hostname: Column, public_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.in", "co.za", "com.mx", "com.cn")) -> Column:
    """The public suffix and one label more; suffixes of two labels are given, others have one."""
    two = "|".join(s.replace(".", r"\.") for s in public_suffixes)
    name = F.regexp_extract(hostname, rf"([^.]+\.(?:{two}))$", 1)
    name = F.when(name != "", name).otherwise(F.regexp_extract(hostname, r"([^.]+\.[^.]+)$", 1))
    return F.when(hostname.rlike(r"^[0-9.]+$") | ~hostname.contains("."), hostname).otherwise(name)


def scope(url: Column, start: Column, all_subdomains: bool = False, cdns: tuple[str, ...] = ()) -> Column:
    """internal: the start's authority, its subdomains if it is a bare registrable domain or they are asked for, or a CDN prefix."""
    a, s = authority(url), authority(start)
    h, sh = host(url), host(start)
    root = registrable(sh)
    port = lambda x: F.regexp_extract(x, r":(\d+)$", 1)
    sub = (F.lit(all_subdomains) | (sh == root)) & (port(a) == port(s)) & ((h == root) | h.endswith(F.concat(F.lit("."), root)))
    inside = (a == s) | sub
    for c in cdns:
        name, _, prefix = c.partition("/")
        inside = inside | ((a == name.lower()) & (path_of(url).startswith("/" + prefix) if prefix else F.lit(True)))
    return F.when(inside, "internal").otherwise("external")


def rewrite(url: Column, remove_params: tuple[str, ...] = (), replaces: tuple[tuple[str, str], ...] = (), lowercase: bool = False) -> Column:
    """Drop query parameters by name, apply ordered replacements, lower the case. Fragments are dropped."""
    out = no_fragment(url)
    if remove_params:
        gone = [p.strip().lower() for p in remove_params]
        kept = F.filter(F.split(query_of(out), "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(gone))
        base = F.substring_index(out, "?", 1)
        text = F.array_join(kept, "&")
        out = F.when(~out.contains("?"), out).when(text == "", base).otherwise(F.concat_ws("?", base, text))
    for pattern, text in replaces:
        out = F.regexp_replace(out, pattern, re.sub(r"\$\{(\d+)\}", r"$\1", text))
    return F.lower(out) if lowercase else out


def allowed(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """No exclude pattern matches, and an include pattern does if there are any."""
    hit = lambda patterns: reduce(lambda a, b: a | b, [url.rlike(p) for p in patterns], F.lit(False))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def start_folder(seed: Column) -> Column:
    """The seed up to the last slash of its path."""
    return F.regexp_extract(no_fragment(F.substring_index(seed, "?", 1)), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*)?/)", 1)


def outside_start_folder(url: Column, seed: Column) -> Column:
    return ~url.startswith(start_folder(seed))


def site_key(url: Column) -> Column:
    """The lower-case host with its port, if one is given, of a URL or a bare host; null without one. www. stays."""
    named = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(named != "", F.lower(named))


def mapped(url: Column, mappings: tuple[tuple[str, str], ...]) -> Column:
    """Ordered regular replacements, as a previous crawl's URLs are mapped onto the current one's."""
    for pattern, text in mappings:
        url = F.regexp_replace(url, pattern, re.sub(r"\$\{(\d+)\}", r"$\1", text))
    return url
