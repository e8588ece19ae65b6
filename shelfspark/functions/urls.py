"""URL functions on columns."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Base address and search path of the known sources.
BASE_URLS = {
    "amazon": "https://www.amazon.com",
    "ebay": "https://www.ebay.com",
    "walmart": "https://www.walmart.com",
}
SEARCH_PATHS = {
    "amazon": "/s?k={keyword}&page={page}",
    "ebay": "/sch/i.html?_nkw={keyword}&_pgn={page}",
    "walmart": "/search/?query={keyword}&page={page}",
}
# Where a product id stands in a product address.
PRODUCT_ID_PATTERNS = {
    "amazon": r"/dp/([A-Z0-9]{10})",
    "ebay": r"/itm/(\d+)",
    "walmart": r"/ip/[^/]+/(\d+)",
}
BROWSER_ID_PATTERNS = {**PRODUCT_ID_PATTERNS, "ebay": r"/itm/([^/?]+)"}

_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
# Root-relative addresses that need no more than the origin in front.
_SIMPLE_PATH = r"^/(?!/)[^\s#;]*[^\s#;?]$"
_PLAIN_ORIGIN = re.compile(_ORIGIN)
# Java's pattern ends before a last line break of any kind, too.
_PLAIN_PATH = re.compile(_SIMPLE_PATH.replace("$", r"(?:\r\n|\r|\n)?\Z"), re.ASCII)


@F.pandas_udf(T.StringType())
def _joined(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series(
        [None if u is None else urljoin(b or "", u) for u, b in zip(urls, bases)], dtype="object"
    )


def normalize_url(url: Column, base: Column) -> Column:
    """Absolute address; empty for null or empty input.

    Absolute, scheme-relative and plain root-relative addresses stay in the JVM; only the remaining relative
    forms are resolved in Python.
    """
    base = F.coalesce(base, F.lit(""))
    simple = url.rlike(_SIMPLE_PATH) & ~F.contains(url, F.lit("/."))
    absolute = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    easy = (
        F.when(url == "", F.lit(""))
        .when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url))
        .when(absolute, url)
        .when(simple, F.concat(F.regexp_extract(base, _ORIGIN, 1), url))
    )
    hard = _joined(F.when(easy.isNull(), url), base)
    return F.coalesce(easy, hard, F.lit(""))


def normalized(url: str, base: str) -> str:
    """``normalize_url`` for an address inside a task."""
    if url.startswith("//"):
        return "https:" + url
    if not base or not url or url.startswith(("http://", "https://")):
        return url
    if _PLAIN_PATH.match(url) and "/." not in url:
        origin = _PLAIN_ORIGIN.match(base)
        return origin[1] + url if origin else url
    return urljoin(base, url)


def is_valid_url(url: Column) -> Column:
    """True when scheme and host are present."""
    host = url_authority(url)
    balanced = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    return F.coalesce(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]") & balanced, F.lit(False))


def url_authority(url: Column) -> Column:
    """Lower-case host with port, or empty."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def by_source(source: Column, values: dict[str, str]) -> Column:
    """The value of each known source, null for others."""
    picked = F.lit(None).cast("string")
    for name, value in values.items():
        picked = F.when(source == name, F.lit(value)).otherwise(picked)
    return picked


def product_id_from_url(url: Column, source: Column, rule: str = "static") -> Column:
    """Product id in an address; ``rule`` is 'static' or 'browser' and differs for one source."""
    patterns = PRODUCT_ID_PATTERNS if rule == "static" else BROWSER_ID_PATTERNS
    found = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        found = F.when(source == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(found)
    return found


def search_url(source: Column, keyword: Column, page: Column, blank: str = " ") -> Column:
    """Search address of a known source; ``blank='+'`` replaces blanks in the keyword."""
    term = F.replace(keyword, F.lit(" "), F.lit(blank)) if blank != " " else keyword
    path = F.replace(by_source(source, SEARCH_PATHS), F.lit("{keyword}"), term)
    path = F.replace(path, F.lit("{page}"), page.cast("string"))
    return F.concat(by_source(source, BASE_URLS), path)
