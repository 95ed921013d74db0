"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

MAX_URL_BYTES = 250
BLOCKED = "porn"


def split_fetch(url: Column) -> Column:
    """service, host, port, path as a fetcher needs them; the path has no leading slash."""
    return F.struct(
        F.regexp_extract(url, "^([^:]*):", 1).alias("service"), F.regexp_extract(url, "^[^:]*://([^/:?#]*)", 1).alias("host"),
        F.regexp_extract(url, "^[^:]*://[^/:?#]*:([0-9]+)", 1).alias("port"), F.regexp_extract(url, "^[^:]*://[^/]*/(.*)$", 1).alias("path"))


def site(url: Column) -> Column:
    """Between '://' and the next slash."""
    return F.regexp_extract(url, "://([^/]*)", 1)


def frontier_host(url: Column) -> Column:
    """Up to a slash, question mark or number sign; ``EMPTY`` without a scheme."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "://([^/?#]*)", 1)).otherwise(F.lit("EMPTY"))


def top_level_domain(url: Column) -> Column:
    """From the last dot of the whole URL to the next slash, or empty."""
    return F.regexp_extract(url, r"(\.[^./]*)(/[^.]*)?$", 1)


def clean_url(url: Column) -> Column:
    """Without the first matching prefix and the query."""
    return F.regexp_extract(F.regexp_replace(url, r"^(https://|http://|www\.)", ""), r"^[^?]*", 0)


def canonical(url: Column) -> Column:
    """Lower case, unless the URL names the encyclopedia whose paths depend on case."""
    return F.when(F.contains(url, F.lit("wikipedia")), url).otherwise(ascii_lower(url))


def is_crawlable(url: Column) -> Column:
    return F.startswith(url, F.lit("http")) & ~F.contains(url, F.lit(BLOCKED)) & (F.octet_length(url) <= MAX_URL_BYTES)


def is_followable(link: Column) -> Column:
    """Not a fragment or a query of the same page."""
    return ~link.rlike("^[#?]")


def resolve(page_url: Column, link: Column) -> Column:
    """A link from the root gets the page's scheme and host; others stay as they are."""
    scheme = F.regexp_extract(page_url, "^([^:]*)://", 1)
    return F.when(F.startswith(link, F.lit("/")), F.concat(scheme, F.lit("://"), site(page_url), link)).otherwise(link)


def ranking_parts(url: Column) -> Column:
    """host, path, first_path_segment as ranking sees them: hyphens and underscores are spaces in the first two."""
    has = F.contains(url, F.lit("://"))
    fold = F.contains(ascii_lower(url), F.lit("wikipedia"))
    case = lambda c: F.when(fold, ascii_lower(c)).otherwise(c)
    spaced = lambda c: F.translate(c, "-_", "  ")
    host = F.when(has, case(F.regexp_extract(url, "://([^/?#]*)", 1))).otherwise(F.lit(""))
    ended = url.rlike("://[^/?#]*[/?#]")
    path = F.when(has & ended, case(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))).otherwise(F.lit("/"))
    return F.struct(spaced(host).alias("host"), spaced(path).alias("path"), F.regexp_extract(path, "^/([^/]+)", 1).alias("first_path_segment"))


def percent_decode(c: Column) -> Column:
    """%xx only: plus signs stay, and so does a text with a bad escape."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def tld_weight(url: Column) -> Column:
    tld = top_level_domain(url)
    return F.when(tld.isin(".gov", ".edu", ".com", ".net", ".org"), 2).when(tld.isin(".biz", ".info"), 1).otherwise(-2)


def length_weight(url: Column) -> Column:
    n = F.octet_length(url)
    return F.when(n >= 100, 0).when(n >= 75, 1).when(n >= 50, 2).otherwise(3)
