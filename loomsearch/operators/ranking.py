"""Query-dependent ranking: proximity of the query's terms, and matches in the URL. Column expressions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import ranking_parts

TOP, MISSING, MOST_SPANS = 256, 1000, 8
SHORT_SPAN, TOP_SPAN = 32, 16
TITLE_WEIGHT, BODY_WEIGHT = 4, 1
HOST_POINTS, PATH_POINTS, SHORT_PATH_POINTS, WORD_IN_PATH_POINTS = 256, 128, 64, 1000
ALL_IN_HOST, ALL_IN_PATH, SHORT = 128, 64, 16


def shortest_span(n: int) -> int:
    return n * (n + 1) // 2


def nearest(positions: Column, at: Column) -> Column:
    """Distance from ``at`` to the closest position; MISSING without any."""
    return F.coalesce(F.array_min(F.transform(positions, lambda p: F.abs(p - at))), F.lit(MISSING))


def spans(m: Column, terms: list[str]) -> Column:
    """Of the first term that the document has: array of (pos, span), span the sum of distances to all other terms."""

    def from_anchor(anchor: str) -> Column:
        """Nested functions over the anchor's positions, so that nothing is exploded."""
        others = [t for t in terms if t != anchor]
        total = lambda a: reduce(lambda x, y: x + y, (nearest(m[t], a) for t in others), F.lit(0))
        return F.transform(m[anchor], lambda a: F.struct(a.cast("int").alias("pos"), total(a).cast("int").alias("span")))

    out = F.array().cast("array<struct<pos:int,span:int>>")
    for anchor in reversed(list(dict.fromkeys(terms))):
        out = F.when(F.map_contains_key(m, F.lit(anchor)), from_anchor(anchor)).otherwise(out)
    return out


def dynamic_rank(m: Column, terms: list[str], weight: int = BODY_WEIGHT) -> Column:
    """Score of short spans, of those near the top, and of anchors near the top. One term alone scores nothing in a body."""
    n = len(terms)
    if n == 1:
        hits = F.coalesce(F.size(F.filter(m[terms[0]], lambda p: p < TOP)), F.lit(0))
        return F.lit(0) if weight == BODY_WEIGHT else hits
    found = spans(m, terms)
    short = F.filter(found, lambda s: (s["span"] > 0) & (s["span"] < 2 * shortest_span(n)))
    few = lambda a: F.least(F.size(a), F.lit(MOST_SPANS))
    top = F.filter(short, lambda s: s["pos"] < TOP)
    return weight * (few(short) * SHORT_SPAN + F.size(F.filter(found, lambda s: s["pos"] < TOP)) + few(top) * TOP_SPAN)


def match_score(term: str, part: Column) -> Column:
    """Length of the term over that of the part, in single precision."""
    n = F.octet_length(part)
    share = F.lit(len(term.encode())).cast("float") * (F.lit(1.0) / F.greatest(n, F.lit(1))).cast("float")
    return F.when((n > 0) & F.contains(part, F.lit(term)), share).otherwise(F.lit(0.0).cast("float"))


def _points(score: Column, steps: list[tuple[float, int]]) -> Column:
    out = F.lit(None).cast("int")
    for above, points in reversed(steps):
        out = F.when(score > F.lit(above).cast("float"), F.lit(points)).otherwise(out)
    return out


def with_url_scores(rows: DataFrame, leaves: list[list[str]], url: str = "url") -> DataFrame:
    """``rows`` with url_host, url_path, url_score and short_path.

    Best term by share of the host, else of the path; more if all terms of a leaf occur. A short path gives host points.
    Parts and shares are columns of their own steps, so that each is computed once.
    """
    parts = rows.withColumn("url_parts", ranking_parts(F.col(url)))
    parts = parts.withColumn("url_host", F.col("url_parts.host")).withColumn("url_path", F.col("url_parts.path")).drop("url_parts")
    host, path = F.col("url_host"), F.col("url_path")
    every = [t for leaf in leaves for t in leaf]
    zero = F.lit(0.0).cast("float")
    best = lambda part: F.greatest(zero, *(match_score(t, part) for t in every), zero)
    shares = parts.withColumn("host_share", best(host)).withColumn("path_share", best(path))
    extra = F.lit(0)
    for leaf in leaves:
        if len(leaf) > 1:
            for part, points in ((host, ALL_IN_HOST), (path, ALL_IN_PATH)):
                extra = extra + F.when(reduce(lambda a, b: a & b, (F.contains(part, F.lit(t)) for t in leaf)), points).otherwise(0)
    halves = lambda p: (p, p // 2, p // 4)
    narrow, wide = (0.5, 0.3, 0.15), (0.7, 0.5, 0.3)
    points = lambda share, cuts, p: _points(F.col(share), list(zip(cuts, halves(p), strict=True)))
    by_host = F.when(F.octet_length(host) <= SHORT, points("host_share", narrow, HOST_POINTS)).otherwise(points("host_share", wide, HOST_POINTS))
    by_path = F.when(F.octet_length(path) <= SHORT, points("path_share", narrow, HOST_POINTS)).otherwise(points("path_share", wide, PATH_POINTS))
    scored = shares.withColumn("url_score", F.coalesce(by_host, by_path, F.lit(0)) + extra)
    return scored.withColumn("short_path", F.when(F.octet_length(path) <= SHORT, SHORT_PATH_POINTS).otherwise(0)).drop("host_share", "path_share")


def is_path_segment(path: Column, word: str) -> Column:
    """Whether the word's first occurrence in the path stands between slashes or ends."""
    at = F.instr(path, F.lit(word))
    before, after = F.substring(path, at - 1, F.lit(1)), F.substring(path, at + len(word), F.lit(1))
    return (at > 0) & ((at == 1) | (before == "/")) & ((after == "") | (after == "/"))


def single_word_bonus(host: Column, path: Column, word: str) -> Column:
    known = F.contains(host, F.lit("wikipedia")) | F.contains(host, F.lit("dictionary"))
    return F.when(known & is_path_segment(path, word), WORD_IN_PATH_POINTS).otherwise(0)
