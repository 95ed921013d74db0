"""Searches: match, rank, top results, pages of results, merging of shards, snippets and the response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import clean_url
from ..plans.compile import matching
from ..plans.query import Node, QuerySyntaxError, parse, ranking_leaves
from ..sources.index import Index
from . import ranking as R

TOP, PAGE = 32, 10
LONGEST_SINGLE_URL = 64
RESULT = "chunk int, doc_idx bigint, url string, rank int"


def rarest_first(index: Index, leaves: list[list[str]]) -> list[str]:
    """The terms by ascending number of occurrences, by one look into the dictionary."""
    terms = [t for leaf in leaves for t in leaf]
    cf = {r.term: r.cf for r in index.dictionary.filter(F.col("term").isin(terms)).collect()}  # as many rows as terms
    return sorted(terms, key=lambda t: cf.get(t, 0))


def matches(index: Index, query: str, compat: bool = False) -> DataFrame:
    """chunk, doc_idx of all matching documents."""
    return _matched(index, query, compat)[1].select("chunk", "doc_idx")


def _matched(index: Index, query: str, compat: bool) -> tuple[Node | None, DataFrame]:
    try:
        node = parse(query, compat)
    except QuerySyntaxError:
        return None, index.postings.sparkSession.createDataFrame([], "chunk int, doc_idx bigint, m map<string,array<int>>")
    return node, matching(index.postings, node)


def scored(index: Index, query: str, compat: bool = False, anchor: str = "query", title_weight: int = 0, static_weight: int = 0) -> DataFrame:
    """RESULT for every match that is ranked: URL score and proximity, with title and static rank by weight."""
    node, found = _matched(index, query, compat)
    if node is None:
        return index.postings.sparkSession.createDataFrame([], RESULT)
    leaves = ranking_leaves(node, negative=compat)
    terms = rarest_first(index, leaves) if anchor == "rarest" else [t for leaf in leaves for t in leaf]
    rows = R.with_url_scores(found.join(index.docs, ["chunk", "doc_idx"]), leaves)
    score = R.dynamic_rank(F.col("m"), terms) + F.col("url_score") + F.col("short_path")
    if len(terms) == 1:
        rows = rows.filter(F.octet_length("url") < LONGEST_SINGLE_URL)
        score = score + R.single_word_bonus(F.col("url_host"), F.col("url_path"), terms[0])
    if title_weight:
        titles = index.postings.filter(F.col("term").isin(terms) & (F.col("field") == "title")).groupBy("chunk", "doc_idx").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("tm"))
        rows = rows.join(titles, ["chunk", "doc_idx"], "left")
        score = score + F.when(F.col("tm").isNotNull(), R.dynamic_rank(F.col("tm"), terms, R.TITLE_WEIGHT) * title_weight).otherwise(0)
    if static_weight:
        score = score + F.col("static_rank") * static_weight
    return rows.select("chunk", "doc_idx", "url", score.cast("int").alias("rank"))


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("rank"), "chunk", "doc_idx")


def search(index: Index, query: str, k: int = TOP, **options) -> DataFrame:
    """The k best documents; ties in the order of chunk and document."""
    return ordered(scored(index, query, **options)).limit(k)


def page(results: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """The page of results, counted from 1."""
    return ordered(results).offset((number - 1) * size).limit(size)


def merge_shards(results: DataFrame) -> DataFrame:
    """shard, url, rank, ...: results of several servers, one row per URL (that of the first server), best first."""
    first = W.partitionBy("url").orderBy("shard", F.desc("rank"), "doc_idx")
    return results.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth").orderBy(F.desc("rank"), "shard", "doc_idx")


def summary(per_shard: DataFrame) -> DataFrame:
    """shard, matches, seconds: total matches, slowest time and the line that a user reads."""
    total = per_shard.agg(F.sum("matches").alias("matches"), F.max("seconds").alias("seconds"))
    return total.withColumn("line", F.format_string("Found %d matches in %.3f seconds", "matches", "seconds"))


def response(results: DataFrame) -> DataFrame:
    """url, title, snippet, rank of valid, non-empty URLs, and the same as JSON."""
    rows = results.filter(F.is_valid_utf8("url") & (F.col("url") != "")).select("url", clean_url(F.col("url")).alias("title"), F.lit("").alias("snippet"), "rank")
    return rows.withColumn("json", F.to_json(F.struct("url", "title", "snippet", "rank")))


def read_request(body: Column) -> Column:
    """query and urls of a request's JSON body."""
    return F.from_json(body, "query string, urls array<string>")


def snippets(parsed: DataFrame) -> DataFrame:
    """url, title, snippet of extracted pages, with what to show where a page gives nothing good."""
    title, snippet = T.decode_entities(T.join_words(F.col("title_words"))), T.decode_entities(T.join_words(F.col("description"), 30))
    rows = parsed.select("url", title.alias("t"), snippet.alias("s"))
    lost = F.contains(T.ascii_lower(F.col("t")), F.lit("page not found")) | F.contains(T.ascii_lower(F.col("s")), F.lit("page not found"))
    bad = ~F.is_valid_utf8("t") | (F.col("t") == "") | lost | F.col("t").rlike("^(http|www)")
    gone = ~F.is_valid_utf8("s") | F.contains(T.ascii_lower(F.col("s")), F.lit("page not found"))
    return rows.select("url", F.when(bad, clean_url(F.col("url"))).otherwise(F.col("t")).alias("title"), F.when(gone, "").otherwise(F.col("s")).alias("snippet"))


def register_functions(spark: SparkSession) -> None:
    """Make the page extraction and the arithmetic available in SQL text."""
    from dataclasses import astuple

    from ..functions.arith import evaluate
    from ..functions.html import SCHEMA, parse_html

    named: dict[str, tuple[Callable, str]] = {"html_parse": (lambda h: astuple(parse_html(h)), "struct<" + ", ".join(":".join(c.split(" ", 1)) for c in SCHEMA.split(", ")) + ">"), "evaluate": (evaluate, "string")}
    for name, (f, kind) in named.items():
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
