"""Counts of words and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def word_counts(docs: DataFrame, col: str = "text", by_line: bool = False) -> DataFrame:
    """word, n of white-space words, or of whole lines."""
    unit = T.lines if by_line else T.words
    return docs.select(F.explode(unit(F.col(col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(k)


def lookup(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (word) with its count, 0 if it doesn't occur."""
    return wanted.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def token_stats(docs: DataFrame, col: str = "text") -> DataFrame:
    """tokens, chars and mean length of words."""
    w = docs.select(F.explode(T.words(F.col(col))).alias("word"))
    return w.agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.octet_length("word")).cast("bigint").alias("chars")).withColumn("mean_length", F.col("chars") / F.col("tokens"))


def words_by(docs: DataFrame, group: str, col: str = "text") -> DataFrame:
    """Words per group, and of all."""
    per = docs.groupBy(group).agg(F.sum(T.word_count(F.col(col))).cast("bigint").alias("n"))
    return per.withColumn("total", F.sum("n").over(W.partitionBy()))


def containing_all(docs: DataFrame, words: list[str], col: str = "text") -> DataFrame:
    """How many documents hold all the words, by brute force over their word arrays."""
    has = T.words(F.col(col))
    rows = docs.filter(F.size(F.array_intersect(has, F.array(*map(F.lit, words)))) == len(set(words)))
    return rows.agg(F.count(F.lit(1)).alias("n"))
