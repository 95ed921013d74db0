"""A Bloom filter as a table of 64-bit words, built and probed in DataFrame operations.

Positions come from double hashing of the MD5 of a key: (h1 + i * h2) mod 2**64 mod bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(keys: int, error: float) -> tuple[int, int]:
    """Bits and number of hashes for so many keys at so large an error."""
    bits = math.ceil(-keys * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits // keys * math.log(2)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    half = lambda at: F.conv(F.substring(F.md5(key), at, 16), 16, 10).cast("decimal(38,0)")
    wide = lambda i: F.expr("CAST(18446744073709551616 AS DECIMAL(38,0))")
    one = lambda i: (((half(1) + half(17) * F.lit(i).cast("decimal(10,0)")) % wide(i)) % F.lit(bits).cast("decimal(38,0)")).cast("bigint")
    return F.array(*(one(i) for i in range(hashes)))


def build(keys: DataFrame, col: str, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the words of the filter that aren't zero."""
    at = keys.select(F.explode(positions(F.col(col), bits, hashes)).alias("p")).distinct()
    mask = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(p % 64 AS INT))")
    return at.select(F.expr("p div 64").alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def probe(keys: DataFrame, col: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``keys`` (distinct) with maybe: false only for keys that weren't built in."""
    asked = keys.select(col, F.explode(F.array_distinct(positions(F.col(col), bits, hashes))).alias("p")).withColumn("word", F.expr("p div 64"))
    hit = F.coalesce(F.expr("mask & shiftleft(CAST(1 AS BIGINT), CAST(p % 64 AS INT))") != 0, F.lit(False))
    return asked.join(words, "word", "left").groupBy(col).agg(F.bool_and(hit).alias("maybe"))
