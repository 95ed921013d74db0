"""The frontier of URLs to fetch: link extraction, dedupe, host caps, refill, checkpoints. Batch forms; see ``streaming`` for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U

HOST_CAP, CAPACITY, SAMPLE, BEST, SEED_RANK = 10_000, 500_000, 200_000, 100_000, 10


def seeds(lines: DataFrame) -> DataFrame:
    """url, host, rank of a list with one URL per line (column value)."""
    return lines.filter(F.trim("value") != "").select(F.trim("value").alias("url")).withColumn("host", U.frontier_host(F.col("url"))).withColumn("rank", F.lit(SEED_RANK).cast("bigint"))


def links(parsed: DataFrame) -> DataFrame:
    """page_id, at, link, url, host, rank of each usable link; a link inherits its page's static rank (column static_rank)."""
    rows = parsed.select("page_id", F.col("url").alias("page_url"), F.col("static_rank").cast("bigint").alias("rank"), F.posexplode("links").alias("at", "link"))
    rows = rows.filter(U.is_followable(F.col("link"))).withColumn("url", U.resolve(F.col("page_url"), F.col("link")))
    rows = rows.filter(U.is_crawlable(F.col("url")))
    return rows.select("page_id", "at", "link", U.canonical(F.col("url")).alias("url"), U.frontier_host(F.col("url")).alias("host"), "rank")


def fresh(found: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per URL of ``found`` that ``seen`` lacks, with its best rank."""
    once = found.groupBy("url").agg(F.max("rank").alias("rank"))
    return once.join(seen.select("url"), "url", "left_anti").withColumn("host", U.frontier_host(F.col("url")))


#: Parts that a host's rows are first capped in, so that a hot host isn't one task.
SALTS = 64


def cap_hosts(found: DataFrame, cap: int = HOST_CAP, arrival: str = "url") -> DataFrame:
    """The first ``cap`` rows of each host by ``arrival``: of each part of a host, then of what the parts leave."""
    order = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(arrival, "url"))
    parts = found.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS))).withColumn("nth", order("host", "salt")).filter(F.col("nth") <= cap)
    return parts.withColumn("nth", order("host")).filter(F.col("nth") <= cap).drop("nth", "salt")


def best(found: DataFrame, k: int | None = BEST) -> DataFrame:
    """The k best rows in order; all, as they come, without k."""
    return found if k is None else found.orderBy(F.desc("rank"), "url").limit(k)


def refill(found: DataFrame, sample: int = SAMPLE, k: int = BEST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(queue, rest): of a random sample the k best by rank, and what stays behind."""
    drawn = found.withColumn("draw", F.xxhash64(F.lit(seed), "url")).orderBy("draw", "url").limit(sample)
    queue = best(drawn.drop("draw"), k)
    return queue, found.join(queue.select("url"), "url", "left_anti")


def save(frontier: DataFrame, path: str) -> None:
    """All rows as 'url host rank' lines."""
    frontier.select(F.concat_ws(" ", "url", "host", F.col("rank").cast("string")).alias("value")).write.mode("overwrite").text(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, host string, rank bigint").option("sep", " ").csv(path)
