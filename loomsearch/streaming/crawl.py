"""The crawl as Structured Streaming: exact dedupe of an unbounded list of links, host caps, refills, rates.

State lives in the query's checkpoint, which a restarted query continues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..operators import frontier

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, a file or a directory of files; ``files_per_trigger`` bounds a batch."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder)


def rate(events: DataFrame, width: str = "10 seconds", late: str | None = None) -> DataFrame:
    """start, n: events per tumbling window; with ``late``, windows so old are closed and their state goes."""
    rows = events.withWatermark("ts", late) if late else events
    counted = rows.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "n")


def fresh_links(links: DataFrame, late: tuple[str, str] | None = None) -> DataFrame:
    """Each URL once. ``late`` (time column, delay) bounds the state: a URL seen within the delay isn't repeated."""
    usable = links.filter(U.is_crawlable(F.col("url"))).withColumn("url", U.canonical(F.col("url")))
    if late:
        return usable.withWatermark(*late).dropDuplicatesWithinWatermark(["url"])
    return usable.dropDuplicates(["url"])


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Work off all that is there, batch by batch, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dispatch(links: DataFrame, checkpoint: str, queue_path: str, cap: int | None = frontier.HOST_CAP, k: int | None = frontier.BEST) -> StreamingQuery:
    """Append each batch's best new URLs, with a cap per host (None: no bound), to the queue, tagged with the batch that orders them.

    A batch that runs again after a failure overwrites its own part.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("host", U.frontier_host(F.col("url")))
        frontier.best(rows if cap is None else frontier.cap_hosts(rows, cap), k).write.mode("overwrite").parquet(f"{queue_path}/batch={number}")

    return run_once(fresh_links(links), checkpoint, each)
