import datetime

import __spark_entry__
from loomsearch import catalog
from loomsearch.streaming import crawl


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["chunk", "doc_idx", "url", "rank"] and rows.count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.QUERIES) > 50


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=3 * k), k % 4, "t", 1.0, "") for k in range(20)]
    for part in range(2):
        spark.createDataFrame(rows[part * 10:part * 10 + 10], crawl.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    from pyspark.sql import functions as F

    for name in ("a", "b"):  # a restarted query goes on where it was: nothing new
        links = crawl.read_events(spark, str(tmp_path / "events.parquet"), "*.parquet").select(F.concat(F.lit("http://a.org/"), "user_id").alias("url"), F.col("event_id").alias("rank"))
        crawl.dispatch(links, str(tmp_path / "check"), str(tmp_path / "queue"))
        assert spark.read.parquet(str(tmp_path / "queue")).count() == 4
    batch = crawl.rate(spark.createDataFrame(rows, crawl.EVENTS))
    assert batch.agg(F.sum("n")).first()[0] == 20 and batch.count() == 6
