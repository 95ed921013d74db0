"""Files as sources: JSON lines, text, directory listings, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import parse_pages

RECORD = "url string, rank int, content string"


def json_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """url, rank, content of one record per line, content as a list of words. Bad lines are dropped, or with ``strict`` fail."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    listed = F.from_json("content", "array<string>")
    return rows.filter("url IS NOT NULL").select("url", "rank", F.when(F.startswith("content", F.lit("[")), listed).otherwise(T.words(F.col("content"))).alias("content"))


def text_words(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    rows = spark.read.text(path)
    return rows.filter(F.trim("value") != "").select(F.col("value").alias("word")) if by_line else rows.select(F.explode(T.words(F.col("value"))).alias("word"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths of all files below a directory, sorted; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path").distinct().orderBy("path")


def word_totals(spark: SparkSession, path: str) -> DataFrame:
    """Words per file below a directory."""
    files = spark.read.text(path, recursiveFileLookup=True).select(F.input_file_name().alias("file"), T.word_count(F.col("value")).alias("n"))
    return files.groupBy("file").agg(F.sum("n").cast("bigint").alias("n"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path and the extracted columns of each HTML file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_pages(files.select(F.input_file_name().alias("path"), F.col("value").alias("html")))


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that a fetch brought home, where a status is recorded: 0 is success."""
    return pages.filter("status = 0") if "status" in pages.columns else pages
