"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 of the text. New data comes in batches. A batch is reduced to one
row per digest and written (partial aggregation, so a text that a third of all rows share costs one row per task), then
sort-merge anti-joined with the index, whose side needs no shuffle, and the digests that are new are appended, sorted
within their buckets. A table without an earlier index is worked off in ``PARTS`` batches of descending doc_id, so that the row with the
largest doc_id is the one that the index holds.

Labels come from the index: a row per digest of the batch is joined with its bucket, and this summary with the rows by
``skew_join``, where digests of many rows are broadcast, 10 000 at most.

Defined cases: a null text counts as empty; a null doc_id is below every other id; of rows that repeat both doc_id and
text exactly one is kept; an empty table gives an empty result; further columns of the input are ignored by
``assign`` and carried through by ``keep_first``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, fresh_path, text_or_empty
from .graph import skew_join

#: Batches that a table without an earlier index is worked off in.
PARTS = 2


def digest_col(text: str = "text"):
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def fold(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n): one row per distinct pair, n rows each."""
    return docs.select("doc_id", digest_col().alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))


def classes(folded: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size), one row per distinct text."""
    return folded.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far: (digest, keep_id, group_size, batch), from the batch that brought each."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"loom_digests_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or fresh_path(spark, self.name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """Those of ``groups`` whose digest the index lacks. ``groups`` has a row per digest and is a written table: an aggregate would be joined before it folds its rows."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, folded: DataFrame, batch: str) -> None:
        """Add the digests of a batch that are new."""
        groups = cut(classes(folded), "classes")
        new = cut(self.fresh(groups), "new-digests") if self.exists() else groups  # a table can't be read and appended to in one plan
        (new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
         .mode("append").option("path", self.path).saveAsTable(self.name))
        discard(groups, new)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _labelled(docs: DataFrame, index: DigestIndex | None, parts: int) -> tuple[DataFrame, DataFrame]:
    """The folded batch, and a row per digest of it: digest, keep_id, group_size, earlier (an earlier batch brought it), n (rows in this batch), own (largest doc_id in it)."""
    spark = docs.sparkSession
    work = index or DigestIndex(spark)
    batch = uuid.uuid4().hex
    folded = cut(fold(docs), "folded")
    if parts > 1:
        cuts = folded.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts - 1, 0, -1)]).alias("c")).first().c or []
        rest = folded
        for low in cuts:
            work.append(rest.filter(F.col("doc_id") >= low), batch)
            rest = rest.filter(F.col("doc_id").isNull() | (F.col("doc_id") < low))
        work.append(rest, batch)
    else:
        work.append(folded, batch)
    mine = folded.groupBy("digest").agg(F.sum("n").alias("n"), F.max("doc_id").alias("own"))
    earlier = F.col("batch") != batch
    held = work.table().hint("merge").join(mine, "digest")
    out = cut(held.select("digest", "keep_id", F.when(earlier, F.col("group_size") + F.col("n")).otherwise(F.col("n")).alias("group_size"), earlier.alias("earlier"), "n", "own"), "labels")
    if index is None:
        work.drop()
    return folded, out


def assign(docs: DataFrame, index: DigestIndex | None = None, parts: int = PARTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, of the batch ``docs``.

    With an index, the batch's digests are appended to it, and a text that an earlier batch brought is not kept again:
    its keep_id is the earlier row's, its group_size counts the rows of the batch that brought it and of this one.
    """
    folded, labels = _labelled(docs, index, parts)
    one = labels.filter("n = 1").select(F.col("own").alias("doc_id"), "digest", "keep_id", "group_size", "earlier", F.lit(1).cast("bigint").alias("i"))
    many = cut(labels.filter("n > 1").select("digest", "keep_id", "group_size", "earlier", F.col("n").alias("rows"), "n"), "repeated")
    rows = skew_join(folded.withColumnRenamed("n", "times"), many, "digest", folded.count())
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    both = one.unionByName(rows.select(*one.columns))
    return both.select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        (~F.col("earlier") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None, parts: int = PARTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: per text the one with the largest doc_id."""
    folded, labels = _labelled(docs, index, parts)
    shared = cut(labels.filter("n > 1 or earlier"), "shared")
    stays = ~F.col("earlier") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    narrow = skew_join(folded.withColumnRenamed("n", "times"), shared, "digest", folded.count())
    marked = cut(narrow.select(F.col("doc_id").alias("__loom_id"), F.col("digest").alias("__loom_digest"), stays.alias("stays"), "times"), "marked")
    discard(folded, labels, shared)
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__id"), digest_col().alias("__digest"))

    def pick(how: str, keys: DataFrame) -> DataFrame:
        match = F.col("__id").eqNullSafe(F.col("__loom_id")) & (F.col("__digest") == F.col("__loom_digest"))
        return inner.join(keys.select("__loom_id", "__loom_digest"), match, how)

    ties = marked.filter("stays and times > 1")
    if ties.isEmpty():
        return pick("left_anti", marked.filter("not stays")).select("row.*")
    kept = pick("left_anti", marked.filter("not stays or times > 1"))
    return kept.unionByName(pick("left_semi", ties).dropDuplicates(["__id", "__digest"])).select("row.*")
