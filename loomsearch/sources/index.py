"""The positional index as tables: docs, postings and dictionary.

Postings hold a row per chunk, term, field and document, with its positions in ascending order. Each task writes those of its
documents, sorted by term within a chunk, so that the statistics of Parquet's pages skip what a query's terms don't need. A
document's postings come from its row alone, so nothing is shuffled, and a common term is spread as its documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.batches import keep_small, tidy
from ..functions.html import parse_pages
from ..operators.static_rank import static_rank

CHUNKS = 5
#: Row groups of the table of tokens, which tasks are dealt by.
SPLIT_BYTES = 8 << 20
DOCS = "doc_idx bigint, url string, static_rank int, n_tokens int, chunk int"
POSTINGS = "term string, field string, doc_idx bigint, positions array<int>, chunk int"


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """doc_idx, chunk, url, static_rank, title_terms, body_terms of plain documents; their URLs are made up from source, language and id."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    url = F.concat(F.lit("https://"), some("source"), F.lit(".example.org/"), some("lang"), F.lit("/"), some("doc_id"))
    base = documents.select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("doc_idx"), F.pmod("doc_id", F.lit(CHUNKS)).cast("int").alias("chunk"), url.alias("url"), F.lit(0).alias("static_rank"))
    keep_small(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in tokens.groups(tokens.sizes(batch.column(0)), tokens.GROUP_BYTES):
                part = batch.slice(start, stop - start)
                kept = {name: part.column(k + 1) for k, name in enumerate(batch.schema.names[1:])}
                yield pa.record_batch(kept | {"title_terms": pa.array([[]] * len(part), pa.list_(pa.string())), "body_terms": tokens.terms_of_texts(part.column(0))})

    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema[1:])
    return base.mapInArrow(tidy(run), shape + "title_terms array<string>, body_terms array<string>")


def corpus_from_pages(pages: DataFrame, english_only: bool = True) -> DataFrame:
    """The same of HTML pages: extracted, only English ones unless told otherwise, with canonical URLs and static ranks."""
    from ..functions.urls import canonical

    parsed = parse_pages(pages.select("page_id", "url", "html"), columns=("img_count", "n_links", "n_words", "is_english", "title_terms", "body_terms"))
    if english_only:
        parsed = parsed.filter("is_english")
    return parsed.select(
        F.col("page_id").alias("doc_idx"), F.pmod("page_id", F.lit(CHUNKS)).cast("int").alias("chunk"), canonical(F.col("url")).alias("url"),
        static_rank(F.col("url"), F.col("img_count"), F.col("n_links"), F.col("n_words")).alias("static_rank"), "title_terms", "body_terms")


def occurrences(corpus: DataFrame) -> DataFrame:
    """chunk, doc_idx, field, term, pos: one row per token. Title terms come first and share the counter with the body."""
    tag = lambda c, field: F.transform(c, lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))
    both = F.concat(tag("title_terms", "title"), tag("body_terms", "body"))
    return corpus.select("chunk", "doc_idx", F.posexplode(both).alias("at", "t")).select("chunk", "doc_idx", "t.field", "t.term", (F.col("at") + 1).alias("pos"))


def group_postings(rows: DataFrame) -> DataFrame:
    """Postings of ``occurrences``, by a shuffle."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["chunk", "term", "field", "doc_idx"]
    return rows.repartitionByRange(n, *key).groupBy(*key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def postings_of(corpus: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings from each row of ``corpus``; those of documents that ``docs`` lists more than once are grouped by a shuffle, as each is one posting."""
    keep_small(corpus.sparkSession)
    own = lambda rows: rows.select("chunk", "doc_idx", "title_terms", "body_terms").mapInArrow(tidy(tokens.postings), POSTINGS)
    repeated = docs.groupBy("chunk", "doc_idx").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("chunk").alias("c"), F.col("doc_idx").alias("d"))
    if repeated.isEmpty():
        return own(corpus)
    same = F.col("chunk").eqNullSafe(F.col("c")) & F.col("doc_idx").eqNullSafe(F.col("d"))
    grouped = group_postings(occurrences(corpus.join(repeated, same, "left_semi")))
    return own(corpus.join(repeated, same, "left_anti")).unionByName(grouped)


def docs_of(corpus: DataFrame) -> DataFrame:
    return corpus.select("chunk", "doc_idx", "url", "static_rank", (F.size("title_terms") + F.size("body_terms")).alias("n_tokens"))


def dictionary_of(postings: DataFrame) -> DataFrame:
    """term, df (documents), cf (occurrences) of body terms."""
    return postings.filter("field = 'body'").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).alias("cf"))


def write(corpus: DataFrame, path: str) -> Index:
    """Write the three tables below ``path``, partitioned by chunk, and open them. Texts are tokenised once, into a table that goes at the end."""
    spark, tokenised = corpus.sparkSession, f"{path}/tokenised"
    corpus.write.option("parquet.block.size", str(SPLIT_BYTES)).parquet(tokenised)
    corpus = spark.read.schema(corpus.schema).parquet(tokenised)
    docs_of(corpus).write.partitionBy("chunk").parquet(f"{path}/docs")
    docs = spark.read.schema(DOCS).parquet(f"{path}/docs")
    postings_of(corpus, docs).sortWithinPartitions("chunk", "term", "field", "doc_idx").write.partitionBy("chunk").parquet(f"{path}/postings")
    dictionary_of(spark.read.schema(POSTINGS).parquet(f"{path}/postings")).write.parquet(f"{path}/dictionary")
    where = spark._jvm.org.apache.hadoop.fs.Path(tokenised)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return load(spark, path)


def load(spark: SparkSession, path: str, chunks: list[int] | None = None) -> Index:
    """Open an index, or some of its chunks; chunks that don't exist are simply absent."""
    docs, postings = (spark.read.schema(schema).parquet(f"{path}/{t}") for t, schema in (("docs", DOCS), ("postings", POSTINGS)))
    if chunks is not None:
        docs, postings = (t.filter(F.col("chunk").isin(chunks)) for t in (docs, postings))
    return Index(docs, postings, spark.read.parquet(f"{path}/dictionary"))


def _order(doc_idx: int, pos: int) -> Column:
    return (F.col("doc_idx") > doc_idx) | ((F.col("doc_idx") == doc_idx) & (F.col("pos") >= pos))


def find(postings: DataFrame, term: str, doc_idx: int = 0, pos: int = 0, field: str = "body") -> DataFrame:
    """Per chunk the first occurrence of ``term`` at or after a location, with the number of its occurrences in the chunk (cf)."""
    rows = postings.filter((F.col("term") == term) & (F.col("field") == field))
    first = rows.select("chunk", "doc_idx", F.explode("positions").alias("pos"), F.size("positions").alias("n"))
    at = F.min(F.when(_order(doc_idx, pos), F.struct("doc_idx", "pos"))).alias("at")
    counts = rows.groupBy("chunk").agg(F.sum(F.size("positions")).alias("cf"))
    return first.groupBy("chunk").agg(at).join(counts, "chunk").filter("at IS NOT NULL").select("chunk", "at.doc_idx", "at.pos", "cf")


def positions_between(postings: DataFrame, term: str, doc_idx: int, start: int, end: int, field: str = "body") -> DataFrame:
    """doc_idx, pos of a term's occurrences in one document with start < pos < end."""
    rows = postings.filter((F.col("term") == term) & (F.col("field") == field) & (F.col("doc_idx") == doc_idx))
    return rows.select("doc_idx", F.explode("positions").alias("pos")).filter((F.col("pos") > start) & (F.col("pos") < end))


def lookup(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of ``keys`` (chunk, doc_idx), joined after matching."""
    return keys.join(docs, ["chunk", "doc_idx"])
