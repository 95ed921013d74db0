"""What the findings of round 3 asked for."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsearch.functions import html, tokens
from loomsearch.functions import text as T
from loomsearch.sources import index as ix

# the index


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    marks = ["&#039;", "&#", "&nbsp", "&lrm", "&rlm", "&amp;", "&"]
    some = ["".join(rng.choices([*"aBz09'--.!é日😀\v\f\0  \u0085", *marks], k=rng.choice([1, 2, 3, 5, 9, 30]))) for _ in range(1500)]
    some += ["x" * n for n in (49, 50, 51)] + ["é" * 25 + "a", "é" * 24 + "aa", "x" * 47 + "&#039;", "a&#039;" * 9 + "b" * 40, "-", "--a--b--", "a-'-b", "'", "&'#a", "a&'#b", "-'a'-"]
    return ["", *(rng.choice([" ", "\t", "\r\n", ""]).join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(800)), "", *some, None, " ", "a", "b", ""]


def test_terms_like_the_expressions(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    want = [r.t for r in rows.select("id", T.terms(F.col("text")).alias("t")).orderBy("id").collect()]
    given = pa.array([t or "" for t in texts])
    assert tokens.terms_of_texts(given).to_pylist() == want
    assert tokens.terms_of_texts(given.slice(7, 90)).to_pylist() == want[7:97] and tokens.terms_of_texts(given.slice(0, 0)).to_pylist() == []
    raw = [[w for w in (t or "").split(" ") if w] for t in texts]
    rows = spark.createDataFrame(list(enumerate(raw)), "id bigint, raw array<string>")
    want = [r.t for r in rows.select("id", T.index_terms(F.col("raw")).alias("t")).orderBy("id").collect()]
    lists = pa.array(raw, pa.list_(pa.string()))
    assert tokens.terms_of_words(lists).to_pylist() == want and tokens.terms_of_words(lists.slice(5, 700)).to_pylist() == want[5:705]


def test_postings_without_a_shuffle(spark, texts, monkeypatch):
    """The postings of documents with titles, in several runs, are those that grouping all occurrences gives, and nothing is shuffled."""
    ids = [None, *range(1, len(texts))]
    rows = spark.createDataFrame(list(zip(ids, texts, texts[::-1], strict=True)), "doc_idx bigint, text string, title string")
    corpus = rows.select("doc_idx", F.pmod("doc_idx", F.lit(5)).cast("int").alias("chunk"), F.lit("u").alias("url"), F.lit(0).alias("static_rank"), T.terms(F.col("title")).alias("title_terms"), T.terms(F.col("text")).alias("body_terms"))
    got = ix.postings_of(corpus, ix.docs_of(corpus))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = ix.group_postings(ix.occurrences(corpus))
    key = lambda r: (r.chunk is not None, r.chunk, r.term, r.field, r.doc_idx is not None, r.doc_idx, r.positions)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    monkeypatch.setattr(tokens, "RUN_TOKENS", 500)
    batch = pa.record_batch({"chunk": pa.array([k % 3 for k in range(600)], pa.int32()), "doc_idx": pa.array(range(600)), "title_terms": pa.array([["b", "a"]] * 600), "body_terms": pa.array([["a", "c", "a"]] * 600)})
    runs = [b.to_pylist() for b in tokens.postings(iter([batch.slice(0, 250), batch.slice(250)]))]
    assert len(runs) == 6 and all(run == sorted(run, key=lambda r: (r["chunk"], r["term"], r["field"], r["doc_idx"])) for run in runs)
    assert sorted((r["doc_idx"], r["term"], r["field"], r["positions"]) for run in runs for r in run) == [x for k in range(600) for x in ((k, "a", "body", [3, 5]), (k, "a", "title", [2]), (k, "b", "title", [1]), (k, "c", "body", [4]))]


def test_repeated_ids_are_one_posting(spark, tmp_path):
    rows = [(7, "apple fig apple"), (7, "fig date"), (None, "fig"), (None, "fig kiwi"), (8, "apple")]
    index = ix.write(ix.corpus_from_documents(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))), str(tmp_path / "i"))
    got = {(r.doc_idx, r.term): r.positions for r in index.postings.collect()}
    assert got == {(7, "apple"): [1, 3], (7, "fig"): [1, 2], (7, "date"): [2], (None, "fig"): [1, 1], (None, "kiwi"): [2], (8, "apple"): [1]}
    assert {r.term: (r.df, r.cf) for r in index.dictionary.collect()} == {"apple": (2, 3), "fig": (2, 4), "date": (1, 1), "kiwi": (1, 1)} and index.docs.count() == 5


# F4 to F8, F10, F11: pages in the workers


def test_few_pages_are_parsed_at_once(spark):
    """A batch of many pages leaves the parser in parts of bounded size, and Spark's batches are bounded by bytes."""
    pages = [f"<html lang=en><title>T{k}</title><a href='/{k}'>w</a> " + "word " * 20_000 for k in range(100)]
    batch = pa.record_batch({"html": pa.array(pages), "page_id": pa.array(range(100))})
    parts = list(html.parser(["page_id"], ("links", "n_words", "title_terms"))(iter([batch])))
    assert len(parts) >= 5 and max(map(len, parts)) <= tokens.GROUP_BYTES // 100_000
    assert [r for p in parts for r in p.to_pylist()] == [{"page_id": k, "links": [f"/{k}"], "n_words": 20_001, "title_terms": [f"t{k}"]} for k in range(100)]
    html.parse_pages(spark.createDataFrame([(1, "x")], "page_id bigint, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_groups():
    assert list(tokens.groups(np.array([3, 3, 9, 1, 1, 0, 0]), 6)) == [(0, 2), (2, 3), (3, 7)] and list(tokens.groups(np.array([], int), 6)) == []
