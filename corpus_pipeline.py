"""A training corpus from ``documents``: language ID, exact dedup, near dedup, a mix of sources, token ids.

Each stage is written as Parquet and read again by the next one. Documents without a known language go; of equal texts
the largest doc_id stays; of each group of near copies the smallest; the mix then repeats or drops whole documents by
their source's target; the last stage returns the token ids, with a check that they decode to the text.

Defined cases: a null or empty text, or one without a letter, has no known language and goes in the first stage, so an empty table, or one
without labels, gives an empty result; of rows that repeat a doc_id and a text one stays, rows that repeat a doc_id with other texts are documents of their own; a null
doc_id is kept, as the least; ties between languages go to the first in code-point order; texts of any length are read whole;
further columns of ``documents`` are carried through the first four stages, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.llm import bpe, exact_dedup, language_id, minhash, mixing
from loomsearch.llm.common import cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    passages = language_id.sample(docs, ~language_id.held_out(F.col("doc_id")))
    return language_id.keep_known(docs, passages)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, round_trip, a row per document of the mix."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ("doc_id", "source", "text"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("language_id", known_language), ("exact_dedup", exact), ("minhash", near), ("source_mix", mixed), ("bpe", tokens)]

#: The automata of the first stage and the merges of the last have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
