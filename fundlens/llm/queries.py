"""Registered queries of the subpackage: ``opN_<name>`` applies operator N,
with production parameters, to its whole table. ``SQL`` holds the DuckDB
twins where SQL can express the result; the others are tested against
brute force in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.llm import bpe, chat, exact, genetic, langid, lines, minhash, negatives, packing, suffix_dedup, topk, trie, urls

#: Vocabulary file of the registered queries; the operators take any path.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Bytes that a repeated passage of over 50 words reaches (as ``REPEAT_BYTES`` of the pipeline).
PASSAGE_BYTES = 240

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of the documents not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048, end_id=1)


@_query()
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and read the digests back from the output."""
    return chat.read_back(chat.format_chats(chat.with_probe(_table(spark, sf_dir, "conversations"))))


@_query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the bytes of all documents that 400-byte repeats cover; ``text_240``
    is the text without repeats of ``PASSAGE_BYTES``, shorter passages included."""
    out = suffix_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), width=400, also=PASSAGE_BYTES)
    return suffix_dedup.digest(out, text=True, also=PASSAGE_BYTES)


@_query()
def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; counts and digests of both."""
    ids = bpe.encode(_table(spark, sf_dir, "documents"), VOCABULARY)
    both = bpe.decode(ids, VOCABULARY)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query()
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 80 %."""
    return minhash.near_dedup(_table(spark, sf_dir, "documents"), size=4, percent=80)


@_query()
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the lines of all documents whose template recurs in ten or more."""
    out = lines.drop_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@_query(topk.ORACLE)
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector against all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query(urls.ORACLE)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the fixed rules."""
    return urls.judge_urls(_table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


@_query(exact.ORACLE)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of all documents."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


@_query(trie.ORACLE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, one row per node."""
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


@_query()
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into few sequences of at most 4096 tokens, cutting only longer ones."""
    return genetic.pack(_table(spark, sf_dir, "documents"), VOCABULARY, capacity=4096, end_id=1)


@_query(negatives.ORACLE)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector; every seventh vector's label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)
