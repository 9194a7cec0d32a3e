"""The corpus pipeline: documents to packed training sequences.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.llm import langid, lines, minhash, packing, suffix_dedup
from fundlens.llm.common import written
from fundlens.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes that a repeated passage of over 50 words reaches: 51 words that two documents of sf0.01 share take 245 or more.
REPEAT_BYTES = 240

#: Stages have no SQL form (a trained model, template clustering, sketches, byte spans, a solved plan).
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, empty, no letter) go;
    a missing ``lang`` is filled with the prediction."""
    model = langid.train(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    out = langid.predict(docs.select(*COLUMNS), model, lang_out="_pred", score_out="_score")
    return out.where("_pred != 'und'").withColumn("lang", F.coalesce("lang", "_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go, except in the first
    of them; documents that lose all their words go."""
    out = lines.drop_lines(docs, carry=("lang", "source"))
    return _documents(out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id (a
    row that occurs twice under one id stays twice: it is one document).
    Groups are of five-word shingles with a similarity of 0.8 or more."""
    groups = minhash.near_dedup(docs, size=5, percent=80, row_key="_row")
    kept = groups.where("kept").select("_row").distinct()
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte covered by a ``REPEAT_BYTES``-byte string that also starts elsewhere
    is removed; bytes of a character that a cut has split go with it."""
    out = suffix_dedup.dedup_substrings(docs, width=REPEAT_BYTES, carry=("lang", "source"), as_text=True)
    return _documents(out.withColumnRenamed("kept", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack(docs, VOCABULARY, capacity=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", near_dedup),
    ("suffix_dedup", suffix_array_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
