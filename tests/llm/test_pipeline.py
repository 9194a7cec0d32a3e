"""The corpus pipeline and the registered queries on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMOKE
from tools.oracle_check import TABLES, rows_of

from fundlens.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMOKE}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = QUERIES[name](spark, SMOKE)
    cols = sorted(df.columns)
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert rows_of([r.asDict() for r in df.collect()], cols) == rows_of([dict(zip(names, r)) for r in res.fetchall()], cols)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "x", 0), (9002, "123 456", None, "x", 7), (9003, "", "en", "x", 0)], docs.schema)
    docs, counts = docs.union(extra), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMOKE).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
        counts.append(docs.count())
        if name == "language_id":
            assert counts[-1] == 200 and docs.where("doc_id > 9000").isEmpty()
    assert counts[2] < counts[1] and counts[3] == counts[2]
    assert docs.select("doc_id").distinct().count() == counts[3]


def test_run_on_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_leave_one(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(5, text, "en", "s", 0), (3, text + " tail", "en", "s", 0), (None, text, "en", "s", 0), (8, "something else entirely", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SMOKE).collect()
    assert sorted(r.doc_id for r in kept) == [3, 8]
    lone = " ".join(f"other{k}" for k in range(200))
    rows += [(None, lone, "en", "s", 0), (None, lone + " tail", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SMOKE).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 8]          # one of the two without ids


def test_a_passage_of_51_words_goes(spark):
    """Two different documents share it: no other stage removes it."""
    passage = " ".join(f"w{k:03d}" for k in range(51))
    rows = [(i, " ".join(f"{side}{k}" for k in range(120)) + " " + passage + " " + " ".join(f"{side}z{k}" for k in range(120)), "en", "s", 0)
            for i, side in enumerate(("left", "right"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SMOKE)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(kept) == [0, 1]
    for i, side in enumerate(("left", "right")):
        assert kept[i].startswith(f"{side}0 ") and kept[i].endswith(f" {side}z119") and "w025" not in kept[i]


def test_arrow_batches_are_bounded(spark):
    from fundlens.llm.common import BATCH_BYTES, arrow_map

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for setting, want in (("64m", BATCH_BYTES), ("1g", BATCH_BYTES), ("100000b", 100_000), ("4m", 4 << 20)):
            spark.conf.set(key, setting)
            arrow_map(spark.range(1), lambda it: it, "id long")
            now = spark.conf.get(key)
            assert int(now.rstrip("bm")) * (1 << 20 if now.endswith("m") else 1) == want
    finally:
        spark.conf.set(key, before)
