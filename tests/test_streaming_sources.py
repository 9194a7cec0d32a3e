"""Landing (streaming) and landed-file scans."""

import datetime as dt
import os
import subprocess
import sys

from pyspark.sql import functions as F

from conftest import ROOT, SMOKE
from fundlens.sources import adapter
from fundlens.sources.landed import RAW_FACTS_SCHEMA, fund_facts, read_landed
from fundlens.streaming import land_reports, read_store


def test_landing_is_incremental_and_exactly_once(spark, tmp_path):
    text = adapter.fund_rows_text(spark, SMOKE, None)
    inbox, store, ckpt = str(tmp_path / "inbox"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    early = text.where(F.col("fecha_corte") < "1998")
    late = text.where(F.col("fecha_corte") >= "1998")
    early.write.mode("append").json(inbox)
    land_reports(spark, inbox, store, ckpt)
    n1 = read_store(spark, store).count()
    assert n1 == early.count()
    late.write.mode("append").json(inbox)
    land_reports(spark, inbox, store, ckpt)
    land_reports(spark, inbox, store, ckpt)          # nothing new: no duplicates
    landed = read_store(spark, store)
    assert landed.count() == text.count()
    typed = adapter.fund_rows(spark, SMOKE, None)
    assert landed.select(*typed.columns).exceptAll(typed).count() == 0


def test_restart_in_another_process_finds_nothing_new(spark, tmp_path):
    """The default checkpoint belongs to the store, whatever the process."""
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    text = adapter.fund_rows_text(spark, SMOKE, None).limit(50)
    text.write.json(inbox)
    n = read_n = spark.read.json(inbox).count()
    code = ("from fundlens.session import local_session; from fundlens.streaming import land_reports; "
            f"land_reports(local_session(2, 2), {inbox!r}, {store!r})")
    for seed in ("1", "2"):
        subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=300,
                       env={**os.environ, "PYTHONHASHSEED": seed, "FUNDLENS_DRIVER_MEMORY": "1g"})
        read_n = read_store(spark, store).count()
    assert read_n == n == 50


def test_scan_landed_json_with_schema(spark, tmp_path):
    path = str(tmp_path / "raw")
    adapter.fund_rows_text(spark, SMOKE, None).write.json(path)
    raw = read_landed(spark, path, RAW_FACTS_SCHEMA, "json")
    facts = fund_facts(raw, dt.date(1999, 1, 1), dt.date(2000, 12, 31))
    assert facts.agg(F.min("fecha_corte"), F.max("fecha_corte")).first()[0] >= dt.date(1999, 1, 1)
    assert facts.where(F.split("cod", "_").getItem(2) == "7").count() == 0
    assert "transaccciones_netas" in facts.columns and "aportes_recibidos" not in facts.columns
