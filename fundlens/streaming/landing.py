"""Incremental landing of the daily fund report.

The source publishes one report per day as JSON text. Landing is the only
streaming step: new files in ``inbox`` are read with the declared text
schema, typed (``typed_facts``), and appended to the Parquet fact store
partitioned by year, exactly once (the query's checkpoint tracks which
files were processed). ``availableNow`` processes whatever arrived and
stops, so the job runs like a batch on a schedule and survives restarts
and executor loss. Everything downstream reads the fact store in batch
(``sources.landed.read_landed`` + ``fund_facts``), as the source system's
consumers re-read a date range per run.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fundlens.sources.landed import RAW_FACTS_SCHEMA, typed_facts


def land_reports(spark: SparkSession, inbox: str, store: str, checkpoint: str | None = None,
                 fmt: str = "json", max_files_per_trigger: int | None = None):
    """Start (and wait for) an ``availableNow`` landing run; returns the query.

    The checkpoint belongs to the store: by default it lies next to it, so a
    restarted job, in whatever process, goes on where the last one stopped.
    """
    reader = spark.readStream.schema(RAW_FACTS_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(inbox)
    typed = typed_facts(raw).withColumn("anio", F.year("fecha_corte"))
    ckpt = checkpoint or f"{store.rstrip('/')}_checkpoint"
    query = (typed.writeStream.format("parquet").option("path", store)
             .option("checkpointLocation", ckpt).partitionBy("anio")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def read_store(spark: SparkSession, store: str):
    """The landed fact store (typed columns, partition column dropped)."""
    return spark.read.parquet(store).drop("anio")
