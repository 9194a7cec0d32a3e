"""Session helpers: sane defaults for local runs, checkpoint directory policy."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_TABLES: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fundlens") -> SparkSession:
    """A local session for tests and benchmarks.

    On a cluster, build the session with the cluster's own settings; the
    library never assumes local mode.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FUNDLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession) -> tuple:
    """Identity of a live session for caches of plans bound to it: the
    application id changes with every SparkContext, so a stopped session's
    DataFrames are never served to a new one."""
    return (spark.sparkContext.applicationId, id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session and never overridden. Only when it is unset (local
    tests) a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="fundlens-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def materialize_bucketed(df, keys, sort_by=(), buckets: int | None = None, name: str = "panel"):
    """Write ``df`` as a table bucketed (and sorted) by ``keys`` in the
    checkpoint folder and read it back.

    Unlike a checkpoint, the scan of a bucketed table reports its hash
    partitioning, so later aggregates, windows and joins on ``keys`` run
    without shuffling this table (only the other side of a join moves).
    The bucket count defaults to ``spark.sql.shuffle.partitions``; size it
    so that a bucket fits comfortably in a task.
    """
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"fundlens_{name}_{uuid.uuid4().hex[:12]}"
    path = f"{root}/tables/{table}"
    writer = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(n, *keys)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    writer.saveAsTable(table)
    _TABLES.append((spark, table))
    return spark.table(table)


def drop_materialized() -> None:
    """Drop the tables of ``materialize_bucketed`` from the catalogs of live
    sessions. Their files stay in the checkpoint folder, whose life cycle is
    the cluster's."""
    while _TABLES:
        spark, table = _TABLES.pop()
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
