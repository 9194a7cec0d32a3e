"""Ordered series in blocks of positions with borders.

An operation that looks at most ``before`` rows back and ``after`` rows ahead
does not need a series in one task: the series is cut into blocks of
positions, and each block also receives the few rows on either side that its
own rows look at. A row moves once, border rows twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
SIZE = 2048


def positions(df: DataFrame, order: str, by: Sequence[str] = (), name: str = "_i") -> DataFrame:
    """Position of each row in its series (from 1), ordered by ``order``.

    Without ``by`` the rows are one series: they are range-sorted over all
    partitions, and each partition is numbered on from the rows before it (one
    count per partition)."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order)
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint(eager=True)
    base, before = [], 0
    for r in ranged.groupBy("_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        base.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    starts = spark.createDataFrame(base, "_part int, _base long")              # a row per partition
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def with_borders(df: DataFrame, before: int, after: int = 0, size: int = SIZE, at: str = "_i") -> DataFrame:
    """Each row in its block (``_block``, ``_own`` true) and in those whose rows look at it."""
    first = F.floor((F.col(at) - 1 - after) / size)
    last = F.floor((F.col(at) - 1 + before) / size)
    rows = df.withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return rows.withColumn("_own", F.col("_block") == F.floor((F.col(at) - 1) / size))


def lag_sums(df: DataFrame, pairs: dict[str, tuple[str, str]], lags: Sequence[int], by: Sequence[str] = (), size: int = SIZE, at: str = "_i") -> DataFrame:
    """``(by, lag, name...)``: for every ``name: (a, b)`` the sum of ``a[t] * b[t - lag]`` over a series with
    gapless positions. Lags may be negative; a lag that no pair of rows has gives no row.

    A block holds its rows and the border in one sorted array; the products of a lag are sums over two slices of it,
    so that rows are never multiplied by lags."""
    reach = max((abs(k) for k in lags), default=0)
    cols = sorted({x for ab in pairs.values() for x in ab})
    rows = with_borders(df.select(*by, at, *cols), reach, 0, size, at)
    blocks = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct(at, *cols))).alias("_r"), F.count_if(~F.col("_own")).alias("_o"))
    blocks = blocks.where(F.col("_o") < F.size("_r"))                          # a block beyond the series holds border rows only
    blocks = blocks.select(*by, "_o", *[F.col("_r").getField(x).alias(f"_a_{x}") for x in cols])

    def total(a: str, b: str, k: Column) -> Column:
        start = F.greatest(F.col("_o").cast("int"), F.abs(k))                 # products whose later row is the block's own
        n = F.size(f"_a_{a}") - start
        part = lambda x, at: F.slice(f"_a_{x}", at + 1, F.greatest(n, F.lit(0)))
        products = F.zip_with(part(a, start - F.greatest(-k, F.lit(0))), part(b, start - F.greatest(k, F.lit(0))), lambda x, y: x * y)
        return F.when(n > 0, F.aggregate(products, F.lit(0.0), lambda s, x: s + x))

    # one expression for all lags: the plan does not grow with them
    wanted = F.array(*[F.lit(int(k)) for k in lags])
    each = blocks.select(*by, F.explode(F.transform(wanted, lambda k: F.struct(
        k.alias("lag"), *[total(a, b, k).alias(name) for name, (a, b) in pairs.items()]))).alias("_l"))
    out = each.select(*by, "_l.*").groupBy(*by, "lag").agg(*[F.sum(name).alias(name) for name in pairs])
    return out.dropna(subset=list(pairs), how="all")
