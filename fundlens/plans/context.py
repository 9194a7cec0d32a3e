"""Shared inputs of the registered queries: the stand-in sources of one
``sf_dir`` and the date parameters derived from it.

``as_of`` (the source's "today") is the last ship date of the fact source.
It is fetched once per (session, sf_dir) as a scalar so that every date
predicate is a literal and reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

import datetime as _dt
import threading
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.dates import py_add_months, py_floor_year
from fundlens.operators.dims import clean_dims
from fundlens.operators.runs import expand_days, run_panel
from fundlens.sources import adapter
from fundlens.session import drop_materialized, materialize_bucketed, session_key
from fundlens.sources.landed import fund_dims_raw, fund_facts, report_rows

_AS_OF_CACHE: dict[tuple, _dt.date] = {}
_TABLE_CACHE: dict[tuple, DataFrame] = {}
_LOCK = threading.RLock()
CACHE_TABLES = True  # reuse materialised panels across queries of one session
ROWS_PER_BUCKET = 100_000  # of lineitem: a bucket of runs lists some hundred thousand days, and a task sorts one bucket


def clear_cache() -> None:
    """Forget all shared intermediates and drop their tables from the catalog."""
    with _LOCK:
        _TABLE_CACHE.clear()
        _AS_OF_CACHE.clear()
    drop_materialized()


FACTS_STATUS = "F"   # facts come from these line-status rows ...
REPORT_STATUS = "O"  # ... and the report extract from the others


def as_of(spark: SparkSession, sf_dir: str) -> _dt.date:
    key = (session_key(spark), sf_dir)
    if key not in _AS_OF_CACHE:
        li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        _AS_OF_CACHE[key] = li.agg(F.max(F.to_date("l_shipdate"))).first()[0]
    return _AS_OF_CACHE[key]


@dataclass
class Ctx:
    spark: SparkSession
    sf_dir: str

    @property
    def as_of(self) -> _dt.date:
        return as_of(self.spark, self.sf_dir)

    def years_back(self, n: int) -> _dt.date:
        """1 January of the year ``n`` years before ``as_of``."""
        return py_floor_year(py_add_months(self.as_of, -12 * n))

    # --- sources ---------------------------------------------------------
    def fact_rows(self, linestatus: str | None = FACTS_STATUS) -> DataFrame:
        return adapter.fund_rows(self.spark, self.sf_dir, linestatus)

    def facts(self, years: int = 2, linestatus: str | None = FACTS_STATUS) -> DataFrame:
        return fund_facts(self.fact_rows(linestatus), self.years_back(years), self.as_of)

    def report(self) -> DataFrame:
        return report_rows(adapter.report_rows_text(self.spark, self.sf_dir, REPORT_STATUS))

    def panel(self, years: int = 2, lazy: bool = False) -> DataFrame:
        """Fact panel from 1 January ``years`` back to ``as_of``: merged, padded, grown.

        The days are listed from the table of runs, which is written once per
        session: no listed day is stored or sorted, and the listing keeps the
        table's partitioning. ``lazy`` gives the plan instead, for a query
        that reads it a single time.
        """
        return expand_days(self.runs(years, lazy=lazy))

    def runs(self, years: int = 2, lazy: bool = False) -> DataFrame:
        """The same panel as runs: observed rows with the days that each stands for."""
        def plan(partitions=None):
            return run_panel(self.facts(years), self.report(), self.as_of, partitions=partitions)
        return plan() if lazy else self._cached(("runs", years), lambda: self.bucketed(plan(self.buckets()), "runs"))

    def buckets(self) -> int:
        """Buckets of a series table: their number follows the rows of the fact source (a footer count)."""
        def count():
            rows = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").count()
            return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET))
        return self._cached(("buckets",), count)

    def bucketed(self, df: DataFrame, name: str, keys: Sequence[str] = ("cod", "tipo_participacion")) -> DataFrame:
        """A table of ``df``, which comes in ``buckets()`` partitions by ``keys``: one file a bucket."""
        return materialize_bucketed(df, list(keys), [*keys, "fecha_corte"], buckets=self.buckets(), name=name)

    def _cached(self, key: tuple, build):
        full = (session_key(self.spark), self.sf_dir) + key
        if not CACHE_TABLES:
            return build()
        with _LOCK:
            if full not in _TABLE_CACHE:
                _TABLE_CACHE[full] = build()
            return _TABLE_CACHE[full]

    def base5(self) -> DataFrame:
        """Base universe (U5): 5-year panel, active, long, base share class."""
        return expand_days(self.base5_runs())

    def base5_runs(self) -> DataFrame:
        """``base5`` as runs, by fund: a base fund is one series."""
        from fundlens.operators.universe import screen_universe

        return self._cached(("base5",), lambda: self.bucketed(
            screen_universe(self.runs(5), 365, base=True).repartition(self.buckets(), "cod"), "base", ["cod"]))

    def dashboard(self) -> tuple[DataFrame, DataFrame]:
        """Dashboard facts and dims with display names."""
        from fundlens.plans.report import dashboard_tables
        return dashboard_tables(self.panel(1), self.dims(2))

    def dashboard_runs(self) -> tuple[DataFrame, DataFrame]:
        """``dashboard`` with the facts as runs, for what needs no list of days."""
        from fundlens.plans.report import dashboard_tables
        return dashboard_tables(self.runs(1), self.dims(2))

    def scratch_path(self, name: str) -> str:
        """A fresh folder under the session's checkpoint directory."""
        import uuid
        from fundlens.session import ensure_checkpoint_dir
        return f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def dims_raw(self, years: int = 2) -> DataFrame:
        return fund_dims_raw(adapter.dims_rows(self.spark, self.sf_dir), self.years_back(years), self.as_of)

    def dims(self, years: int = 2) -> DataFrame:
        return clean_dims(self.dims_raw(years))
