"""Scans of landed source files, typing, and the dashboard sinks.

The source service returns every value as text. Files are landed once
(JSON as it arrives, or Parquet partitioned by year, see
``fundlens.streaming.landing``) and scanned with an explicit schema: no
inference, no dependence on column position.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.functions.dates import parse_dmy, parse_iso_date, parse_year_month
from fundlens.functions.keys import composite_key
from fundlens.functions.numeric import daily_factor
from fundlens.functions.text import digits_only

KEY_PARTS = ("tipo_entidad", "codigo_entidad", "subtipo_negocio", "codigo_negocio")
NUMERIC_FACT_COLUMNS = (
    "rendimientos_abonados", "precierre_fondo_dia_t", "numero_unidades_fondo_cierre",
    "valor_unidad_operaciones", "aportes_recibidos", "retiros_redenciones", "anulaciones",
    "valor_fondo_cierre_dia_t", "numero_inversionistas",
)
FACT_COLUMNS = ("fecha_corte",) + KEY_PARTS + ("tipo_participacion",) + NUMERIC_FACT_COLUMNS
RAW_FACTS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FACT_COLUMNS])

DIM_COLUMNS = ("tipo_entidad", "nombre_tipo_entidad", "codigo_entidad", "nombre_entidad",
               "subtipo_negocio", "codigo_negocio", "nombre_patrimonio")
RAW_DIMS_SCHEMA = T.StructType([T.StructField(c, T.StringType())
                                for c in ("fecha_corte",) + DIM_COLUMNS])

REPORT_COLUMNS = ("fecha_corte", "tipo_entidad", "cod_entidad", "cod_negocio", "subtipo_negocio",
                  "cons_id_part", "tipo_part", "valor_fondo_cierre", "num_inversionistas",
                  "rentab_dia", "num_unidades", "valor_unidad")
RAW_REPORT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REPORT_COLUMNS])

PANEL_COLUMNS = (
    "fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t",
    "numero_unidades_fondo_cierre", "valor_unidad_operaciones", "valor_fondo_cierre_dia_t",
    "numero_inversionistas", "transaccciones_netas",
)


# --- raw scans ---------------------------------------------------------------

def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Scan landed files with a declared schema (JSON, CSV or Parquet)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def typed_facts(raw: DataFrame) -> DataFrame:
    """Text -> typed columns (A3): numeric block by try-cast, ISO timestamp -> date.

    Bad numbers and dates become NULL (never an error), columns already typed
    pass through.
    """
    def num(c: str):
        return F.col(c) if isinstance(raw.schema[c].dataType, T.DoubleType) else F.col(c).try_cast("double")

    date = raw.schema["fecha_corte"].dataType
    fecha = F.col("fecha_corte") if isinstance(date, T.DateType) else parse_iso_date(F.col("fecha_corte"))
    return raw.withColumns({"fecha_corte": fecha, **{c: num(c) for c in NUMERIC_FACT_COLUMNS if c in raw.columns}})


def filter_between_notin(df: DataFrame, start: _dt.date | None, end: _dt.date | None,
                         exclude: Sequence[str] = ("7",), date_col: str = "fecha_corte",
                         code_col: str = "subtipo_negocio") -> DataFrame:
    """Inclusive date range + negated code list (C1); both reach the scan."""
    cond = ~F.col(code_col).isin(*exclude) if exclude else F.lit(True)
    if start is not None:
        cond = cond & (F.col(date_col) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(date_col) <= F.lit(end))
    return df.where(cond)


def fund_facts(raw: DataFrame, start: _dt.date | None, end: _dt.date | None,
               exclude: Sequence[str] = ("7",)) -> DataFrame:
    """Fact rows of a date range (A1 + A3 + B1 + B2).

    Projects the 15 source columns, keeps ``start <= fecha_corte <= end`` and
    drops the excluded subtypes, builds the composite key and the net flow.
    """
    typed = typed_facts(raw.select(*FACT_COLUMNS))
    rows = filter_between_notin(typed, start, end, exclude)
    return net_flows(with_composite_key(rows))


def with_composite_key(df: DataFrame, parts: Sequence[str] = KEY_PARTS, name: str = "cod",
                       missing: str | None = "NA") -> DataFrame:
    """Composite string key replacing its parts (B1)."""
    cols = [c for c in df.columns if c not in parts]
    i = cols.index("fecha_corte") + 1 if "fecha_corte" in cols else 0
    key = composite_key(*parts, missing=missing).alias(name)
    return df.select(*cols[:i], key, *cols[i:])


def net_flows(df: DataFrame) -> DataFrame:
    """``transaccciones_netas = aportes - retiros + anulaciones``, parts dropped (B2)."""
    return (df.withColumn("transaccciones_netas",
                          F.col("aportes_recibidos") - F.col("retiros_redenciones") + F.col("anulaciones"))
            .drop("aportes_recibidos", "retiros_redenciones", "anulaciones"))


def fund_dims_raw(rows: DataFrame, start: _dt.date | None, end: _dt.date | None,
                  exclude: Sequence[str] = ("7",)) -> DataFrame:
    """DISTINCT codes + names over a date range."""
    return filter_between_notin(rows, start, end, exclude).select(*DIM_COLUMNS).distinct()


# --- second source (report extract) -----------------------------------------

# --- fixed values: subtype name -> code of the report extract --------------
SUBTYPE_CODES = {
    "FIC BURSATILES": 1,
    "FIC DE MERCADO MONETARIO": 2,
    "FIC INMOBILIARIAS": 3,
    "FIC DE TIPO GENERAL": 1,
}
EXCLUDED_REPORT_SUBTYPE = "FONDOS DE CAPITAL PRIVADO"
# ---------------------------------------------------------------------------


def report_rows(raw: DataFrame, subtype_codes: dict[str, int] | None = None,
                excluded: str = EXCLUDED_REPORT_SUBTYPE) -> DataFrame:
    """Type the report extract (A4) -- before the lag accrual of the panel.

    Drops the excluded subtype, parses ``dd/MM/yyyy``, strips formatting from
    amounts, maps the subtype name to its code (unknown -> NULL, hence a NULL
    key), turns the annual effective percent into a daily factor, and builds
    the NULL-propagating key and the participation label.
    """
    codes = SUBTYPE_CODES if subtype_codes is None else subtype_codes
    code = None
    for name, value in codes.items():
        cond = F.col("subtipo_negocio") == name
        code = F.when(cond, F.lit(value)) if code is None else code.when(cond, F.lit(value))
    df = raw.where(F.col("subtipo_negocio") != excluded)
    return df.select(
        parse_dmy(F.col("fecha_corte")).alias("fecha_corte"),
        composite_key(F.col("tipo_entidad"), F.col("cod_entidad"), code, F.col("cod_negocio"),
                      missing=None).alias("cod"),
        F.concat(F.col("tipo_part"), F.col("cons_id_part")).alias("tipo_participacion"),
        digits_only(F.col("valor_fondo_cierre")).alias("valor_fondo_cierre_dia_t"),
        F.col("num_inversionistas").try_cast("double").alias("numero_inversionistas"),
        daily_factor(F.col("rentab_dia").try_cast("double")).alias("factor_dia"),
        digits_only(F.col("num_unidades")).alias("numero_unidades_fondo_cierre"),
        digits_only(F.col("valor_unidad")).alias("valor_unidad_operaciones"),
    )


# --- macro tables (A5-A7) -----------------------------------------------------

def macro_daily(rows: DataFrame) -> DataFrame:
    """Daily rate ``(fecha date, trm double)``."""
    return rows.select(F.col("fecha").cast("date").alias("fecha"), F.col("trm").cast("double").alias("trm"))


def macro_monthly(rows: DataFrame) -> DataFrame:
    """Monthly index padded to daily.

    ``yyyy-MM`` -> first of month; each month's value is carried down every
    day up to the next month, and the last month up to the first day of the
    month after it (the ceiling of the last date). One ``explode`` over a
    ``lead``, no calendar join.
    """
    from pyspark.sql import Window

    m = rows.select(parse_year_month(F.col("fecha")).alias("fecha"), F.col("ipc").cast("double").alias("ipc"))
    w = Window.orderBy("fecha")  # monthly rows: a few hundred per century
    nxt = F.lead("fecha").over(w)
    end = F.coalesce(F.date_sub(nxt, 1), F.add_months(F.col("fecha"), 1))
    return (m.withColumn("_end", end)
            .select(F.explode(F.sequence("fecha", "_end")).alias("fecha"), "ipc"))


def holidays(rows: DataFrame) -> DataFrame:
    """``(fecha date, festivo boolean)``."""
    return rows.select(F.col("fecha").cast("date").alias("fecha"), F.col("festivo").cast("boolean").alias("festivo"))


# --- dashboard sink / read-back (A8, A9) ----------------------------------------

def write_dashboard(facts: DataFrame, dims: DataFrame, path: str) -> None:
    """Write the dashboard facts (partitioned by year) and dims as Parquet."""
    (facts.withColumn("anio", F.year("Fecha")).write.mode("overwrite")
     .partitionBy("anio").parquet(f"{path}/dashboard_facts"))
    dims.write.mode("overwrite").parquet(f"{path}/dashboard_dims")


def read_dashboard(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    facts = spark.read.parquet(f"{path}/dashboard_facts").drop("anio")
    dims = spark.read.parquet(f"{path}/dashboard_dims")
    return facts, dims
