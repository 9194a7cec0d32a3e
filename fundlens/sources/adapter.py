"""Stand-in sources derived from the driver's tables.

The driver tables (TPC-H-like) know no funds. This adapter turns them into
the fund data model deterministically, so that every downstream query grows
with the tables and can be re-derived in plain SQL by the oracle:

* fact rows:  ``lineitem`` per (ship day, supplier, return flag) joined to
  ``supplier`` -> ``nation``; money is summed exactly as integer cents
  (``long``, twice as fast as ``decimal`` sums wider than 18 digits) and
  turned into a double by one correctly rounded division at the end, so
  two engines agree bit for bit.
* dims rows:  distinct supplier / nation / region names over the same rows.
* report rows (second source): ``lineitem`` rows of one line status rendered
  as the text a spreadsheet extract would hold.
* macro: exchange rate, monthly index, holidays from ``orders``.

Large tables are joined without hints (AQE picks broadcast only under its
size threshold); ``nation`` and ``region`` are fixed 25/5-row tables and are
broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _cents(col: str):
    """A 2-decimal double as exact integer hundredths."""
    return F.round(F.col(col) * 100).cast("long")


def _units(c, scale: float):
    """Exact integer count of ``1/scale`` units -> nearest double."""
    return c.cast("double") / F.lit(scale)


def _round_half_up_100(c):
    """Integer ``c`` (1e-4 units) rounded half away from zero to 1e-2 units."""
    return F.signum(c).cast("long") * F.floor((F.abs(c) + 50) / 100).cast("long")

# --- fixed values of the stand-in: region -> entity type code and name -----
# (chosen so that the short-name lookup and the type classifier both bite)
ENTITY_TYPE_CODE = ["5", "85", "87", "5", "85"]
ENTITY_TYPE_NAME = [
    "SOCIEDADES FIDUCIARIAS",
    "SOCIEDADES COMISIONISTAS DE BOLSA",
    "SOCIEDADES ADMINISTRADORAS DE INVERSION",
    "FIDUCIARIAS DEL EXTERIOR",
    "COMISIONISTAS DEL EXTERIOR",
]
# ---------------------------------------------------------------------------


def _by_region(values: list[str]):
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), F.col("n_regionkey") + 1)


_READERS: dict[tuple, DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one driver table; the reader (schema from the Parquet
    footers) is built once per session and reused by every plan."""
    from fundlens.session import session_key
    key = (session_key(spark), sf_dir, name)
    if key not in _READERS:
        _READERS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READERS[key]


def _daily_lines(spark: SparkSession, sf_dir: str, linestatus: str | None) -> DataFrame:
    """Pre-aggregate lineitem to one row per (day, supplier, return flag)."""
    li = _table(spark, sf_dir, "lineitem")
    if linestatus is not None:
        li = li.where(F.col("l_linestatus") == linestatus)
    price = _cents("l_extendedprice")   # 1e-2 units
    tax = _cents("l_tax")
    disc = _cents("l_discount")
    qty = _cents("l_quantity")
    return li.groupBy(
        F.to_date("l_shipdate").alias("fecha_corte"),
        F.col("l_suppkey"),
        F.col("l_returnflag"),
    ).agg(
        F.sum(price).alias("_pre"),                      # 1e-2 units
        F.sum(price * (tax - disc)).alias("_yld"),       # 1e-4 units
        F.sum(price * tax).alias("_in"),                 # 1e-4 units
        F.sum(price * disc).alias("_out"),               # 1e-4 units
        F.sum(qty).alias("_qty"),                        # 1e-2 units
        F.sum(tax - disc).alias("_rate_sum"),            # 1e-2 units
        F.count(F.lit(1)).alias("_lines"),
    ).withColumn("_close", F.col("_pre") * 100 + F.col("_in") - F.col("_out"))  # 1e-4 units


def _with_entity(daily: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    return (daily.join(sup, daily.l_suppkey == sup.s_suppkey)
            .join(nat, F.col("s_nationkey") == nat.n_nationkey))


def fund_rows(spark: SparkSession, sf_dir: str, linestatus: str | None = None) -> DataFrame:
    """Typed daily fund report rows (the ``facts_raw`` schema, typed)."""
    d = _with_entity(_daily_lines(spark, sf_dir, linestatus), spark, sf_dir)
    qty = _units(F.col("_qty"), 100.0)
    units = qty * 1000.0
    close = _units(F.col("_close"), 10000.0)
    return d.select(
        "fecha_corte",
        _by_region(ENTITY_TYPE_CODE).alias("tipo_entidad"),
        F.col("n_nationkey").cast("string").alias("codigo_entidad"),
        (F.col("l_suppkey") % 8).cast("string").alias("subtipo_negocio"),
        F.col("l_suppkey").cast("string").alias("codigo_negocio"),
        F.col("l_returnflag").alias("tipo_participacion"),
        (_units(F.col("_yld"), 10000.0) / 100.0).alias("rendimientos_abonados"),
        _units(F.col("_pre"), 100.0).alias("precierre_fondo_dia_t"),
        units.alias("numero_unidades_fondo_cierre"),
        F.when(units == 0, F.lit(None).cast("double")).otherwise(close / units)
        .alias("valor_unidad_operaciones"),
        _units(F.col("_in"), 10000.0).alias("aportes_recibidos"),
        _units(F.col("_out"), 10000.0).alias("retiros_redenciones"),
        F.lit(0.0).alias("anulaciones"),
        close.alias("valor_fondo_cierre_dia_t"),
        qty.alias("numero_inversionistas"),
    )


def fund_rows_text(spark: SparkSession, sf_dir: str, linestatus: str | None = None) -> DataFrame:
    """The same rows as the landed JSON text the source service returns."""
    typed = fund_rows(spark, sf_dir, linestatus)
    out = [F.date_format(F.col("fecha_corte").cast("timestamp"),
                         "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("fecha_corte")]
    out += [F.col(c).cast("string").alias(c) for c in typed.columns if c != "fecha_corte"]
    return typed.select(*out)


def dims_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fact row: code columns + names (input of the DISTINCT dims scan).

    Every tenth supplier is renamed from 2001 on, so a fund can carry two
    names over a date range (the dims fan-out case).
    """
    # distinct (day, supplier) first: a partial aggregate shrinks lineitem to
    # one row per supplier-day before any join (a later date-range filter
    # still reaches the scan through the aggregate)
    li = (_table(spark, sf_dir, "lineitem")
          .select(F.to_date("l_shipdate").alias("l_shipdate"), "l_suppkey").distinct())
    sup = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    nat = F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name"))
    reg = F.broadcast(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    d = (li.join(sup, li.l_suppkey == sup.s_suppkey)
         .join(nat, F.col("s_nationkey") == nat.n_nationkey)
         .join(reg, F.col("n_regionkey") == reg.r_regionkey))
    renamed = (F.col("l_suppkey") % 10 == 0) & (F.year("l_shipdate") >= 2001)
    return d.select(
        F.col("l_shipdate").alias("fecha_corte"),
        _by_region(ENTITY_TYPE_CODE).alias("tipo_entidad"),
        _by_region(ENTITY_TYPE_NAME).alias("nombre_tipo_entidad"),
        F.col("n_nationkey").cast("string").alias("codigo_entidad"),
        F.col("n_name").alias("nombre_entidad"),
        (F.col("l_suppkey") % 8).cast("string").alias("subtipo_negocio"),
        F.col("l_suppkey").cast("string").alias("codigo_negocio"),
        F.concat(F.lit("FONDO "), F.col("s_name"),
                 F.when(renamed, F.lit(" II")).otherwise(F.lit(""))).alias("nombre_patrimonio"),
    )


# --- fixed values: report subtype names (code 7 is the excluded class) -----
SUBTYPE_NAME_BY_MOD8 = {
    1: "FIC BURSATILES",
    2: "FIC DE MERCADO MONETARIO",
    3: "FIC INMOBILIARIAS",
    5: "FIC DE TIPO GENERAL",
    7: "FONDOS DE CAPITAL PRIVADO",
}
# ---------------------------------------------------------------------------


def report_rows_text(spark: SparkSession, sf_dir: str, linestatus: str = "O") -> DataFrame:
    """Second source: a spreadsheet-like extract, all text.

    Amounts are formatted (``$ 1,234.50``), dates are ``dd/MM/yyyy``, the
    subtype is a name (unknown names for some suppliers), the daily return is
    an annual effective percent.
    """
    d = _with_entity(_daily_lines(spark, sf_dir, linestatus), spark, sf_dir)
    m8 = F.col("l_suppkey") % 8
    name = None
    for k, v in SUBTYPE_NAME_BY_MOD8.items():
        name = F.when(m8 == k, F.lit(v)) if name is None else name.when(m8 == k, F.lit(v))
    name = name.otherwise(F.concat(F.lit("OTRO SUBTIPO "), m8.cast("string")))
    close2 = _units(_round_half_up_100(F.col("_close")), 100.0)   # rounded to cents
    qty = _units(F.col("_qty"), 100.0)
    units = qty * 1000.0
    rate_pct = _units(F.col("_rate_sum"), 100.0) / F.col("_lines").cast("double") * 100.0
    return d.select(
        F.date_format("fecha_corte", "dd/MM/yyyy").alias("fecha_corte"),
        _by_region(ENTITY_TYPE_CODE).alias("tipo_entidad"),
        F.col("n_nationkey").cast("string").alias("cod_entidad"),
        F.col("l_suppkey").cast("string").alias("cod_negocio"),
        name.alias("subtipo_negocio"),
        F.lit("").alias("cons_id_part"),
        F.col("l_returnflag").alias("tipo_part"),
        F.concat(F.lit("$ "), F.format_number(close2, 2)).alias("valor_fondo_cierre"),
        qty.cast("string").alias("num_inversionistas"),
        rate_pct.cast("string").alias("rentab_dia"),
        F.format_number(units, 0).alias("num_unidades"),
        (close2 / units).cast("string").alias("valor_unidad"),
    )


def trm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily exchange rate ``(fecha, trm)``: average order price per order day."""
    o = _table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("fecha")).agg(
        (_units(F.sum(_cents("o_totalprice")), 100.0) / F.count(F.lit(1)).cast("double")).alias("trm"))


def ipc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly index ``(fecha 'yyyy-MM', ipc)``: average order price per month."""
    o = _table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("fecha")).agg(
        (_units(F.sum(_cents("o_totalprice")), 100.0) / F.count(F.lit(1)).cast("double")).alias("ipc"))


def holiday_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays ``(fecha, festivo)``: order days that fall on the 1st."""
    o = _table(spark, sf_dir, "orders")
    return (o.select(F.to_date("o_orderdate").alias("fecha"))
            .where(F.dayofmonth("fecha") == 1).distinct()
            .withColumn("festivo", F.lit(True)))
