"""Fund dimension cleaning.

The short-name lookup is a small fixed table joined by broadcast (its size
is the length of the list below, independent of the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions.text import classify_entity_type, clean_fund_name, entity_key
from fundlens.sources.landed import KEY_PARTS, with_composite_key

# --- fixed values: entity key -> short entity name --------------------------
SHORT_NAMES = [
    ("5_12", "PREVISORA FIDUCUARIA"),
    ("5_16", "ALIANZA FIDUCIARIA"),
    ("5_18", "POPULAR FIDUCIARIA"),
    ("5_20", "CORFICOLOMBIANA FIDUCIARIA"),
    ("5_21", "OCCIDENTE FIDUCIARIA"),
    ("5_22", "BOGOTA FIDUCIARIA"),
    ("5_23", "ITAU FIDUCIARIA"),
    ("5_25", "SCOTIABANK COLPATRIA FIDUCIARIA"),
    ("5_3", "BBVA FIDUCIARIA"),
    ("5_31", "BANCOLOMBIA FIDUCIARIA"),
    ("5_33", "ACCION FIDUCIARIA"),
    ("5_34", "GNB SUDAMERIS FIDUCIARIA"),
    ("5_38", "FIDUCENTRAL FIDUCIARIA"),
    ("5_39", "FIDUAGRARIA FIDUCIARIA"),
    ("5_40", "FIDUCOLDEX FIDUCIARIA"),
    ("5_42", "DAVIVIENDA FIDUCIARIA"),
    ("5_58", "SURA FIDUCIARIA"),
    ("5_59", "CREDICORP FIDUCIARIA"),
    ("5_6", "COLMENA FIDUCIARIA"),
    ("5_62", "COOMEVA FIDUCIARIA"),
    ("5_63", "RENTA4G FIDUCIARIA"),
    ("5_7", "SKANDIA FIDUCIARIA"),
    ("85_14", "BTG PACTUAL COMISIONISTA"),
    ("85_22", "BANCOLOMBIA COMISIONISTA"),
    ("85_26", "DAVIVIENDA COMISIONISTA"),
    ("85_27", "BBVA COMISIONISTA"),
    ("85_28", "CREDICORP COMISIONISTA"),
    ("85_3", "ACCIONE Y VALORES COMISIONISTA"),
    ("85_68", "GLOBAL SECURITIES COMISIONISTA"),
    ("85_73", "CITIVALORES COMISIONISTA"),
    ("85_88", "ITAU COMISIONISTA"),
    ("85_9", "PROGRESION COMISIONISTA"),
    ("85_91", "GNB SUDAMERIS COMISIONISTA"),
    ("85_97", "LARRAIN VIAL COMISIONISTA"),
    ("87_11", "PROGRESION ADMINISTRADORA"),
]
# ---------------------------------------------------------------------------


def short_name_table(spark: SparkSession, names=SHORT_NAMES) -> DataFrame:
    return spark.createDataFrame(names, "cod_empresa string, nombre_corto string")


def lookup_names(df: DataFrame, key_col: str, name_col: str, table: DataFrame) -> DataFrame:
    """Replace ``name_col`` by the table's name where ``key_col`` matches."""
    t = F.broadcast(table.withColumnRenamed("cod_empresa", "_k"))
    out = df.join(t, F.col(key_col) == F.col("_k"), "left")
    return out.withColumn(name_col, F.coalesce("nombre_corto", name_col)).drop("_k", "nombre_corto")


def clean_dims(raw: DataFrame, short_names: DataFrame | None = None, latest_only: bool = False,
               order_col: str | None = None) -> DataFrame:
    """Full dimension cleaning.

    ``raw`` holds the distinct code + name rows. Output
    ``(cod, nombre_tipo_entidad, nombre_entidad, nombre_patrimonio)``. A
    renamed fund keeps one row per name unless ``latest_only`` (then the
    row with the greatest ``order_col`` wins).
    """
    spark = raw.sparkSession
    table = short_names if short_names is not None else short_name_table(spark)
    keyed = with_composite_key(raw, KEY_PARTS)
    keyed = keyed.withColumns({
        "nombre_tipo_entidad": classify_entity_type(F.col("nombre_tipo_entidad")),
        "cod_empresa": entity_key(F.col("cod")),
        "nombre_patrimonio": clean_fund_name(F.col("nombre_patrimonio")),
    })
    named = lookup_names(keyed, "cod_empresa", "nombre_entidad", table).drop("cod_empresa")
    cols = ["cod", "nombre_tipo_entidad", "nombre_entidad", "nombre_patrimonio"]
    if latest_only and order_col is not None:
        from pyspark.sql import Window
        w = Window.partitionBy("cod").orderBy(F.col(order_col).desc_nulls_last(), *[F.col(c) for c in cols[1:]])
        named = named.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return named.select(*cols)
