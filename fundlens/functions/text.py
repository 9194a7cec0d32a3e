"""Text helpers (S1-S4, S13 ellipsis, T13, T14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they must equal the source system's labels -------------
# Entity-type classification: (test, pattern, label), first match wins.
ENTITY_TYPE_RULES = [
    ("startswith", "SOCIEDADES ADMINISTRADORAS DE INVERSI", "ADMINISTRADORAS"),
    ("contains", "COMISIONISTAS", "COMISIONISTAS"),
    ("contains", "FIDUCIARIA", "FIDUCIARIAS"),
]
# Boilerplate removed from fund names (dots in F.I.C. are regex wildcards).
FUND_NAME_BOILERPLATE = (
    "CARTERA COLECTIVA|CARTERA CON COMPARTIMENTOS|F.I.C.|CON PARTICIPACIONES DIFERENCIALES"
    "|FIC|FONDO DE INVERSI.*?N COLECTIVA|FONDO"
)
# Entity key = first match of this pattern in the composite fund key.
ENTITY_KEY_PATTERN = r"\d*_\d*"
# ---------------------------------------------------------------------------


def classify_entity_type(c: Column, rules=ENTITY_TYPE_RULES) -> Column:
    """Prefix / contains tests into a short label, else keep the input."""
    expr = None
    for test, pattern, label in rules:
        cond = c.startswith(pattern) if test == "startswith" else c.contains(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(c) if expr is not None else c


def entity_key(cod: Column, pattern: str = ENTITY_KEY_PATTERN) -> Column:
    """First regex match, NULL when there is none."""
    return F.regexp_substr(cod, F.lit(pattern))


def trim_ws(c: Column) -> Column:
    """Trim all leading/trailing whitespace, tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_fund_name(c: Column, boilerplate: str = FUND_NAME_BOILERPLATE) -> Column:
    """Upper-case, drop boilerplate words, trim (S3)."""
    return trim_ws(F.regexp_replace(F.upper(c), boilerplate, ""))


def digits_only(c: Column) -> Column:
    """Strip all but digits and the dot, then parse; bad text gives NULL."""
    return F.regexp_replace(c, r"[^0-9\.]", "").try_cast("double")


def ellipsis(c: Column, width: int) -> Column:
    """Cut text to ``width`` characters and mark the cut with an ellipsis."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)
