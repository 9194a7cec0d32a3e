"""Column-expression helpers. All return ``pyspark.sql.Column`` built from
JVM-side functions, so they stay inside whole-stage codegen."""

from fundlens.functions.keys import composite_key, series_label, null_concat
from fundlens.functions.text import (classify_entity_type, entity_key, clean_fund_name,
                                     digits_only, trim_ws, ellipsis)
from fundlens.functions.dates import (parse_iso_date, parse_dmy, parse_year_month,
                                      floor_year, floor_month, ceiling_month, shift_years,
                                      shift_months, weekday_mon1, is_weekend)
from fundlens.functions.numeric import (safe_growth, daily_factor, annualise, nan_inf_to,
                                        millions_label, percent_label, fixed_label)

__all__ = [
    "composite_key", "series_label", "null_concat", "classify_entity_type", "entity_key",
    "clean_fund_name", "digits_only", "trim_ws", "ellipsis", "parse_iso_date", "parse_dmy",
    "parse_year_month", "floor_year", "floor_month", "ceiling_month", "shift_years",
    "shift_months", "weekday_mon1", "is_weekend", "safe_growth", "daily_factor", "annualise",
    "nan_inf_to", "millions_label", "percent_label", "fixed_label",
]
