"""DuckDB oracle: the same queries as plain ANSI SQL over the driver tables.

Written independently of the Spark code: padding by a calendar join,
trailing statistics by window frames, screens by EXISTS. ``as_of`` and the
range starts come from a ``params`` CTE. Doubles of query outputs are
rounded to 8 decimals on both sides; ``r(x, n)`` rounds like Spark's
``round`` (HALF_UP on the shortest decimal text of the double).
"""

from __future__ import annotations

import math

from fundlens.functions.text import ENTITY_KEY_PATTERN, ENTITY_TYPE_RULES, FUND_NAME_BOILERPLATE

SQRT365 = repr(math.sqrt(365))


def entity_label(col: str) -> str:
    """The classifier's rules (fixed values of ``functions.text``) as a CASE."""
    test = {"startswith": "starts_with", "contains": "contains"}
    whens = " ".join(f"WHEN {test[kind]}({col}, '{pattern}') THEN '{label}'" for kind, pattern, label in ENTITY_TYPE_RULES)
    return f"CASE {whens} ELSE {col} END"


def fund_name(col: str) -> str:
    """Upper-cased name without boilerplate and outer white space."""
    return f"regexp_replace(regexp_replace(upper({col}), '{FUND_NAME_BOILERPLATE}', '', 'g'), '^\\s+|\\s+$', '', 'g')"


TYPE_CODE = ("CASE n.n_regionkey WHEN 0 THEN '5' WHEN 1 THEN '85' WHEN 2 THEN '87' "
             "WHEN 3 THEN '5' WHEN 4 THEN '85' END")
TYPE_NAME = ("CASE n.n_regionkey WHEN 0 THEN 'SOCIEDADES FIDUCIARIAS' "
             "WHEN 1 THEN 'SOCIEDADES COMISIONISTAS DE BOLSA' "
             "WHEN 2 THEN 'SOCIEDADES ADMINISTRADORAS DE INVERSION' "
             "WHEN 3 THEN 'FIDUCIARIAS DEL EXTERIOR' WHEN 4 THEN 'COMISIONISTAS DEL EXTERIOR' END")


def r(expr: str, n: int) -> str:
    """Spark-compatible rounding of a DOUBLE expression."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,17)), {n}) AS DOUBLE)"


def r8(expr: str) -> str:
    return r(expr, 8)


PARAMS = """params AS (
  SELECT as_of,
         CAST(date_trunc('year', as_of - INTERVAL 1 YEAR) AS DATE) AS y1,
         CAST(date_trunc('year', as_of - INTERVAL 2 YEAR) AS DATE) AS y2,
         CAST(date_trunc('year', as_of - INTERVAL 5 YEAR) AS DATE) AS y5,
         CAST(date_trunc('month', as_of - INTERVAL 1 MONTH) AS DATE) AS m1
  FROM (SELECT max(CAST(l_shipdate AS DATE)) AS as_of FROM lineitem) t
)"""


def lines(name: str, status: str | None) -> str:
    where = f"WHERE l_linestatus = '{status}'" if status else ""
    p = "CAST(l_extendedprice AS DECIMAL(15,2))"
    tax = "CAST(l_tax AS DECIMAL(15,2))"
    disc = "CAST(l_discount AS DECIMAL(15,2))"
    return f"""{name} AS (
  SELECT CAST(l_shipdate AS DATE) AS fecha_corte, l_suppkey, l_returnflag,
         sum({p}) AS pre, sum({p} * ({tax} - {disc})) AS yld,
         sum({p} * {tax}) AS inflow, sum({p} * {disc}) AS outflow,
         sum(CAST(l_quantity AS DECIMAL(15,2))) AS qty,
         sum({tax} - {disc}) AS rate_sum, count(*) AS nlines
  FROM lineitem {where}
  GROUP BY 1, 2, 3
)"""


def fact_rows(name: str, lines_cte: str) -> str:
    return f"""{name} AS (
  SELECT d.fecha_corte,
         {TYPE_CODE} AS tipo_entidad,
         CAST(n.n_nationkey AS VARCHAR) AS codigo_entidad,
         CAST(d.l_suppkey % 8 AS VARCHAR) AS subtipo_negocio,
         CAST(d.l_suppkey AS VARCHAR) AS codigo_negocio,
         d.l_returnflag AS tipo_participacion,
         CAST(d.yld AS DOUBLE) / 100.0 AS rendimientos_abonados,
         CAST(d.pre AS DOUBLE) AS precierre_fondo_dia_t,
         CAST(d.qty AS DOUBLE) * 1000.0 AS numero_unidades_fondo_cierre,
         CASE WHEN CAST(d.qty AS DOUBLE) * 1000.0 = 0 THEN NULL
              ELSE CAST(d.pre + d.inflow - d.outflow AS DOUBLE) / (CAST(d.qty AS DOUBLE) * 1000.0)
         END AS valor_unidad_operaciones,
         CAST(d.inflow AS DOUBLE) AS aportes_recibidos,
         CAST(d.outflow AS DOUBLE) AS retiros_redenciones,
         0.0::DOUBLE AS anulaciones,
         CAST(d.pre + d.inflow - d.outflow AS DOUBLE) AS valor_fondo_cierre_dia_t,
         CAST(d.qty AS DOUBLE) AS numero_inversionistas
  FROM {lines_cte} d
  JOIN supplier s ON s.s_suppkey = d.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
)"""


def facts(name: str, rows_cte: str, start: str) -> str:
    """A1 + B1 + B2 over a date range; ``start`` is a params column."""
    return f"""{name} AS (
  SELECT f.fecha_corte,
         coalesce(f.tipo_entidad, 'NA') || '_' || coalesce(f.codigo_entidad, 'NA') || '_' ||
         coalesce(f.subtipo_negocio, 'NA') || '_' || coalesce(f.codigo_negocio, 'NA') AS cod,
         f.tipo_participacion, f.rendimientos_abonados, f.precierre_fondo_dia_t,
         f.numero_unidades_fondo_cierre, f.valor_unidad_operaciones, f.valor_fondo_cierre_dia_t,
         f.numero_inversionistas,
         f.aportes_recibidos - f.retiros_redenciones + f.anulaciones AS transaccciones_netas
  FROM {rows_cte} f, params
  WHERE f.fecha_corte BETWEEN params.{start} AND params.as_of
    AND f.subtipo_negocio NOT IN ('7')
)"""


def report(name: str, lines_cte: str) -> str:
    close2 = "round(d.pre + d.inflow - d.outflow, 2)"
    return f"""{name} AS (
  SELECT d.fecha_corte,
         {TYPE_CODE} || '_' || CAST(n.n_nationkey AS VARCHAR) || '_' ||
         CAST(CASE d.l_suppkey % 8 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 1 END AS VARCHAR)
         || '_' || CAST(d.l_suppkey AS VARCHAR) AS cod,
         d.l_returnflag AS tipo_participacion,
         CAST({close2} AS DOUBLE) AS valor_fondo_cierre_dia_t,
         CAST(d.qty AS DOUBLE) AS numero_inversionistas,
         pow(1 + (CAST(d.rate_sum AS DOUBLE) / CAST(d.nlines AS DOUBLE) * 100.0) / 100, {1.0 / 365!r})
           AS factor_dia,
         CAST(d.qty AS DOUBLE) * 1000.0 AS numero_unidades_fondo_cierre,
         CAST({close2} AS DOUBLE) / (CAST(d.qty AS DOUBLE) * 1000.0) AS valor_unidad_operaciones
  FROM {lines_cte} d
  JOIN supplier s ON s.s_suppkey = d.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  WHERE d.l_suppkey % 8 <> 7
)"""


def report_accrued(name: str, rep_cte: str) -> str:
    return f"""{name} AS (
  SELECT fecha_corte, cod, tipo_participacion,
         prev * factor_dia - prev AS rendimientos_abonados,
         prev * factor_dia AS precierre_fondo_dia_t,
         valor_fondo_cierre_dia_t, numero_inversionistas, numero_unidades_fondo_cierre,
         valor_unidad_operaciones
  FROM (SELECT *, lag(valor_fondo_cierre_dia_t) OVER w AS prev, row_number() OVER w AS rn
        FROM {rep_cte} WHERE cod IS NOT NULL AND tipo_participacion IS NOT NULL
        WINDOW w AS (PARTITION BY cod, tipo_participacion ORDER BY fecha_corte)) t
  WHERE rn > 1
)"""


def report_kept(name: str, acc_cte: str, facts_cte: str) -> str:
    return f"""{name} AS (
  SELECT a.*, a.valor_fondo_cierre_dia_t - a.precierre_fondo_dia_t AS transaccciones_netas
  FROM {acc_cte} a, params
  WHERE EXISTS (SELECT 1 FROM {facts_cte} f
                WHERE f.fecha_corte >= params.m1 AND f.cod = a.cod
                  AND f.tipo_participacion = a.tipo_participacion)
    AND NOT EXISTS (SELECT 1 FROM {facts_cte} f
                    WHERE f.fecha_corte = a.fecha_corte AND f.cod = a.cod
                      AND f.tipo_participacion = a.tipo_participacion)
)"""


VALUE_COLS = ("rendimientos_abonados", "precierre_fondo_dia_t", "numero_unidades_fondo_cierre",
              "valor_unidad_operaciones", "valor_fondo_cierre_dia_t", "numero_inversionistas",
              "transaccciones_netas")


def panel(name: str, merged_cte: str) -> str:
    """F2-F5 by a calendar join: bounds -> days -> left join -> carry -> growth."""
    vals = ", ".join(f"m.{c}" for c in VALUE_COLS)
    w = ("PARTITION BY cod, tipo_participacion ORDER BY fecha_corte "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    pre1 = r("precierre_fondo_dia_t", 1)
    rend1 = r("rendimientos_abonados", 1)
    return f"""{name}_bounds AS (
  SELECT cod, tipo_participacion, min(fecha_corte) AS d0, max(fecha_corte) AS d1
  FROM {merged_cte} GROUP BY cod, tipo_participacion
),
{name}_cal AS (
  SELECT cod, tipo_participacion,
         d0 + CAST(unnest(range(0, d1 - d0 + 1)) AS INTEGER) AS fecha_corte
  FROM {name}_bounds
),
{name}_pad AS (
  SELECT c.fecha_corte, c.cod, c.tipo_participacion, {vals}
  FROM {name}_cal c LEFT JOIN {merged_cte} m
    ON m.cod = c.cod AND m.tipo_participacion = c.tipo_participacion AND m.fecha_corte = c.fecha_corte
),
{name}_fill AS (
  SELECT fecha_corte, cod, tipo_participacion,
         coalesce(rendimientos_abonados, 0.0) AS rendimientos_abonados,
         coalesce(precierre_fondo_dia_t,
                  last_value(valor_fondo_cierre_dia_t IGNORE NULLS) OVER ({w})) AS precierre_fondo_dia_t,
         last_value(numero_unidades_fondo_cierre IGNORE NULLS) OVER ({w}) AS numero_unidades_fondo_cierre,
         last_value(valor_unidad_operaciones IGNORE NULLS) OVER ({w}) AS valor_unidad_operaciones,
         last_value(valor_fondo_cierre_dia_t IGNORE NULLS) OVER ({w}) AS valor_fondo_cierre_dia_t,
         last_value(numero_inversionistas IGNORE NULLS) OVER ({w}) AS numero_inversionistas,
         coalesce(transaccciones_netas, 0.0) AS transaccciones_netas
  FROM {name}_pad
),
{name} AS (
  SELECT fecha_corte, cod, tipo_participacion,
         {rend1} AS rendimientos_abonados, {pre1} AS precierre_fondo_dia_t,
         numero_unidades_fondo_cierre, valor_unidad_operaciones, valor_fondo_cierre_dia_t,
         numero_inversionistas, transaccciones_netas,
         CASE WHEN {pre1} - {rend1} = 0 THEN 0.0 ELSE {pre1} / ({pre1} - {rend1}) - 1 END AS crecimiento_dia
  FROM {name}_fill
)"""


def panel_chain(years_col: str = "y2", name: str = "panel") -> list[str]:
    """CTEs up to the merged, cleaned panel for a range start column."""
    return [
        PARAMS,
        lines("lines_f", "F"),
        lines("lines_o", "O"),
        fact_rows("fact_rows", "lines_f"),
        facts("facts", "fact_rows", years_col),
        report("rep", "lines_o"),
        report_accrued("rep_acc", "rep"),
        report_kept("rep_keep", "rep_acc", "facts"),
        "merged AS (SELECT * FROM facts UNION ALL BY NAME SELECT * FROM rep_keep)",
        panel(name, "merged"),
    ]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def frame(p: int, key: str = "cod, tipo_participacion", dc: str = "fecha_corte") -> str:
    return f"PARTITION BY {key} ORDER BY {dc} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW"


def rent_sql(col: str, p: int, key: str = "cod, tipo_participacion", dc: str = "fecha_corte") -> str:
    w = frame(p, key, dc)
    return (f"CASE WHEN count({col}) OVER ({w}) = {p} "
            f"THEN pow(product(1 + {col}) OVER ({w}), {365 / p!r}) - 1 END")


def gross_sql(col: str, p: int, key: str = "cod, tipo_participacion", dc: str = "fecha_corte") -> str:
    w = frame(p, key, dc)
    return f"CASE WHEN count({col}) OVER ({w}) = {p} THEN product(1 + {col}) OVER ({w}) - 1 END"


def vol_sql(col: str, p: int, key: str = "cod, tipo_participacion", dc: str = "fecha_corte") -> str:
    w = frame(p, key, dc)
    return f"CASE WHEN count({col}) OVER ({w}) = {p} THEN stddev_samp({col}) OVER ({w}) * {SQRT365} END"


# --- screens (U1, U2) ----------------------------------------------------------

def active_long(name: str, src: str, days: int = 365, key: str = "cod, tipo_participacion",
                dc: str = "fecha_corte") -> str:
    return f"""{name} AS (
  SELECT * FROM {src}
  WHERE ({key}) IN (SELECT {key} FROM {src} GROUP BY {key}
                    HAVING max({dc}) = (SELECT max({dc}) FROM {src}))
    AND ({key}) IN (SELECT {key} FROM {src} GROUP BY {key} HAVING count(*) > {days})
)"""


def dims_chain() -> list[str]:
    """Distinct raw dims over the 2-year range and their cleaning."""
    from fundlens.operators.dims import SHORT_NAMES
    short = ", ".join(f"('{k}', '{v}')" for k, v in SHORT_NAMES)
    return [f"""dims_raw AS (
  SELECT DISTINCT {TYPE_CODE} AS tipo_entidad, {TYPE_NAME} AS nombre_tipo_entidad,
         CAST(n.n_nationkey AS VARCHAR) AS codigo_entidad, n.n_name AS nombre_entidad,
         CAST(l.l_suppkey % 8 AS VARCHAR) AS subtipo_negocio, CAST(l.l_suppkey AS VARCHAR) AS codigo_negocio,
         'FONDO ' || s.s_name || CASE WHEN l.l_suppkey % 10 = 0 AND year(l.l_shipdate) >= 2001
                                      THEN ' II' ELSE '' END AS nombre_patrimonio
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey, params
  WHERE CAST(l.l_shipdate AS DATE) BETWEEN params.y2 AND params.as_of
    AND CAST(l.l_suppkey % 8 AS VARCHAR) NOT IN ('7')
)""", f"""short_names(cod_empresa, nombre_corto) AS (VALUES {short})""", f"""dims AS (
  SELECT d.cod,
         {entity_label('d.nombre_tipo_entidad')} AS nombre_tipo_entidad,
         coalesce(sn.nombre_corto, d.nombre_entidad) AS nombre_entidad,
         {fund_name('d.nombre_patrimonio')} AS nombre_patrimonio
  FROM (SELECT coalesce(tipo_entidad, 'NA') || '_' || coalesce(codigo_entidad, 'NA') || '_' ||
               coalesce(subtipo_negocio, 'NA') || '_' || coalesce(codigo_negocio, 'NA') AS cod,
               nombre_tipo_entidad, nombre_entidad, nombre_patrimonio
        FROM dims_raw) d
  LEFT JOIN short_names sn ON sn.cod_empresa = regexp_extract(d.cod, '{ENTITY_KEY_PATTERN}')
)"""]


def dashboard_chain() -> list[str]:
    """Dashboard facts (1-year panel, active + long) and their dims."""
    return panel_chain("y1", name="panel1") + dims_chain() + [
        active_long("dash_facts", "panel1"),
        "dash_dims AS (SELECT * FROM dims WHERE cod IN (SELECT cod FROM dash_facts))",
    ]


def base_share(name: str, src: str) -> str:
    """Per fund the participation with most investors on the last day."""
    return f"""{name}_top AS (
  SELECT * FROM (
    SELECT cod, tipo_participacion, numero_inversionistas, valor_fondo_cierre_dia_t,
           max(numero_inversionistas) OVER (PARTITION BY cod) AS max_inv,
           count(*) FILTER (WHERE numero_inversionistas IS NULL) OVER (PARTITION BY cod) AS inv_nulls
    FROM {src} WHERE fecha_corte = (SELECT max(fecha_corte) FROM {src})) t
  WHERE inv_nulls = 0 AND numero_inversionistas = max_inv AND numero_inversionistas > 0
),
{name}_keys AS (
  SELECT cod, tipo_participacion FROM (
    SELECT cod, tipo_participacion,
           count(*) FILTER (WHERE valor_fondo_cierre_dia_t IS NULL) OVER (PARTITION BY cod) AS val_nulls,
           row_number() OVER (PARTITION BY cod ORDER BY valor_fondo_cierre_dia_t DESC,
                              tipo_participacion ASC NULLS LAST) AS rn
    FROM {name}_top) t
  WHERE val_nulls = 0 AND rn = 1
),
{name} AS (
  SELECT * FROM {src} WHERE (cod, tipo_participacion) IN (SELECT cod, tipo_participacion FROM {name}_keys)
)"""


def base5_chain() -> list[str]:
    """5-year panel -> active -> long -> base share class."""
    return panel_chain("y5", name="panel5") + [
        active_long("al5", "panel5"),
        base_share("base5", "al5"),
    ]
