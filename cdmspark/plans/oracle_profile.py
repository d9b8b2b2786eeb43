"""DuckDB SQL for profiling the sales uploads."""

from __future__ import annotations

from .. import model
from ..operators.profile import DATE_RX, INT_RX, NUM_RX
from .oracle_sales import ORDER_COLS, raw_rows_sql

TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in model.PANDAS_NULL_TOKENS)


def _rows(cap: int | None) -> str:
    if not cap:
        return raw_rows_sql()
    return f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY {ORDER_COLS}) AS rn
                 FROM ({raw_rows_sql()}) r0) r1
  WHERE rn <= {cap}
"""


def _long(cap: int | None) -> str:
    return f"""
  SELECT upload_id, names, {ORDER_COLS}, unnest(vals) AS value,
         generate_subscripts(vals, 1) AS ordinal
  FROM ({_rows(cap)}) r
"""


def profile_sql(mode: str = "typed", cap: int | None = None) -> str:
    if mode == "compat":
        cdm = """CASE WHEN n_nonnull = 0 THEN 'decimal'
                      WHEN all_int AND null_count = 0 THEN 'integer'
                      WHEN all_num THEN 'decimal' ELSE 'string' END"""
        dtype = """CASE WHEN n_nonnull = 0 THEN 'float64'
                        WHEN all_int AND null_count = 0 THEN 'int64'
                        WHEN all_num THEN 'float64'
                        WHEN all_bool AND null_count = 0 THEN 'bool' ELSE 'object' END"""
    else:
        cdm = """CASE WHEN n_nonnull = 0 THEN 'string' WHEN all_int THEN 'integer'
                      WHEN all_num THEN 'decimal' WHEN all_date THEN 'date' ELSE 'string' END"""
        dtype = """CASE WHEN n_nonnull = 0 THEN 'object'
                        WHEN all_int THEN (CASE WHEN null_count = 0 THEN 'int64' ELSE 'Int64' END)
                        WHEN all_num THEN 'float64' WHEN all_date THEN 'date'
                        WHEN all_bool THEN 'boolean' ELSE 'object' END"""
    if mode == "compat":
        samples = """CASE WHEN dtype = 'int64'
                          THEN list_transform(raw, lambda x: CAST(TRY_CAST(trim(x) AS BIGINT) AS VARCHAR))
                          WHEN dtype = 'float64'
                          THEN list_transform(raw, lambda x: CAST(TRY_CAST(trim(x) AS DOUBLE) AS VARCHAR))
                          ELSE raw END"""
    else:
        samples = "raw"
    return f"""
WITH f AS (
  SELECT *, (value IS NULL OR value IN ({TOKENS})) AS is_null,
         regexp_matches(trim(value), '{INT_RX}') AS is_int,
         regexp_matches(trim(value), '{NUM_RX}') AS is_num,
         (regexp_matches(trim(value), '{DATE_RX}') AND TRY_CAST(trim(value) AS DATE) IS NOT NULL)
             AS is_date,
         lower(trim(value)) IN ('true', 'false') AS is_bool
  FROM ({_long(cap)}) l
), agg AS (
  SELECT upload_id, ordinal, any_value(names[ordinal]) AS column_name,
         count(*) FILTER (WHERE is_null) AS null_count,
         count(*) FILTER (WHERE NOT is_null) AS n_nonnull,
         count(DISTINCT CASE WHEN NOT is_null THEN value END) AS unique_count,
         bool_and(is_null OR is_int) AS all_int, bool_and(is_null OR is_num) AS all_num,
         bool_and(is_null OR is_date) AS all_date, bool_and(is_null OR is_bool) AS all_bool
  FROM f GROUP BY upload_id, ordinal
), smp AS (
  SELECT upload_id, ordinal, list(value ORDER BY rn) AS raw FROM (
    SELECT upload_id, ordinal, value,
           row_number() OVER (PARTITION BY upload_id, ordinal ORDER BY {ORDER_COLS}) AS rn
    FROM f WHERE NOT is_null) s
  WHERE rn <= {model.SAMPLE_VALUES}
  GROUP BY upload_id, ordinal
), cls AS (
  SELECT agg.*, {cdm} AS cdm_type, {dtype} AS dtype, coalesce(smp.raw, []::VARCHAR[]) AS raw
  FROM agg LEFT JOIN smp USING (upload_id, ordinal)
)
SELECT upload_id, column_name, CAST(ordinal AS INTEGER) AS ordinal, dtype, cdm_type,
       {samples} AS sample_values, CAST(null_count AS BIGINT) AS null_count,
       CAST(unique_count AS BIGINT) AS unique_count
FROM cls
"""


def upload_summary_sql(cap: int = model.ROW_CAP) -> str:
    return f"""
SELECT upload_id, CAST(least(count(*), {cap}) AS BIGINT) AS row_count,
       CAST(count(*) AS BIGINT) AS true_row_count, CAST(len(any_value(names)) AS INTEGER)
       AS column_count
FROM ({raw_rows_sql()}) r GROUP BY upload_id
"""


def sample_rows_sql(n: int = model.SAMPLE_ROWS) -> str:
    return f"""
WITH r AS (
  SELECT upload_id, rn, names, vals FROM ({_rows(n)}) x
), cells AS (
  SELECT upload_id, rn, unnest(names) AS name, unnest(vals) AS value,
         generate_subscripts(names, 1) AS ordinal FROM r
), recs AS (
  SELECT upload_id, rn,
         '{{' || string_agg(to_json(name) || ':' || coalesce(to_json(value), 'null'), ','
                            ORDER BY ordinal) || '}}' AS rec
  FROM cells GROUP BY upload_id, rn
)
SELECT upload_id, '[' || string_agg(rec, ',' ORDER BY rn) || ']' AS sample_data_json
FROM recs GROUP BY upload_id
"""


def layout_signatures_sql() -> str:
    return f"""
SELECT DISTINCT upload_id, array_to_string(names, ' ') AS layout_text,
       sha256(array_to_string(names, ' ')) AS layout_id
FROM ({raw_rows_sql()}) r
"""


def table_counts_sql(tables: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}"
        for t in tables)
