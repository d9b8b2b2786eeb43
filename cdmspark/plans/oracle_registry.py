"""DuckDB SQL for the registry (D1-D4, A2, M9, S9) and the data checks (V1-V5)."""

from __future__ import annotations

from .. import model
from .oracle_workflow import proposals_sql, entries_sql, uploads_sql
from .sqltext import values

AS_OF = "TIMESTAMP '2026-01-01 00:00:00'"
SEED = values([r for r in model.CDM_FIELDS],
              ["field_id", "field_name", "display_name", "data_type", "description",
               "is_required", "example_values"], "cs")


def seed_sql() -> str:
    return f"""
  SELECT field_id, field_name, display_name, data_type, description, is_required, example_values,
         '{model.CDM_SEED_ADDED_BY}' AS added_by, {AS_OF} AS added_at,
         '{model.CDM_SEED_ADDED_BY}' AS source_customer
  FROM {SEED}
"""


def _norm(c: str) -> str:
    s = f"regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    s = f"regexp_replace({s}, '[^A-Za-z0-9]+', '_', 'g')"
    return f"lower(regexp_replace({s}, '^_+|_+$', '', 'g'))"


def unmapped_sql() -> str:
    e = entries_sql(proposals_sql(), "mapping_json", ["mapping_id", "upload_id", "customer_id"])
    return f"""
  SELECT e.mapping_id, e.upload_id, e.customer_id, e.source_column,
         coalesce(nullif(json_extract_string(u.schema_json, '$."' || e.source_column || '".cdm_type'),
                         ''),
                  json_extract_string(u.schema_json, '$."' || e.source_column || '".type'),
                  CASE WHEN json_exists(u.schema_json, '$."' || e.source_column || '"')
                       THEN 'string' END) AS profile_type
  FROM ({e}) e LEFT JOIN ({uploads_sql()}) u ON u.upload_id = e.upload_id
  WHERE e.source_column IS NOT NULL AND e.cdm_field IS NULL
"""


def candidates_sql(min_customers: int = 1) -> str:
    return f"""
  SELECT field_name, count(DISTINCT customer_id) AS n_customers, count(*) AS n_columns,
         min(source_column) AS example_source_column,
         coalesce(max(CASE WHEN upper(coalesce(profile_type, 'string'))
                                IN ('INTEGER', 'DECIMAL', 'DATE')
                           THEN upper(profile_type) END), 'STRING') AS data_type,
         min(customer_id) AS source_customer
  FROM (SELECT *, {_norm('source_column')} AS field_name FROM ({unmapped_sql()}) x) y
  GROUP BY field_name HAVING count(DISTINCT customer_id) >= {min_customers}
"""


def _initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")


def added_sql() -> str:
    return f"""
  WITH cand AS ({candidates_sql()}),
  prop AS (
    SELECT field_name, {_initcap("replace(field_name, '_', ' ')")} AS display_name, data_type,
           concat('Proposed from source column ', example_source_column) AS description,
           example_source_column AS example_values, FALSE AS is_required, source_customer
    FROM cand),
  seed AS ({seed_sql()}),
  nxt AS (SELECT coalesce(max(TRY_CAST(regexp_extract(field_id, '([0-9]+)', 1) AS INTEGER)), 0) + 1
                 AS next_no FROM seed)
  SELECT printf('f%03d', nxt.next_no + row_number() OVER (ORDER BY p.field_name) - 1) AS field_id,
         p.field_name, p.display_name, p.data_type, p.description, p.is_required, p.example_values,
         'user' AS added_by, {AS_OF} AS added_at, p.source_customer, 'added' AS outcome
  FROM prop p CROSS JOIN nxt
  WHERE p.field_name NOT IN (SELECT field_name FROM seed)
  UNION ALL
  SELECT NULL, p.field_name, p.display_name, p.data_type, p.description, p.is_required,
         p.example_values, 'user', {AS_OF}, p.source_customer, 'refused: exists'
  FROM prop p WHERE p.field_name IN (SELECT field_name FROM seed)
"""


def registry_sql() -> str:
    return f"""
  SELECT * FROM ({seed_sql()}) s
  UNION ALL
  SELECT field_id, field_name, display_name, data_type, description, is_required, example_values,
         added_by, added_at, source_customer FROM ({added_sql()}) a WHERE outcome = 'added'
"""
