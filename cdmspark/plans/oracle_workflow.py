"""DuckDB SQL for the workflow tables derived from ``events`` (W1-W8, M7, M8, M12-M14, J, F)."""

from __future__ import annotations

from .. import model
from ..sources import workflow_events as WE
from .sqltext import values

LAYOUT_INFO = values([(i, t, s, sd, len(c)) for (i, sd), (t, s, c)
                      in zip(WE.schema_docs(), model.LAYOUTS)],
                     ["layout", "customer_id", "source_system", "schema_json", "column_count"],
                     "li")
TEMPLATES = values(WE.reply_templates(),
                   ["layout", "variant", "prefix", "suffix", "has_conf"], "tp")
EDITED = values(WE.edited_docs(), ["layout", "edited"], "ed")

EV = """
  SELECT event_id, ts, event_type, value, concat('WU', user_id) AS upload_id,
         CAST(user_id % 6 AS INTEGER) AS layout,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
"""

WS = r"'^\s+|\s+$'"


def _clean(x: str) -> str:
    raw = f"regexp_replace({x}, {WS}, '', 'g')"
    inner = f"string_split({raw}, '```')[2]"
    inner2 = f"CASE WHEN starts_with({inner}, 'json') THEN substr({inner}, 5) ELSE {inner} END"
    return (f"regexp_replace(CASE WHEN starts_with({raw}, '```') THEN {inner2} ELSE {raw} END,"
            f" {WS}, '', 'g')")


def replies_sql() -> str:
    return f"""
  SELECT e.event_id, e.upload_id, e.layout, e.ts,
         concat(tp.prefix,
                CASE WHEN tp.has_conf THEN concat(
                   CAST(floor(e.value / m.vmax * 100 + 0.5) AS BIGINT) // 100, '.',
                   lpad(CAST(CAST(floor(e.value / m.vmax * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR),
                        2, '0'))
                     ELSE '' END,
                tp.suffix) AS reply_text
  FROM ({EV}) e
  CROSS JOIN (SELECT max(value) AS vmax FROM events) m
  JOIN {TEMPLATES} ON tp.layout = e.layout
       AND tp.variant = CASE WHEN e.k % 10 < 4 THEN e.k % 10 ELSE 4 END
  WHERE e.event_type = 'click'
"""


def parsed_sql() -> str:
    return f"""
  SELECT *, {_clean('reply_text')} AS clean,
         coalesce(json_valid({_clean('reply_text')}) AND starts_with({_clean('reply_text')}, '{{'),
                  FALSE) AS parse_ok
  FROM ({replies_sql()}) r
"""


def proposals_sql() -> str:
    return f"""
  SELECT concat('M', p.event_id) AS mapping_id, p.event_id, p.upload_id, li.customer_id,
         p.ts AS proposed_at, p.clean AS mapping_json,
         coalesce(CAST(json_extract(p.clean, '$.overall_confidence') AS DOUBLE), 0.0)
             AS confidence_score,
         coalesce(json_extract_string(p.clean, '$.notes'), '') AS llm_reasoning,
         '[]' AS similar_mapping_ids
  FROM ({parsed_sql()}) p JOIN {LAYOUT_INFO} ON li.layout = p.layout
  WHERE p.parse_ok
"""


def uploads_sql() -> str:
    return f"""
  SELECT e.upload_id, li.customer_id,
         concat(lower(li.customer_id), '_', lower(li.source_system), '_upload_',
                substr(e.upload_id, 3), '.csv') AS file_name,
         li.source_system, e.uploaded_at, e.row_count, li.column_count, li.schema_json,
         '[]' AS sample_data_json, CAST(NULL AS VARCHAR) AS error_message, e.layout
  FROM (SELECT upload_id, layout, min(ts) FILTER (WHERE event_type = 'signup') AS uploaded_at,
               CAST(count(*) AS BIGINT) AS row_count
        FROM ({EV}) x GROUP BY upload_id, layout) e
  JOIN {LAYOUT_INFO} ON li.layout = e.layout
"""


def decisions_sql() -> str:
    return f"""
  SELECT d.event_id, d.upload_id, d.layout, d.ts, d.decision, d.reviewer, d.reviewer_notes,
         d.final_mapping_json,
         CASE WHEN d.prev_click IS NOT NULL THEN concat('M', d.prev_click) END AS mapping_id
  FROM (
    SELECT a.*, last_value(click_id IGNORE NULLS) OVER (
             PARTITION BY upload_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_click
    FROM (
      SELECT e.event_id, e.upload_id, e.layout, e.ts, e.event_type,
             CASE WHEN e.event_type = 'click' THEN e.event_id END AS click_id,
             CASE WHEN e.event_type = 'purchase' THEN 'APPROVED' ELSE 'REJECTED' END AS decision,
             CAST(NULL AS VARCHAR) AS reviewer, '' AS reviewer_notes,
             CASE WHEN e.k % 4 = 0 THEN ed.edited ELSE '' END AS final_mapping_json
      FROM ({EV}) e JOIN {EDITED} ON ed.layout = e.layout
      WHERE e.event_type IN ('click', 'purchase', 'error')) a
  ) d
  WHERE d.event_type IN ('purchase', 'error')
"""


def validated_sql() -> str:
    return f"""
  SELECT concat('R', d.event_id) AS review_id, d.event_id, d.mapping_id, d.upload_id,
         coalesce(d.reviewer, '{model.DEFAULT_REVIEWER}') AS reviewer, d.decision,
         d.ts AS reviewed_at, d.reviewer_notes,
         coalesce(nullif(d.final_mapping_json, ''), m.mapping_json) AS final_mapping_json,
         m.mapping_json AS proposed_mapping_json, u.schema_json AS source_schema,
         coalesce(u.customer_id, m.customer_id) AS customer_id,
         CASE WHEN m.mapping_id IS NULL THEN 'unknown mapping'
              WHEN u.upload_id IS NULL THEN 'unknown upload'
              WHEN d.decision NOT IN ('APPROVED', 'REJECTED') OR d.decision IS NULL
                   THEN 'bad decision' END AS reject_reason
  FROM ({decisions_sql()}) d
  LEFT JOIN ({proposals_sql()}) m ON m.mapping_id = d.mapping_id
  LEFT JOIN ({uploads_sql()}) u ON u.upload_id = d.upload_id
"""


def reviews_sql() -> str:
    return f"SELECT * FROM ({validated_sql()}) v WHERE reject_reason IS NULL"


def _labels_case(col: str) -> str:
    parts = " ".join(f"WHEN '{c}' THEN '{lab}'" for c, lab in model.STATUS_LABELS)
    return f"coalesce(CASE {col} {parts} END, '{model.STATUS_LABEL_DEFAULT}')"


def upload_status_sql() -> str:
    return f"""
  WITH se AS (
    SELECT upload_id, ts, event_id, 'PENDING_MAPPING' AS status FROM ({EV}) e
    WHERE event_type = 'signup'
    UNION ALL
    SELECT upload_id, proposed_at, event_id, 'PENDING_REVIEW' FROM ({proposals_sql()}) p
    UNION ALL
    SELECT upload_id, reviewed_at, event_id,
           CASE WHEN decision = 'APPROVED' THEN 'APPROVED' ELSE 'PENDING_MAPPING' END
    FROM ({reviews_sql()}) r
  ), st AS (
    SELECT upload_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS status_at
    FROM se GROUP BY upload_id
  )
  SELECT u.*, coalesce(st.status, 'PENDING_MAPPING') AS status, st.status_at,
         {_labels_case("coalesce(st.status, 'PENDING_MAPPING')")} AS status_label
  FROM ({uploads_sql()}) u LEFT JOIN st USING (upload_id)
"""


def mapping_status_sql() -> str:
    return f"""
  WITH se AS (
    SELECT mapping_id, proposed_at AS ts, event_id, 'PENDING' AS status FROM ({proposals_sql()}) p
    UNION ALL
    SELECT mapping_id, reviewed_at, event_id, decision FROM ({reviews_sql()}) r
  ), st AS (
    SELECT mapping_id, arg_max(status, (ts, event_id)) AS status FROM se GROUP BY mapping_id
  )
  SELECT p.*, st.status FROM ({proposals_sql()}) p LEFT JOIN st USING (mapping_id)
"""


def approved_sql() -> str:
    return f"""
  SELECT mapping_id, r.upload_id, r.customer_id, r.source_schema, r.cdm_mapping, r.approved_by,
         r.approved_at
  FROM (
    SELECT mapping_id,
           arg_max({{'upload_id': upload_id, 'customer_id': customer_id,
                    'source_schema': source_schema, 'cdm_mapping': final_mapping_json,
                    'approved_by': reviewer, 'approved_at': reviewed_at}},
                   (reviewed_at, event_id)) AS r
    FROM ({reviews_sql()}) x WHERE decision = 'APPROVED' GROUP BY mapping_id) t
"""


def entries_sql(src: str, json_col: str, keys: list[str]) -> str:
    """One row per entry of each document (documents without entries keep one NULL row)."""
    k = ", ".join(keys)
    hi, mid = model.BAND_HIGH, model.BAND_MEDIUM
    return f"""
  SELECT {k}, CAST(entry_no AS INTEGER) AS entry_no,
         json_extract_string(e, '$.source_column') AS source_column,
         json_extract_string(e, '$.cdm_field') AS cdm_field,
         json_extract_string(e, '$.transformation') AS transformation,
         CAST(json_extract(e, '$.confidence') AS DOUBLE) AS confidence,
         json_extract_string(e, '$.reasoning') AS reasoning,
         CASE WHEN CAST(json_extract(e, '$.confidence') AS DOUBLE) >= {hi} THEN 'high'
              WHEN CAST(json_extract(e, '$.confidence') AS DOUBLE) >= {mid} THEN 'medium'
              ELSE 'low' END AS band,
         CAST(floor(CAST(json_extract(e, '$.confidence') AS DOUBLE) * 100 + 0.5) AS INTEGER)
             AS percent
  FROM (
    SELECT {k}, unnest(CASE WHEN len(ents) = 0 THEN [NULL] ELSE ents END) AS e,
           unnest(CASE WHEN len(ents) = 0 THEN [NULL] ELSE range(1, len(ents) + 1) END)
               AS entry_no
    FROM (SELECT {k}, coalesce(CAST(json_extract(CASE WHEN json_valid({json_col})
                                                      THEN {json_col} END, '$.mappings[*]')
                                    AS JSON[]), []) AS ents
          FROM ({src}) s0) s1
  ) s2
"""


def strict_states_sql() -> str:
    """W4 as an ordered fold of each upload's steps; the accumulator is state + 4 * illegal steps
    (states 0 none, 1 waiting for a mapping, 2 in review, 3 approved)."""
    return f"""
  WITH st AS (
    SELECT upload_id, ts, event_id, 0 AS step FROM ({EV}) e WHERE event_type = 'signup'
    UNION ALL SELECT upload_id, proposed_at, event_id, 1 FROM ({proposals_sql()}) p
    UNION ALL SELECT upload_id, reviewed_at, event_id, CASE WHEN decision = 'APPROVED' THEN 2 ELSE 3 END
    FROM ({reviews_sql()}) r
  ), l AS (SELECT upload_id, list(step ORDER BY ts, event_id) AS steps, count(*) AS n_steps FROM st GROUP BY upload_id),
  f AS (SELECT upload_id, n_steps, list_reduce(list_prepend(0, steps), lambda a, s:
          CASE WHEN s = 0 AND a % 4 <> 2 THEN a - a % 4 + 1
               WHEN s = 1 AND a % 4 = 1 THEN a + 1
               WHEN s = 2 AND a % 4 = 2 THEN a + 1
               WHEN s = 3 AND a % 4 = 2 THEN a - 1
               ELSE a + 4 END) AS acc FROM l)
  SELECT upload_id, ['NONE', 'PENDING_MAPPING', 'PENDING_REVIEW', 'APPROVED'][acc % 4 + 1] AS state,
         CAST(acc // 4 AS BIGINT) AS illegal_steps, CAST(n_steps AS BIGINT) AS n_steps
  FROM f
"""
