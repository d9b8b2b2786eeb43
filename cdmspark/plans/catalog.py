"""Every registered query with its DuckDB oracle; one entry per operator of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import conform as C
from . import oracle_sales as OS
from . import sales as SP
from .registry import register


# --- conforming (C1-C8) and the flagship (Q12) -------------------------------------------

@register("tenant_region_totals", OS.totals_sql("region"))
def tenant_region_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Q12 flagship: conform all uploads, then totals per tenant and region."""
    return SP.tenant_region_totals(spark, sf)


@register("conform_sales", OS.sales_sql())
def conform_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows of all uploads in the 20-column sales layout."""
    return SP.sales(spark, sf)


@register("load_report", OS.load_report_sql())
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-upload load quality."""
    return C.load_report(SP.checked(spark, sf))


@register("load_accounting", OS.load_accounting_sql(SP.UNAPPROVED))
def load_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """C1 + C7: no row is lost on the way in, with an upload that has no approved mapping."""
    return SP.load_accounting(spark, sf)


@register("conform_transformed", OS.transformed_sql())
def conform_transformed(spark: SparkSession, sf: str) -> DataFrame:
    """C3 + C4: divide, multiply, casts, dates, trim, upper, lower; unusable ones are rejected."""
    return SP.conform_transformed(spark, sf)


# --- profiling (P1-P9, S3, S4, S12) -------------------------------------------------------

from ..operators import profile as P  # noqa: E402
from ..sources import tables as TB  # noqa: E402
from ..sources import testdata as TD  # noqa: E402
from . import oracle_profile as OP  # noqa: E402
from .oracle_sales import raw_rows_sql as _raw_rows_sql  # noqa: E402
from .. import model as _m  # noqa: E402


@register("profile_columns", OP.profile_sql("typed"))
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P1-P5 typed mode over every row of every upload."""
    return P.profile(TD.landed_rows(spark, sf), TD.sales_headers(spark, sf), "typed")


@register("profile_columns_compat", OP.profile_sql("compat"))
def profile_columns_compat(spark: SparkSession, sf: str) -> DataFrame:
    """P1-P5 in pandas-compatible mode over every row."""
    return P.profile(TD.landed_rows(spark, sf), TD.sales_headers(spark, sf), "compat")


@register("upload_summary", OP.upload_summary_sql())
def upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    """P6 + S3: capped and true row counts, column count per upload."""
    return P.upload_summary(TD.sales_rows(spark, sf), TD.sales_headers(spark, sf), _m.ROW_CAP)


@register("sample_rows_json", OP.sample_rows_sql())
def sample_rows_json(spark: SparkSession, sf: str) -> DataFrame:
    """First five rows of each upload as JSON records."""
    return P.sample_rows_json(TD.sales_rows(spark, sf), TD.sales_headers(spark, sf))


@register("profile_json", f"""
  SELECT upload_id, '{{' || string_agg(to_json(column_name) || ':' || to_json({{
           'dtype': dtype, 'cdm_type': cdm_type, 'sample_values': sample_values, 'null_count': null_count,
           'unique_count': unique_count}}), ',' ORDER BY ordinal) || '}}' AS schema_json
  FROM ({OP.profile_sql("typed")}) p GROUP BY upload_id""")
def profile_json(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of each upload as one JSON document (form 1)."""
    return P.profile_json(profile_columns(spark, sf))


@register("layout_signatures", OP.layout_signatures_sql())
def layout_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Layout text and id per upload."""
    return P.layout_signatures(TD.sales_headers(spark, sf))


@register("table_counts", OP.table_counts_sql(TB.TABLES))
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row count of every table."""
    return P.table_counts({t: TB.table(spark, sf, t) for t in TB.TABLES})


# --- workflow (W1-W8), mapping documents (M7, M8, M12-M14, A3), joins (J1-J5), F, O ----------

from ..operators import mapping_doc as MD  # noqa: E402
from ..functions import exprs as AKX  # noqa: E402
from ..operators import workflow as W  # noqa: E402
from ..sources import workflow_events as WE  # noqa: E402
from . import oracle_workflow as OW  # noqa: E402
from . import workflow as WP  # noqa: E402
from ..functions.materialize import materialize as _mat  # noqa: E402


@register("parse_replies", f"""
  SELECT event_id, upload_id, parse_ok, CASE WHEN parse_ok THEN clean END AS mapping_json,
         CASE WHEN NOT parse_ok THEN concat('invalid JSON; raw: ', left(reply_text, 500)) END
             AS parse_error,
         CASE WHEN parse_ok THEN CAST(json_extract(clean, '$.overall_confidence') AS DOUBLE) END
             AS overall_confidence
  FROM ({OW.parsed_sql()}) p""")
def parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model reply text -> mapping document, or a parse error with an excerpt."""
    return WP.parsed_replies(spark, sf).select(
        "event_id", "upload_id", "parse_ok", "mapping_json", "parse_error",
        F.col("doc.overall_confidence").alias("overall_confidence"))


@register("upload_status", OW.upload_status_sql())
def upload_status(spark: SparkSession, sf: str) -> DataFrame:
    """W1 + W6: current status and label of every upload."""
    return WP.uploads_with_status(spark, sf)


@register("mapping_status", OW.mapping_status_sql())
def mapping_status(spark: SparkSession, sf: str) -> DataFrame:
    """Current status of every proposal."""
    return WP.mappings_with_status(spark, sf)


@register("validate_decisions", OW.validated_sql())
def validate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """W3 + W7 + V5: decision batch checked against proposals and uploads."""
    return WP.Flow(spark, sf).validated


@register("approved_corpus", OW.approved_sql())
def approved_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Approved mappings, latest approval per mapping."""
    return W.approved_corpus(WP.reviews(spark, sf))


@register("approved_load", OS.approved_load_sql(
    OW.approved_sql(), OW.entries_sql("SELECT * FROM a", "cdm_mapping", ["mapping_id"])))
def approved_load(spark: SparkSession, sf: str) -> DataFrame:
    """W5 -> M14 -> C1 -> S11: approved mappings, edits included, decide what is loaded."""
    return SP.approved_load(spark, sf)


@register("mapping_entries", OW.entries_sql(OW.proposals_sql(), "mapping_json", ["mapping_id"]))
def mapping_entries(spark: SparkSession, sf: str) -> DataFrame:
    """M14 + M13: entries of every proposal with confidence band and percent."""
    return MD.mapping_entries(WP.proposals(spark, sf))


@register("mapping_doc_summary", f"""
  WITH e AS ({OW.entries_sql(OW.proposals_sql(), "mapping_json", ["mapping_id"])}),
  m AS (SELECT mapping_id, count(source_column) AS n_entries,
               count(*) FILTER (WHERE cdm_field IS NOT NULL) AS n_mapped,
               sum(CASE WHEN cdm_field IS NOT NULL THEN coalesce(confidence, 0.0) END) AS s
        FROM e GROUP BY mapping_id)
  SELECT p.mapping_id, p.confidence_score AS overall_confidence,
         CASE WHEN m.n_mapped > 0 THEN round(m.s / m.n_mapped, 6) ELSE 0.0 END AS mean_confidence,
         CAST(m.n_entries AS INTEGER) AS n_entries, CAST(m.n_mapped AS INTEGER) AS n_mapped,
         CAST(coalesce(json_array_length(p.mapping_json, '$.unmapped_cdm_fields'), 0) AS INTEGER)
             AS n_unmapped,
         CASE WHEN p.confidence_score >= {_m.BAND_HIGH} THEN 'high'
              WHEN p.confidence_score >= {_m.BAND_MEDIUM} THEN 'medium' ELSE 'low' END AS band,
         CAST(floor(p.confidence_score * 100 + 0.5) AS INTEGER) AS percent
  FROM ({OW.proposals_sql()}) p JOIN m USING (mapping_id)""")
def mapping_doc_summary(spark: SparkSession, sf: str) -> DataFrame:
    """M7 + A3 + M13: stated and recomputed confidence, entry counts, band per proposal."""
    return MD.doc_summary(WP.proposals(spark, sf))


# --- more workflow views: M8, W8, J1-J5, F1-F3, O1-O3, P8 ---------------------------------

from ..operators import registry as RG  # noqa: E402
from . import oracle_registry as ORG  # noqa: E402

_UPLOAD_COLS = ["upload_id", "customer_id", "file_name", "source_system", "uploaded_at",
                "row_count", "column_count", "schema_json", "sample_data_json", "error_message",
                "layout"]
_MAP_COLS = ["mapping_id", "event_id", "upload_id", "customer_id", "proposed_at", "mapping_json",
             "confidence_score", "llm_reasoning", "similar_mapping_ids"]


def _cdm(spark: SparkSession) -> DataFrame:
    return RG.cdm_seed(spark, SP.AS_OF)


@register("unmapped_cdm_fields", f"""
  WITH e AS ({OW.entries_sql(OW.proposals_sql(), "mapping_json", ["mapping_id"])}),
  f AS (SELECT DISTINCT mapping_id, cdm_field FROM e WHERE cdm_field IS NOT NULL),
  ids AS (SELECT DISTINCT mapping_id FROM ({OW.proposals_sql()}) p),
  miss AS (SELECT i.mapping_id, c.field_name FROM ids i CROSS JOIN ({ORG.seed_sql()}) c
           WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.mapping_id = i.mapping_id
                                              AND f.cdm_field = c.field_name)),
  agg AS (SELECT mapping_id, list_sort(list(field_name)) AS l FROM miss GROUP BY mapping_id)
  SELECT i.mapping_id, coalesce(agg.l, []::VARCHAR[]) AS unmapped_cdm_fields,
         CAST(coalesce(len(agg.l), 0) AS INTEGER) AS n_unmapped
  FROM ids i LEFT JOIN agg USING (mapping_id)""")
def unmapped_cdm_fields(spark: SparkSession, sf: str) -> DataFrame:
    """M8: CDM fields no entry of a proposal targets."""
    return MD.unmapped_fields(WP.proposals(spark, sf), _cdm(spark))


@register("edit_history", f"""
  WITH b AS ({OW.entries_sql(OW.reviews_sql(), "proposed_mapping_json",
                             ["review_id", "mapping_id"])}),
  a AS ({OW.entries_sql(OW.reviews_sql(), "final_mapping_json", ["review_id", "mapping_id"])})
  SELECT coalesce(b.review_id, a.review_id) AS review_id,
         coalesce(b.mapping_id, a.mapping_id) AS mapping_id,
         coalesce(b.source_column, a.source_column) AS source_column,
         b.cdm_field AS field_before, b.transformation AS transformation_before,
         a.cdm_field AS field_after, a.transformation AS transformation_after
  FROM b FULL OUTER JOIN a ON a.review_id = b.review_id AND a.mapping_id = b.mapping_id
                          AND a.source_column = b.source_column
  WHERE coalesce(b.source_column, a.source_column) IS NOT NULL
    AND (b.cdm_field IS DISTINCT FROM a.cdm_field
         OR b.transformation IS DISTINCT FROM a.transformation)""")
def edit_history(spark: SparkSession, sf: str) -> DataFrame:
    """Entries a reviewer changed, per review."""
    return MD.edit_history(WP.reviews(spark, sf))


@register("pending_queue", f"""
  SELECT m.*, u.file_name, u.source_system, u.row_count
  FROM ({OW.mapping_status_sql()}) m JOIN ({OW.uploads_sql()}) u USING (upload_id)
  WHERE m.status = 'PENDING'""")
def pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    """J1 (F3 'pending'): pending proposals with upload details."""
    f = WP.Flow(spark, sf)
    return W.reviews_view("pending", f.review_table, f.mappings_with_status, f.uploads)


@register("completed_reviews", f"""
  SELECT r.review_id, r.event_id, r.mapping_id, r.upload_id, r.reviewer, r.decision,
         r.reviewed_at, r.reviewer_notes, r.final_mapping_json, m.mapping_json,
         m.confidence_score, u.file_name, u.customer_id
  FROM ({OW.reviews_sql()}) r JOIN ({OW.proposals_sql()}) m USING (mapping_id)
  JOIN ({OW.uploads_sql()}) u ON u.upload_id = r.upload_id""")
def completed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """J2 (F3 'completed'): reviews with proposal and upload details (3-way join)."""
    f = WP.Flow(spark, sf)
    return W.reviews_view("completed", f.review_table, f.proposals, f.uploads)


@register("all_mappings", f"""
  SELECT m.*, u.file_name, u.source_system, u.row_count
  FROM ({OW.mapping_status_sql()}) m JOIN ({OW.uploads_sql()}) u USING (upload_id)""")
def all_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """J3 (F3 default): every proposal with upload details."""
    f = WP.Flow(spark, sf)
    return W.reviews_view(None, f.review_table, f.mappings_with_status, f.uploads)


@register("mapping_detail", f"""
  SELECT m.*, {", ".join(f"u.{c} AS upload_{c}" for c in _UPLOAD_COLS if c != "upload_id")}
  FROM ({OW.mapping_status_sql()}) m LEFT JOIN ({OW.uploads_sql()}) u USING (upload_id)""")
def mapping_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every proposal with its upload when there is one."""
    f = WP.Flow(spark, sf)
    return W.mapping_detail(f.mappings_with_status, f.uploads)


@register("entries_with_definitions", f"""
  SELECT e.*, c.display_name, c.data_type, c.description, c.is_required
  FROM ({OW.entries_sql(OW.proposals_sql(), "mapping_json", ["mapping_id"])}) e
  LEFT JOIN ({ORG.seed_sql()}) c ON c.field_name = e.cdm_field""")
def entries_with_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Proposal entries beside the CDM definition of their target field."""
    return W.entries_with_definitions(MD.mapping_entries(WP.proposals(spark, sf)), _cdm(spark))


@register("uploads_for_customer", f"""
  SELECT * FROM ({OW.upload_status_sql()}) u WHERE customer_id = 'CUST_002'""")
def uploads_for_customer(spark: SparkSession, sf: str) -> DataFrame:
    """uploads filtered by an optional tenant argument (here CUST_002)."""
    return W.filter_eq(WP.uploads_with_status(spark, sf), "customer_id", "CUST_002")


@register("latest_upload_detail", f"""
  SELECT * FROM ({OW.upload_status_sql()}) u
  WHERE upload_id = (SELECT arg_max(upload_id, (uploaded_at, upload_id))
                     FROM ({OW.uploads_sql()}) x)""")
def latest_upload_detail(spark: SparkSession, sf: str) -> DataFrame:
    """key lookup of one upload — the most recently uploaded one (empty if none)."""
    f = WP.Flow(spark, sf)
    key = f.uploads.agg(F.max_by("upload_id", F.struct("uploaded_at", "upload_id")).alias("upload_id"))
    return f.uploads_with_status.join(F.broadcast(key), "upload_id")


@register("uploads_newest_first", f"""
  SELECT upload_id, customer_id, file_name, uploaded_at, status, status_label
  FROM ({OW.upload_status_sql()}) u""")
def uploads_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """O1 + W6: upload history newest first, with status label."""
    return W.newest_first(WP.uploads_with_status(spark, sf), "uploaded_at", "upload_id").select(
        "upload_id", "customer_id", "file_name", "uploaded_at", "status", "status_label")


@register("upload_history", f"""
  SELECT upload_id, left(upload_id, 8) AS short_id, file_name, status_label,
         strftime(uploaded_at, '%b %-d, %Y, %I:%M %p') AS uploaded_label,
         sha256(concat_ws('|', upload_id, customer_id)) AS history_id
  FROM ({OW.upload_status_sql()}) u""")
def upload_history(spark: SparkSession, sf: str) -> DataFrame:
    """The upload history as lists show it: id prefix, date label, status label, repeatable id."""
    return WP.uploads_with_status(spark, sf).select(
        "upload_id", AKX.id_prefix(F.col("upload_id")).alias("short_id"), "file_name", "status_label",
        AKX.date_label(F.col("uploaded_at")).alias("uploaded_label"),
        AKX.stable_id(F.col("upload_id"), F.col("customer_id")).alias("history_id"))


@register("latest_uploads_per_customer", f"""
  SELECT customer_id, upload_id, uploaded_at, CAST(rank AS INTEGER) AS rank FROM (
    SELECT customer_id, upload_id, uploaded_at,
           row_number() OVER (PARTITION BY customer_id
                              ORDER BY uploaded_at DESC NULLS LAST, upload_id) AS rank
    FROM ({OW.uploads_sql()}) u) x
  WHERE rank <= 3""")
def latest_uploads_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    """O3: the three newest uploads of each tenant (a top-k report)."""
    ups = WE.uploads(spark, sf)
    return W.top_per_group(ups, ["customer_id"],
                           [F.col("uploaded_at").desc_nulls_last(), F.col("upload_id")], 3) \
        .select("customer_id", "upload_id", "uploaded_at", "rank")


@register("profile_rows_from_json", f"""
  SELECT upload_id, CAST(ordinal AS INTEGER) AS ordinal, column_name,
         coalesce(nullif(json_extract_string(schema_json, '$."' || column_name || '".cdm_type'), ''),
                  json_extract_string(schema_json, '$."' || column_name || '".type'), 'string')
             AS cdm_type,
         coalesce(CAST(json_extract(schema_json, '$."' || column_name || '".sample_values')
                       AS VARCHAR[]), []::VARCHAR[]) AS sample_values,
         CAST(json_extract(schema_json, '$."' || column_name || '".null_count') AS BIGINT)
             AS null_count,
         CAST(json_extract(schema_json, '$."' || column_name || '".unique_count') AS BIGINT)
             AS unique_count,
         json_extract_string(schema_json, '$."' || column_name || '".cdm_field') AS cdm_field
  FROM (SELECT upload_id, schema_json, unnest(json_keys(schema_json)) AS column_name,
               generate_subscripts(json_keys(schema_json), 1) AS ordinal
        FROM ({OW.uploads_sql()}) u) x""")
def profile_rows_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Stored profile documents (either form) back to rows."""
    return P.parse_profile_json(WE.uploads(spark, sf))


# --- registry (D1-D4, A2, M9, S9, S10) ----------------------------------------------------

def _added(spark: SparkSession, sf: str) -> DataFrame:
    cands = RG.extension_candidates(WP.unmapped_source_columns(spark, sf))
    return RG.add_fields(_cdm(spark), RG.candidates_as_proposals(cands), "user", SP.AS_OF)


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    return RG.registry_after(_cdm(spark), _added(spark, sf))


@register("cdm_extension_candidates", ORG.candidates_sql())
def cdm_extension_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """M9: unmapped source columns grouped by normalised name, as candidate CDM fields."""
    return RG.extension_candidates(WP.unmapped_source_columns(spark, sf))


@register("cdm_add_fields", ORG.added_sql())
def cdm_add_fields(spark: SparkSession, sf: str) -> DataFrame:
    """D2 + A2: add the candidates; existing names refused, ids continue the numeric max."""
    return _added(spark, sf)


@register("cdm_registry", f"""
  SELECT r.*, t.total FROM ({ORG.registry_sql()}) r
  CROSS JOIN (SELECT count(*) AS total FROM ({ORG.registry_sql()}) x) t""")
def cdm_registry(spark: SparkSession, sf: str) -> DataFrame:
    """D1 + O2 + S9/S10: every definition by field id with the total."""
    return RG.list_fields(_registry(spark, sf))


@register("cdm_summary", f"""
  SELECT string_agg(printf('%s (%s)', field_name, data_type), ', ' ORDER BY field_id)
             AS cdm_summary, count(*) AS n_fields
  FROM ({ORG.registry_sql()}) r""")
def cdm_summary(spark: SparkSession, sf: str) -> DataFrame:
    """D3: one summary line of all fields."""
    return RG.summary_line(_registry(spark, sf))


@register("cdm_definition_net_revenue", f"""
  SELECT * FROM ({ORG.registry_sql()}) r WHERE field_name = 'net_revenue'""")
def cdm_definition_net_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """The definition of net_revenue."""
    return RG.lookup(_registry(spark, sf), "net_revenue")


@register("cdm_next_id", f"""
  SELECT printf('f%03d', coalesce(max(TRY_CAST(regexp_extract(field_id, '([0-9]+)', 1)
                                               AS INTEGER)), 0) + 1) AS next_field_id
  FROM ({ORG.registry_sql()}) r""")
def cdm_next_id(spark: SparkSession, sf: str) -> DataFrame:
    """A2: the next free field id after the additions."""
    return RG.next_field_number(_registry(spark, sf)).select(
        F.format_string("f%03d", "next_no").alias("next_field_id"))


# --- data checks (V1-V5) ------------------------------------------------------------------

from ..operators import checks as CK  # noqa: E402
from ..functions.local import values_frame as _vf  # noqa: E402


def _customers(spark: SparkSession) -> DataFrame:
    return _vf(spark, [(c, n, i, e, SP.AS_OF) for c, n, i, e in _m.CUSTOMERS],
               _m.CUSTOMERS_SCHEMA)


def _checks_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = WP.Flow(spark, sf)
    ups, maps = _mat(f.uploads_with_status), _mat(f.mappings_with_status)
    revs, reqs = f.review_table, f.decisions  # decision requests before validation
    cust = _customers(spark)
    ups1, up_fk = CK.with_parent(ups, "customer_id", cust, "customer_id")
    maps1, map_fk = CK.with_parent(maps, "upload_id", ups, "upload_id")
    reqs1, req_fk = CK.with_parent(reqs, "mapping_id", maps, "mapping_id")
    lim = _m.VARCHAR_LIMITS
    return CK.union_all([
        CK.check_table(cust, "customers", "customer_id", CK.not_null(["customer_id", "customer_name"])
                       | CK.max_length(cust, lim["customers"])),
        CK.check_table(ups1, "uploads", "upload_id", up_fk | CK.not_null(["customer_id", "file_name"])
                       | CK.max_length(ups, lim["uploads"]) | CK.allowed_values("status", _m.UPLOAD_STATUSES)
                       | {"default status": F.col("status_at").isNull()}
                       | CK.defaults_applied({"source_system": CK.UPLOAD_DEFAULTS["source_system"]})),
        CK.check_table(maps1, "schema_mappings", "mapping_id",
                       map_fk | CK.not_null(["upload_id", "customer_id", "mapping_json"])
                       | CK.max_length(maps, lim["schema_mappings"])
                       | CK.allowed_values("status", _m.MAPPING_STATUSES) | CK.defaults_applied(CK.MAPPING_DEFAULTS)),
        CK.check_table(revs, "mapping_reviews", "review_id", CK.max_length(revs, lim["mapping_reviews"])
                       | CK.allowed_values("decision", _m.DECISIONS)),
        CK.check_table(reqs1, "decision_requests", None, req_fk | CK.defaults_applied(CK.REVIEW_DEFAULTS)),
    ])


def _checks_sql() -> str:
    ups, maps = OW.upload_status_sql(), OW.mapping_status_sql()
    revs, reqs = OW.reviews_sql(), OW.decisions_sql()
    cust = ", ".join(f"'{c[0]}'" for c in _m.CUSTOMERS)
    people = " UNION ALL ".join(
        "SELECT " + ", ".join(f"'{v}' AS {n}" for n, v in zip(
            ["customer_id", "customer_name", "industry", "contact_email"], c)) for c in _m.CUSTOMERS)

    def one(src, table, check, bad):
        return (f"SELECT '{table}' AS table_name, '{check}' AS check_name, "
                f"CAST(count(*) AS BIGINT) AS n_rows, "
                f"CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS n_bad FROM ({src}) s")

    def pk(src, table, key):
        return (f"SELECT '{table}' AS table_name, 'primary key {key}' AS check_name, "
                f"CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, "
                f"CAST(coalesce(sum(CASE WHEN {key} IS NULL OR n > 1 THEN n ELSE 0 END), 0) "
                f"AS BIGINT) AS n_bad "
                f"FROM (SELECT {key}, count(*) AS n FROM ({src}) s GROUP BY {key}) g")

    def fk(src, table, col, parent, pkey):
        return (f"SELECT '{table}' AS table_name, 'foreign key {col}' AS check_name, "
                f"CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE p.k IS NULL) "
                f"AS BIGINT) AS n_bad FROM ({src}) c LEFT JOIN "
                f"(SELECT DISTINCT {pkey} AS k FROM ({parent}) pp) p ON p.k = c.{col}")

    def lens(src, table, limits, cols):
        return [one(src, table, f"length {c} <= {n}", f"length({c}) > {n}")
                for c, n in limits.items() if c in cols]

    up_cols = _UPLOAD_COLS + ["status"]
    map_cols = _MAP_COLS + ["status"]
    rev_cols = WP.REVIEW_COLUMNS
    parts = [
        pk(people, "customers", "customer_id"),
        one(people, "customers", "not null customer_id", "customer_id IS NULL"),
        one(people, "customers", "not null customer_name", "customer_name IS NULL"),
        *lens(people, "customers", _m.VARCHAR_LIMITS["customers"], list(_m.VARCHAR_LIMITS["customers"])),
        one(ups, "uploads", "default status", "status_at IS NULL"),
        one(ups, "uploads", "default source_system", "source_system IS NULL"),
        one(maps, "schema_mappings", "default status", "status IS NULL"),
        pk(ups, "uploads", "upload_id"), pk(maps, "schema_mappings", "mapping_id"),
        pk(revs, "mapping_reviews", "review_id"),
        fk(ups, "uploads", "customer_id", f"SELECT unnest([{cust}]) AS customer_id", "customer_id"),
        fk(maps, "schema_mappings", "upload_id", ups, "upload_id"),
        fk(reqs, "decision_requests", "mapping_id", maps, "mapping_id"),
        one(ups, "uploads", "not null customer_id", "customer_id IS NULL"),
        one(ups, "uploads", "not null file_name", "file_name IS NULL"),
        one(maps, "schema_mappings", "not null upload_id", "upload_id IS NULL"),
        one(maps, "schema_mappings", "not null customer_id", "customer_id IS NULL"),
        one(maps, "schema_mappings", "not null mapping_json", "mapping_json IS NULL"),
        *lens(ups, "uploads", _m.VARCHAR_LIMITS["uploads"], up_cols),
        *lens(maps, "schema_mappings", _m.VARCHAR_LIMITS["schema_mappings"], map_cols),
        *lens(revs, "mapping_reviews", _m.VARCHAR_LIMITS["mapping_reviews"], rev_cols),
        one(ups, "uploads", "allowed status",
            "status IS NOT NULL AND status NOT IN (" +
            ", ".join(f"'{s}'" for s in _m.UPLOAD_STATUSES) + ")"),
        one(maps, "schema_mappings", "allowed status",
            "status IS NOT NULL AND status NOT IN (" +
            ", ".join(f"'{s}'" for s in _m.MAPPING_STATUSES) + ")"),
        one(revs, "mapping_reviews", "allowed decision",
            "decision IS NOT NULL AND decision NOT IN (" +
            ", ".join(f"'{s}'" for s in _m.DECISIONS) + ")"),
        one(reqs, "decision_requests", "default reviewer", "reviewer IS NULL"),
    ]
    return "\nUNION ALL\n".join(parts)


@register("data_checks", _checks_sql())
def data_checks(spark: SparkSession, sf: str) -> DataFrame:
    """V1-V5: keys, references, not-null, lengths, allowed values, defaults — as counts."""
    return _checks_frames(spark, sf)


# --- retrieval (M1-M4, M15) -----------------------------------------------------------------

from ..operators import dense as DN  # noqa: E402
from ..operators import retrieve as RT  # noqa: E402
from ..operators import textindex as TX  # noqa: E402
from . import oracle_retrieve as ORT  # noqa: E402


def _out(top: DataFrame) -> DataFrame:
    return top.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _doc_tfidf(spark: SparkSession, sf: str):
    docs = TB.table(spark, sf, "documents", "doc_id", "text")
    qs = TB.table(spark, sf, "benchmark", "item_id", "text")
    return RT.tfidf(RT.prose_terms(docs, "doc_id", "text"), RT.prose_terms(qs, "item_id", "text"))


def schema_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Approved mappings with their source column names."""
    return _mat(W.approved_corpus(WP.reviews(spark, sf)).withColumn(
        "names", F.json_object_keys("source_schema")))


def schema_names(spark: SparkSession, sf: str) -> DataFrame:
    """Approved mappings (mapping_id, names) without their documents, which no join then moves."""
    reviews = WP.Flow(spark, sf).validated.filter(F.col("reject_reason").isNull())
    return _mat(W.approved_schemas(reviews).select("mapping_id", F.json_object_keys("source_schema").alias("names")))


def _schema_features(spark: SparkSession, sf: str, documents: bool):
    """(corpus rows with their layout, queries, TF-IDF over the corpus' distinct layouts)."""
    corpus = schema_corpus(spark, sf) if documents else schema_names(spark, sf)
    corpus = corpus.withColumn("layout_id", AKX.layout_id_of(F.col("names")))
    queries = _mat(TD.sales_headers(spark, sf))  # read by several branches
    texts = _mat(corpus.groupBy("layout_id").agg(F.min("names").alias("names"), F.count(F.lit(1)).alias("n")))
    weights = RT.tfidf(RT.schema_terms(texts, "layout_id", "names"), RT.schema_terms(queries, "upload_id", "names"),
                       texts.select(F.col("layout_id").alias("id"), "n"))
    return corpus, queries, weights


def _schema_top(spark: SparkSession, sf: str, other_layouts: bool = False,
                documents: bool = True) -> tuple[DataFrame, DataFrame]:
    """(top-k mapping ids per upload, corpus rows): the corpus holds few distinct layouts, so those are
    scored and expanded to their lowest mapping ids; optionally without the upload's own layout, or with
    corpus rows of ids and names only."""
    corpus, queries, (cw, qw, st) = _schema_features(spark, sf, documents)
    groups = (queries.select(F.col("upload_id").alias("id"), F.col("layout_id").alias("grp")),
              corpus.select(F.col("layout_id").alias("id"), F.col("layout_id").alias("grp")).distinct()) \
        if other_layouts else None
    top = RT.topk_sparse(cw, qw, st, k=_m.NEIGHBOURS, groups=groups)
    members = corpus.select(F.col("layout_id").alias("doc_id"), F.col("mapping_id").alias("id"))
    top = RT.expand_copies(top, members, _m.NEIGHBOURS)
    return RT.with_all_queries(top, queries.select(F.col("upload_id").alias("query_id"))), corpus


def _benchmark_terms(spark: SparkSession, sf: str) -> DataFrame:
    return RT.prose_terms(TB.table(spark, sf, "benchmark", "item_id", "text"), "item_id", "text")


@register("similar_documents", ORT.documents_sql())
def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + M2 at volume: exact top-3 documents per benchmark text by TF-IDF cosine, from a stored index
    that the query builds."""
    index = TX.TextIndex(spark, _fresh(spark, "index"))
    index.add(RT.prose_terms(TB.table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text"), 0)
    return _out(index.publish().search(_benchmark_terms(spark, sf), k=_m.NEIGHBOURS))


@register("similar_schemas", ORT.schemas_sql())
def similar_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + M2: for every upload, the 3 most similar approved mappings by column-name trigrams."""
    return _out(_schema_top(spark, sf, documents=False)[0])


@register("schema_neighbours", ORT.schema_neighbours_sql())
def schema_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """M4: the neighbours' mapping_id, customer_id, source_schema and cdm_mapping."""
    top, corpus = _schema_top(spark, sf)
    return RT.neighbour_rows(_out(top), corpus)


@register("neighbour_ids", ORT.neighbour_ids_sql())
def neighbour_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the neighbours used per upload, in rank order, and their count."""
    return RT.neighbour_ids(_schema_top(spark, sf, documents=False)[0])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return TB.table(spark, sf, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@register("similar_vectors", ORT.vectors_sql())
def similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """M2 dense: exact top-3 cosine neighbours of every vector, as products of blocks."""
    v = _vectors(spark, sf)
    return _out(DN.topk_dense(v, v, k=_m.NEIGHBOURS, exclude_self=True))


@register("similar_vectors_lsh")
def similar_vectors_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """M3 dense: approximate top-3 from quantised vectors, the best by code ranked again exactly."""
    v = _vectors(spark, sf)
    return _out(DN.approx_dense(v, v, k=_m.NEIGHBOURS, exclude_self=True))


@register("lsh_recall")
def lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """M3: recall of the approximate top-3 against the exact one, the depth of the rerank, and the share of
    the exact way's bytes that are compared."""
    v = _vectors(spark, sf)
    index = DN.QuantisedIndex(v, v, _m.NEIGHBOURS, exclude_self=True)
    exact = DN.topk_dense(v, v, k=_m.NEIGHBOURS, exclude_self=True)
    return RT.recall(exact, index.search(v)).select(
        "*", F.lit(index.depth).alias("depth"), F.lit(round(index.compared_share(), 4)).alias("bytes_share"))


@register("similar_documents_minhash")
def similar_documents_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """M3 text: approximate top-3 documents per benchmark text by MinHash (Jaccard)."""
    docs = TB.table(spark, sf, "documents", "doc_id", "text")
    qs = TB.table(spark, sf, "benchmark", "item_id", "text")
    return _out(RT.approx_sparse(RT.prose_terms(docs, "doc_id", "text"),
                                 RT.prose_terms(qs, "item_id", "text"), k=_m.NEIGHBOURS))


# --- proposals (M5, M6, M10, M11) -------------------------------------------------------------

from ..operators import propose as PR  # noqa: E402
from .oracle_profile import profile_sql as _profile_sql  # noqa: E402
from .oracle_registry import _norm as _norm_sql  # noqa: E402
from .oracle_retrieve import sround as _sr  # noqa: E402


def _typed_profile(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The stored profile of ``rows`` (of all sales rows by default)."""
    return _mat(P.profile(TD.landed_rows(spark, sf) if rows is None else rows, TD.sales_headers(spark, sf), "typed"))


def _name_sim_sql(a: str, b: str) -> str:
    def grams(x):
        words = f"list_filter(string_split({x}, '_'), lambda w: w <> '')"
        g = ("list_transform(range(1, greatest(len('#' || w || '#') - 2, 1) + 1), "
             "lambda i: substr('#' || w || '#', i, 3))")
        return f"list_distinct(flatten(list_transform({words}, lambda w: {g})))"
    ga, gb = grams(a), grams(b)
    jac = (f"CASE WHEN len(list_distinct(list_concat({ga}, {gb}))) > 0 THEN "
           f"len(list_intersect({ga}, {gb})) / len(list_distinct(list_concat({ga}, {gb}))) "
           f"ELSE 0.0 END")
    lev = f"(1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1))"
    return f"greatest({jac}, {lev})"


def _type_fit_sql(p: str, t: str) -> str:
    parts = []
    for cls, (exact, cast) in PR.TYPE_FIT.items():
        ex = ", ".join(f"'{x}'" for x in exact)
        ca = ", ".join(f"'{x}'" for x in cast)
        parts.append(f"WHEN {p} = '{cls}' AND {t} IN ({ex}) THEN 1.0")
        parts.append(f"WHEN {p} = '{cls}' AND {t} IN ({ca}) THEN 0.5")
    return "CAST(CASE " + " ".join(parts) + " ELSE 0.0 END AS DOUBLE)"


def _scores_sql() -> str:
    ns = _name_sim_sql("norm_name", "cdm_field")
    return f"""
  SELECT upload_id, column_name, ordinal, profile_class, norm_name, field_id, cdm_field, data_type,
         CAST(0.0 AS DOUBLE) AS vote, CAST(NULL AS VARCHAR) AS neighbour_transformation,
         {_sr(ns, 6)} AS name_sim, {_type_fit_sql('profile_class', 'data_type')} AS type_fit,
         {_sr(f"{PR.W_VOTE} * 0.0 + {PR.W_NAME} * {_sr(ns, 6)} + "
              f"{PR.W_TYPE} * {_type_fit_sql('profile_class', 'data_type')}", 6)} AS score
  FROM (SELECT upload_id, column_name, ordinal, cdm_type AS profile_class,
               {_norm_sql('column_name')} AS norm_name
        FROM ({_profile_sql('typed')}) p) p
  CROSS JOIN (SELECT field_id, field_name AS cdm_field, data_type FROM ({ORG.seed_sql()}) c) c
"""


@register("column_field_scores", _scores_sql())
def column_field_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M5 core: name and type score of every (source column x CDM field), no neighbour votes."""
    return PR.score_columns(_typed_profile(spark, sf), _cdm(spark))


def _loo_proposals(spark: SparkSession, sf: str, prof: DataFrame | None = None) -> DataFrame:
    """Propose for every sales upload with neighbours from other layouts only; ``prof``: its profile, if stored."""
    prof = _typed_profile(spark, sf) if prof is None else prof
    top, corpus = _schema_top(spark, sf, other_layouts=True)
    top = _mat(top)
    near = corpus.join(top.select(F.col("doc_id").alias("mapping_id")), "mapping_id", "left_semi")  # all others need no parsing
    votes = PR.neighbour_votes(top, MD.mapping_entries(near, "cdm_mapping", ("mapping_id",)))
    evidence = PR.value_evidence(prof, TD.sales_headers(spark, sf), C.mappings_of_corpus(corpus), other_layouts=True)
    return PR.proposals(prof, _cdm(spark), votes, evidence)


@register("proposed_mappings")
def proposed_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """M5 + M6 + M10: a field, confidence and transformation for every source column, with
    votes from the three nearest approved mappings of other layouts (leave one layout out)."""
    return _loo_proposals(spark, sf)


@register("proposal_accuracy")
def proposal_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Top-1 accuracy of the leave-one-layout-out proposals against the 77 gold pairs."""
    heads = TD.sales_headers(spark, sf)
    gold = heads.join(TD.gold_mappings(spark), "layout_id").select(
        "upload_id", "source_column", "cdm_field")
    return PR.accuracy(_loo_proposals(spark, sf), gold)


def name_proposer(spark: SparkSession) -> PR.Proposer:
    """A second proposer: names only, the likeness of the column's name to the field's."""
    def propose(profile: DataFrame) -> DataFrame:
        fields = F.broadcast(_cdm(spark).select(F.col("field_name").alias("cdm_field")))
        name = RG.normalized_name(F.col("column_name"))
        return profile.crossJoin(fields).select("upload_id", "column_name", "cdm_field",
                                                F.round(PR.name_similarity(name, F.col("cdm_field")), 6).alias("score"))
    return propose


@register("proposer_comparison")
def proposer_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """M5 to M10 with two proposers over the same profiles: right columns of each, per upload."""
    heads = TD.sales_headers(spark, sf)
    gold = heads.join(TD.gold_mappings(spark), "layout_id").select("upload_id", "source_column", "cdm_field")
    prof = _typed_profile(spark, sf)
    by_name = PR.proposals(prof, _cdm(spark), proposer=name_proposer(spark))
    return PR.accuracy(_loo_proposals(spark, sf, prof), gold).withColumn("proposer", F.lit("votes, names, types, values")).unionByName(
        PR.accuracy(by_name, gold).withColumn("proposer", F.lit("names")))


@register("mapping_prompts", f"""
  WITH fields AS (SELECT to_json(list({{'field': field_name, 'type': data_type, 'meaning': description,
                                       'example': example_values}} ORDER BY field_id)) AS j FROM ({ORG.seed_sql()}) c),
  cols AS (SELECT upload_id, to_json(list({{'column': column_name, 'type': cdm_type, 'samples': sample_values}}
                                          ORDER BY ordinal)) AS j FROM ({OP.profile_sql("typed")}) p GROUP BY upload_id),
  few AS (SELECT query_id, to_json(list({{'customer': customer_id, 'columns': json_keys(source_schema),
                                         'answer': cdm_mapping}} ORDER BY rank)) AS j
          FROM ({ORT.schema_neighbours_sql()}) n GROUP BY query_id)
  SELECT cols.upload_id, '{PR.SYSTEM_PROMPT}' AS system_prompt,
         '{{"target_fields":' || fields.j || ',"columns":' || cols.j || ',"rows":' || coalesce(s.sample_data_json, '[]')
         || ',"approved":' || coalesce(few.j, '[]') || '}}' AS user_prompt
  FROM cols CROSS JOIN fields LEFT JOIN ({OP.sample_rows_sql(_m.PROMPT_SAMPLE_ROWS)}) s USING (upload_id)
  LEFT JOIN few ON few.query_id = cols.upload_id""")
def mapping_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt text per upload (CDM lines, columns with samples, rows, similar mappings)."""
    rows = TD.landed_rows(spark, sf)
    prof = _typed_profile(spark, sf, rows)
    samples = P.sample_rows_json(rows, TD.sales_headers(spark, sf), _m.PROMPT_SAMPLE_ROWS, stored=True)
    nb = RT.neighbour_rows(*_schema_top(spark, sf)).withColumnRenamed("query_id", "upload_id")
    return PR.prompts(prof, samples, _cdm(spark), nb)


# --- questions (Q1-Q11; Q6 = cdm_registry, Q9 = cdm_definition_net_revenue, Q12 flagship) -------

from . import ask as AK  # noqa: E402


def _entries_sql(field: str) -> str:
    e = OW.entries_sql(OW.proposals_sql(), "mapping_json", ["mapping_id", "upload_id"])
    return (f"SELECT mapping_id, upload_id, source_column, transformation, confidence, band "
            f"FROM ({e}) e WHERE cdm_field = '{field}'")


@register("revenue_columns", _entries_sql("revenue"))
def revenue_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: which source columns map to revenue (every proposal)."""
    return AK.entries_for_field(WP.proposals(spark, sf), "revenue")


@register("unmapped_columns", ORG.unmapped_sql())
def unmapped_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Q2: source columns a proposal left unmapped, with tenant and profiled type."""
    return WP.unmapped_source_columns(spark, sf)


@register("seen_before", f"""
  WITH u AS (SELECT DISTINCT upload_id, sha256(array_to_string(names, ' ')) AS layout_id
             FROM ({_raw_rows_sql()}) r),
  c AS (SELECT sha256(array_to_string(json_keys(source_schema), ' ')) AS layout_id,
               count(*) AS n FROM ({OW.approved_sql()}) a GROUP BY 1),
  t AS ({ORT.schemas_sql()})
  SELECT u.upload_id, u.layout_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_same_layout,
         t.doc_id AS nearest_mapping_id, t.score AS nearest_score
  FROM u LEFT JOIN c USING (layout_id) LEFT JOIN t ON t.query_id = u.upload_id AND t.rank = 1""")
def seen_before(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: has a similar schema been seen before — exact layout matches and the nearest one."""
    heads = TD.sales_headers(spark, sf)
    top, corpus = _schema_top(spark, sf)
    return AK.seen_before(heads, corpus, top)


@register("date_transformations", _entries_sql("date"))
def date_transformations(spark: SparkSession, sf: str) -> DataFrame:
    """Q4: the transformation proposed for the date column."""
    return AK.entries_for_field(WP.proposals(spark, sf), "date")


@register("latest_proposal_confidence", f"""
  WITH lp AS (SELECT p.* FROM ({OW.proposals_sql()}) p
              QUALIFY row_number() OVER (PARTITION BY upload_id
                                         ORDER BY proposed_at DESC, mapping_id DESC) = 1)
  SELECT e.* FROM ({OW.entries_sql("SELECT * FROM lp", "mapping_json",
                                   ["mapping_id", "upload_id"])}) e""")
def latest_proposal_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: confidence, band and percent per column of each upload's newest proposal."""
    lp = AK.latest_proposal(WP.proposals(spark, sf))
    return MD.mapping_entries(lp, "mapping_json", ("mapping_id", "upload_id"))


@register("recent_customers", f"""
  SELECT customer_id, max(uploaded_at) AS last_upload_at, count(*) AS n_uploads,
         count(*) FILTER (WHERE uploaded_at >= (SELECT max(uploaded_at) FROM ({OW.uploads_sql()}) x)
                                              - INTERVAL 7 DAYS) AS n_recent
  FROM ({OW.uploads_sql()}) u GROUP BY customer_id""")
def recent_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: customers with recent uploads (last 7 days before the newest upload)."""
    return AK.recent_customers(WE.uploads(spark, sf))


@register("approved_mapping_counts", f"""
  SELECT customer_id, count(*) AS n_approved FROM ({OW.approved_sql()}) a GROUP BY customer_id
  UNION ALL SELECT 'ALL', count(*) FROM ({OW.approved_sql()}) a""")
def approved_mapping_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: how many approved mappings, per tenant and in total."""
    return AK.approved_counts(W.approved_corpus(WP.reviews(spark, sf)))


@register("pending_review_uploads", f"""
  SELECT * FROM ({OW.upload_status_sql()}) u WHERE status = 'PENDING_REVIEW'""")
def pending_review_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Q10: uploads whose latest step is a proposal awaiting review."""
    return WP.uploads_with_status(spark, sf).filter(F.col("status") == "PENDING_REVIEW")


@register("chat_context", f"""
  SELECT upload_id,
         concat_ws(chr(10), 'CDM fields: ' || s.cdm_summary,
                   printf('Current upload: %s from %s (%s, %s rows, %s columns)', file_name,
                          customer_id, source_system, CAST(row_count AS VARCHAR),
                          CAST(column_count AS VARCHAR)),
                   CASE WHEN json_valid(schema_json)
                        THEN 'Source columns: ' || array_to_string(json_keys(schema_json), ', ')
                   END) AS context
  FROM ({OW.uploads_sql()}) u
  CROSS JOIN (SELECT string_agg(printf('%s (%s)', field_name, data_type), ', ' ORDER BY field_id)
                  AS cdm_summary FROM ({ORG.seed_sql()}) c) s""")
def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    """Q11: context block per upload (CDM summary, upload line, source columns)."""
    return AK.chat_context(WE.uploads(spark, sf), _cdm(spark))


# --- sources, sinks and streams (S1, S2, S7, S8, S11, C8, T1-T3) ------------------------------

import uuid as _uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import csv_uploads as CU  # noqa: E402
from ..sources import sinks as SK  # noqa: E402
from ..streaming import jobs as ST  # noqa: E402


def _fresh(spark: SparkSession, what: str) -> str:
    """A new folder under the shared checkpoint folder for one run."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{what}-{_uuid.uuid4().hex}"


def _csv_round_trip(spark: SparkSession, sf: str, parsed: bool = False) -> tuple[DataFrame, DataFrame]:
    root = _fresh(spark, "uploads")
    SK.write_csv_uploads(TD.sales_rows(spark, sf), TD.sales_headers(spark, sf), root, TD.parts(spark, sf))
    rows, heads = CU.scan_uploads(spark, root, parsed)[:2]
    # name each upload by its folder (the fixture writer puts one upload per folder)
    key = heads.select("upload_id", F.col("upload_dir").alias("u"))
    rows = rows.join(key, "upload_id").drop("upload_id").withColumnRenamed("u", "upload_id")
    heads = heads.drop("upload_id").withColumnRenamed("upload_dir", "upload_id")
    return rows, heads


@register("csv_upload_summary", OP.upload_summary_sql())
def csv_upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S2 + S3 + P6: every upload written as its own CSV file (own header), read back in one
    headerless scan, then counted per upload."""
    rows, heads = _csv_round_trip(spark, sf)
    return P.upload_summary(rows, heads, _m.ROW_CAP)


@register("csv_upload_profiles", OP.profile_sql("typed"))
def csv_upload_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + P1-P5: the same profile from the CSV files as from the tables."""
    rows, heads = _csv_round_trip(spark, sf, parsed=True)  # once, as all steps of a profile read the cells
    return P.profile(rows, heads, "typed")


@register("reload_sales", OS.sales_sql())
def reload_sales(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + S8 + S11 + C8: load the conformed rows into a tenant-partitioned sales table, then
    approve and load the same uploads again; the second load adds nothing."""
    root = _fresh(spark, "sales")
    checked = SP.checked(spark, sf)
    SK.load_sales(spark, checked, root)
    SK.load_sales(spark, checked, root)
    return SK.read_sales(spark, root)


_STATUS_SCHEMA = "upload_id string, ts timestamp_ntz, event_id bigint, status string"


@register("stream_running_status", f"""
  SELECT upload_id, status, status_at FROM ({OW.upload_status_sql()}) u WHERE status_at IS NOT NULL""")
def stream_running_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status-event stream folded to the latest status per upload (equals W1)."""
    se = WP.Flow(spark, sf).status_events
    src, out, ck = _fresh(spark, "status-src"), _fresh(spark, "status-out"), _fresh(spark, "ck")
    SK.append(se.select("upload_id", "ts", "event_id", "status"), src)
    ST.running_status(spark, src, out, ck, T._parse_datatype_string(_STATUS_SCHEMA))
    return ST.latest_snapshot(spark, out)


@register("stream_corpus_refresh", OW.approved_sql())
def stream_corpus_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Approvals arrive in five files in no order, one a micro-batch, some of them twice; the newest
    approval of each mapping counts, before and after old epochs are folded."""
    a = WP.reviews(spark, sf).filter(F.col("decision") == "APPROVED").select(
        "mapping_id", "upload_id", "customer_id", "source_schema", F.col("final_mapping_json").alias("cdm_mapping"),
        F.col("reviewer").alias("approved_by"), F.col("reviewed_at").alias("approved_at"), "event_id")
    a = _mat(a.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))))
    src, dst, ck = _fresh(spark, "approved"), _fresh(spark, "corpus"), _fresh(spark, "ck")
    for part in (2, 0, 3):
        SK.append(a.filter(F.col("part") == part).drop("part").coalesce(1), src)
    schema = a.drop("part").schema
    ST.refresh_corpus(spark, src, dst, ck, schema, files_a_batch=1)
    ST.corpus_log(spark, dst, schema).compact()
    for part in (1, 0):
        SK.append(a.filter(F.col("part") == part).drop("part").coalesce(1), src)
    ST.refresh_corpus(spark, src, dst, ck, schema, files_a_batch=1)
    return ST.corpus_log(spark, dst, schema).read().drop("event_id")


@register("stream_index_refresh", ORT.documents_sql())
def stream_index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """M2 + T1: documents arrive in three deliveries, some of them twice, and are searched in between; the top-3
    of the refreshed index is that of a rebuilt one."""
    docs = TB.table(spark, sf, "documents", "doc_id", "text")
    src, root, ck = _fresh(spark, "arriving"), _fresh(spark, "index"), _fresh(spark, "ck")
    part, queries = F.pmod(F.xxhash64("doc_id"), F.lit(3)), _benchmark_terms(spark, sf)
    index = TX.TextIndex(spark, root)
    for k in range(3):
        SK.append(docs.filter((part == k) | (F.col("doc_id") % 10 == 0)), src)
        ST.index_documents(spark, src, index, ck, docs.schema)
        if k == 0:
            index.publish().search(queries, k=_m.NEIGHBOURS).count()
    return _out(index.publish().search(queries, k=_m.NEIGHBOURS))


@register("stream_new_uploads", OP.profile_sql("typed"))
def stream_new_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """CSV uploads landing in a folder are profiled as they arrive."""
    root, out, ck = _fresh(spark, "inbox"), _fresh(spark, "profiles"), _fresh(spark, "ck")
    SK.write_csv_uploads(TD.sales_rows(spark, sf), TD.sales_headers(spark, sf), root, TD.parts(spark, sf))
    ST.pick_up_uploads(spark, root, out, ck)
    return spark.read.parquet(out).drop("epoch")


# --- W4: strict state machine (rows only; not in the reference) --------------------------------

from ..operators import statemachine as SM  # noqa: E402


def upload_steps(spark: SparkSession, sf: str) -> DataFrame:
    """(upload_id, ts, event_id, step) of all uploads, proposals and decisions."""
    ev = WE.events(spark, sf)
    up = ev.filter(F.col("event_type") == "signup").select(
        "upload_id", "ts", "event_id", F.lit("upload").alias("step"))
    f = WP.Flow(spark, sf)
    mp = f.proposals.select("upload_id", F.col("proposed_at").alias("ts"), "event_id", F.lit("map").alias("step"))
    rv = f.reviews.select(
        "upload_id", F.col("reviewed_at").alias("ts"), "event_id",
        F.when(F.col("decision") == "APPROVED", "approve").otherwise("reject").alias("step"))
    return up.unionByName(mp).unionByName(rv)


@register("strict_upload_states", OW.strict_states_sql())
def strict_upload_states(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered fold of upload/map/approve/reject steps; illegal steps counted and ignored."""
    return SM.strict_states(upload_steps(spark, sf))
