"""Workflow state as derived tables.

Nothing is updated in place: uploads, proposals and reviews are append-only, and every status is
the latest event per key — ``max_by(status, struct(ts, event_id))``, an order-free aggregate that
combines map-side, so a hot upload costs one partial row per task, not one task.

Tables of documents are joined by a sort-merge hint: equal documents shrink so much in Parquet that Spark,
which goes by the files' bytes, would send a table of gigabytes to the driver as a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.exprs import status_label
from .mapping_doc import final_mapping


def latest_status(events: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """W1/W2 core: (key, status, status_at) — the status of the latest (ts, event_id) per key."""
    order = F.struct("ts", "event_id")
    return events.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.max("ts").alias("status_at"))


def validate_decisions(decisions: DataFrame, mappings: DataFrame, uploads: DataFrame) -> DataFrame:
    """Decisions left-joined to mappings and uploads; ``reject_reason`` in the order
    unknown mapping, unknown upload, bad decision; W7 final document and V5 reviewer default.

    ``decisions``: event_id, mapping_id, upload_id, ts, decision, reviewer, reviewer_notes,
    final_mapping_json.  ``mappings``: mapping_id, mapping_json, customer_id.
    ``uploads``: upload_id, schema_json.
    """
    m = mappings.select("mapping_id", F.col("mapping_json").alias("proposed_mapping_json"),
                        F.col("customer_id").alias("m_customer_id"), F.lit(True).alias("_m"))
    u = uploads.select("upload_id", F.col("schema_json").alias("source_schema"),
                       F.col("customer_id").alias("u_customer_id"), F.lit(True).alias("_u"))
    j = decisions.join(m.hint("merge"), "mapping_id", "left").join(u.hint("merge"), "upload_id", "left")
    reason = (F.when(F.col("_m").isNull(), "unknown mapping")
              .when(F.col("_u").isNull(), "unknown upload")
              .when(~F.coalesce(F.col("decision").isin(*model.DECISIONS), F.lit(False)),
                    "bad decision"))
    return j.select(
        F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("review_id"),
        "event_id", "mapping_id", "upload_id",
        F.coalesce("reviewer", F.lit(model.DEFAULT_REVIEWER)).alias("reviewer"),
        "decision", F.col("ts").alias("reviewed_at"), "reviewer_notes",
        final_mapping(F.col("final_mapping_json"), F.col("proposed_mapping_json"))
        .alias("final_mapping_json"),
        "proposed_mapping_json", "source_schema",
        F.coalesce("u_customer_id", "m_customer_id").alias("customer_id"),
        reason.alias("reject_reason"))


def upload_status_events(signups: DataFrame, proposals: DataFrame,
                         reviews: DataFrame) -> DataFrame:
    """(upload_id, ts, event_id, status): upload -> PENDING_MAPPING, proposal -> PENDING_REVIEW,
    approve -> APPROVED, reject -> PENDING_MAPPING (back to mapping)."""
    s = signups.select("upload_id", "ts", "event_id", F.lit("PENDING_MAPPING").alias("status"))
    p = proposals.select("upload_id", F.col("proposed_at").alias("ts"), "event_id",
                         F.lit("PENDING_REVIEW").alias("status"))
    r = reviews.select("upload_id", F.col("reviewed_at").alias("ts"), "event_id",
                       F.when(F.col("decision") == "APPROVED", "APPROVED")
                       .otherwise("PENDING_MAPPING").alias("status"))
    return s.unionByName(p).unionByName(r)


def upload_status(uploads: DataFrame, status_events: DataFrame) -> DataFrame:
    """W1 + W6: every upload with its current status (default PENDING_MAPPING) and label."""
    st = latest_status(status_events, "upload_id")
    return (uploads.join(st, "upload_id", "left")
            .withColumn("status", F.coalesce("status", F.lit(model.DEFAULT_UPLOAD_STATUS)))
            .withColumn("status_label", status_label(F.col("status"))))


def mapping_status(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every proposal with its status — PENDING, then the latest decision on it."""
    p = proposals.select("mapping_id", F.col("proposed_at").alias("ts"), "event_id",
                         F.lit(model.DEFAULT_MAPPING_STATUS).alias("status"))
    r = reviews.select("mapping_id", F.col("reviewed_at").alias("ts"), "event_id",
                       F.col("decision").alias("status"))
    st = latest_status(p.unionByName(r), "mapping_id").select("mapping_id", "status")
    return proposals.join(st, "mapping_id", "left")


def approved_corpus(reviews: DataFrame) -> DataFrame:
    """Approved mappings with the source schema and final document; the latest approval of
    each mapping is kept (a double approval appends once)."""
    a = reviews.filter(F.col("decision") == "APPROVED")
    row = F.struct("upload_id", "customer_id", F.col("source_schema"),
                   F.col("final_mapping_json").alias("cdm_mapping"),
                   F.col("reviewer").alias("approved_by"),
                   F.col("reviewed_at").alias("approved_at"))
    return (a.groupBy("mapping_id")
            .agg(F.max_by(row, F.struct("reviewed_at", "event_id")).alias("r"))
            .select("mapping_id", "r.*"))


def approved_schemas(reviews: DataFrame) -> DataFrame:
    """(mapping_id, source_schema) of :func:`approved_corpus`, without its documents."""
    return reviews.filter(F.col("decision") == "APPROVED").groupBy("mapping_id").agg(
        F.max_by("source_schema", F.struct("reviewed_at", "event_id")).alias("source_schema"))


# --- joins for the review screens (J1-J5) and the argument branch (F3) --------------------

def pending_queue(mappings: DataFrame, uploads: DataFrame) -> DataFrame:
    """Pending proposals with their upload's file, source system and row count."""
    u = uploads.select("upload_id", "file_name", "source_system", "row_count")
    return mappings.filter(F.col("status") == "PENDING").join(u, "upload_id")


def completed_reviews(reviews: DataFrame, mappings: DataFrame, uploads: DataFrame) -> DataFrame:
    """Reviews with the proposal's document and score and the upload's file and tenant."""
    m = mappings.select("mapping_id", "mapping_json", "confidence_score")
    u = uploads.select("upload_id", "file_name", "customer_id")
    return reviews.join(m.hint("merge"), "mapping_id").join(u.hint("merge"), "upload_id")


def all_mappings(mappings: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every proposal with its upload's file, source system and row count."""
    u = uploads.select("upload_id", "file_name", "source_system", "row_count")
    return mappings.join(u, "upload_id")


def mapping_detail(mappings: DataFrame, uploads: DataFrame) -> DataFrame:
    """Proposal with its upload when there is one (left join)."""
    u = uploads.select(*[F.col(c).alias(f"upload_{c}") if c != "upload_id" else F.col(c)
                         for c in uploads.columns])
    return mappings.join(u, "upload_id", "left")


def entries_with_definitions(entries: DataFrame, cdm: DataFrame) -> DataFrame:
    """Mapping entries beside the CDM definition of their target (left join, registry is
    a few dozen rows so it is broadcast)."""
    c = cdm.select(F.col("field_name").alias("cdm_field"), "display_name", "data_type",
                   "description", "is_required")
    return entries.join(F.broadcast(c), "cdm_field", "left")


def reviews_view(which: str | None, reviews: DataFrame, mappings: DataFrame,
                 uploads: DataFrame) -> DataFrame:
    """'pending' -> J1, 'completed' -> J2, anything else -> J3."""
    if which == "pending":
        return pending_queue(mappings, uploads)
    if which == "completed":
        return completed_reviews(reviews, mappings, uploads)
    return all_mappings(mappings, uploads)


def filter_eq(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """equality filter when an argument is given (pushed down to the scan by Catalyst)."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def newest_first(df: DataFrame, ts: str, key: str) -> DataFrame:
    """O1: newest first, key as tie-break."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(key))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """O3: the first ``k`` rows per group (partial group limit before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
