"""Workflow tables assembled from the event log (uploads, proposals, reviews, corpus)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..operators import asof
from ..operators import checks as CK
from ..operators import mapping_doc as MD
from ..operators import workflow as W
from ..sources import workflow_events as WE


def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """M12 over every reply."""
    return MD.parse_replies(WE.replies(spark, sf))


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """schema_mappings rows for the replies that parsed (a bad reply stores nothing)."""
    info = F.broadcast(WE.layouts_info(spark).select("layout", "customer_id"))
    # a filter would be pushed below the parsing, which then ran once more in it
    parsed = parsed_replies(spark, sf)
    row = F.struct("event_id", "upload_id", "layout", "ts", "mapping_json", "doc")
    good = parsed.select(F.inline(F.when(F.col("parse_ok"), F.array(row)))).join(info, "layout")
    return good.select(
        F.concat(F.lit("M"), F.col("event_id").cast("string")).alias("mapping_id"),
        "event_id", "upload_id", "customer_id", F.col("ts").alias("proposed_at"),
        "mapping_json",
        F.coalesce(F.col("doc.overall_confidence"), F.lit(0.0)).alias("confidence_score"),
        F.coalesce(F.col("doc.notes"), F.lit("")).alias("llm_reasoning"),
        F.lit("[]").alias("similar_mapping_ids"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision requests with the mapping they refer to: the upload's latest proposal before."""
    ev = WE.events(spark, sf)
    clicks = ev.filter(F.col("event_type") == "click").select(
        "upload_id", "ts", "event_id", F.col("event_id").alias("click_id"),
        F.lit(False).alias("_is_decision"))
    d = WE.decisions(spark, sf)
    dd = d.select("upload_id", "ts", "event_id", F.lit(None).cast("bigint").alias("click_id"),
                  F.lit(True).alias("_is_decision"))
    found = (asof.last_before(clicks.unionByName(dd), "upload_id", ["ts", "event_id"],
                              "click_id", "prev_click")
             .filter("_is_decision").select("event_id", "prev_click"))
    return (d.join(found, "event_id")
            .withColumn("mapping_id", F.when(F.col("prev_click").isNotNull(), F.concat(
                F.lit("M"), F.col("prev_click").cast("string"))))
            .drop("prev_click"))


REVIEW_COLUMNS = ["review_id", "event_id", "mapping_id", "upload_id", "reviewer", "decision",
                  "reviewed_at", "reviewer_notes", "final_mapping_json"]


class Flow:
    """The workflow tables of one query. What several branches read (uploads, parsed proposals,
    decisions, reviews) is stored once as Parquet, so each branch is one pruned scan."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def uploads(self) -> DataFrame:
        """V5 on write: the declared default fills an absent source system."""
        return materialize(CK.with_defaults(WE.uploads(self.spark, self.sf), {
            "source_system": CK.UPLOAD_DEFAULTS["source_system"]}))

    @cached_property
    def proposals(self) -> DataFrame:
        return materialize(proposals(self.spark, self.sf))

    @cached_property
    def decisions(self) -> DataFrame:
        return materialize(decisions(self.spark, self.sf))

    @cached_property
    def validated(self) -> DataFrame:
        """W3 over all decisions."""
        return W.validate_decisions(self.decisions, self.proposals, self.uploads)

    @cached_property
    def reviews(self) -> DataFrame:
        """mapping_reviews: the decisions that passed W3."""
        return materialize(self.validated.filter(F.col("reject_reason").isNull()))

    @property
    def review_table(self) -> DataFrame:
        """mapping_reviews in its stored columns."""
        return self.reviews.select(*REVIEW_COLUMNS)

    @property
    def status_events(self) -> DataFrame:
        ev = WE.events(self.spark, self.sf)
        return W.upload_status_events(ev.filter(F.col("event_type") == "signup"), self.proposals, self.reviews)

    @property
    def uploads_with_status(self) -> DataFrame:
        """W1 + W6 over the uploads table."""
        return W.upload_status(self.uploads, self.status_events)

    @property
    def mappings_with_status(self) -> DataFrame:
        """W2 over all proposals."""
        return W.mapping_status(self.proposals, self.reviews)

    @cached_property
    def corpus(self) -> DataFrame:
        """Approved mappings, stored."""
        return materialize(W.approved_corpus(self.reviews))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return Flow(spark, sf).reviews


def uploads_with_status(spark: SparkSession, sf: str) -> DataFrame:
    return Flow(spark, sf).uploads_with_status


def mappings_with_status(spark: SparkSession, sf: str) -> DataFrame:
    return Flow(spark, sf).mappings_with_status


def unmapped_source_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of proposals left unmapped, with tenant and the column's profile type."""
    from ..operators import profile as P
    props = proposals(spark, sf)
    ent = (MD.mapping_entries(props, "mapping_json", ("mapping_id", "upload_id", "customer_id"))
           .filter(F.col("source_column").isNotNull() & F.col("cdm_field").isNull()))
    prof = P.parse_profile_json(WE.uploads(spark, sf)).select(
        "upload_id", F.col("column_name").alias("source_column"),
        F.col("cdm_type").alias("profile_type"))
    return ent.join(prof, ["upload_id", "source_column"], "left").select(
        "mapping_id", "upload_id", "customer_id", "source_column", "profile_type")
