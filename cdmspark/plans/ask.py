"""Questions a user asks about uploads, mappings and the CDM, answered as queries (Q1-Q12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapping_doc as MD
from ..operators import registry as RG


def entries_for_field(proposals: DataFrame, field: str) -> DataFrame:
    """Q1 / Q4: which source columns map to ``field`` and with what transformation."""
    e = MD.mapping_entries(proposals, "mapping_json", ("mapping_id", "upload_id"))
    return e.filter(F.col("cdm_field") == F.lit(field)).select(
        "mapping_id", "upload_id", "source_column", "transformation", "confidence", "band")


def latest_proposal(proposals: DataFrame) -> DataFrame:
    """The newest proposal of each upload (order-free aggregate)."""
    return (proposals.groupBy("upload_id")
            .agg(F.max_by(F.struct(*proposals.columns), F.struct("proposed_at", "mapping_id"))
                 .alias("p"))
            .select("p.*"))


def seen_before(uploads: DataFrame, corpus: DataFrame, top: DataFrame) -> DataFrame:
    """Q3: per upload, approved mappings with exactly the same layout, and the nearest one."""
    same = (uploads.select("upload_id", "layout_id")
            .join(corpus.groupBy("layout_id").agg(F.count(F.lit(1)).alias("n_same_layout")),
                  "layout_id", "left"))
    best = top.filter(F.col("rank") == 1).select(
        F.col("query_id").alias("upload_id"), F.col("doc_id").alias("nearest_mapping_id"),
        F.round("score", 6).alias("nearest_score"))
    return (same.join(best, "upload_id", "left")
            .select("upload_id", "layout_id",
                    F.coalesce("n_same_layout", F.lit(0)).cast("bigint").alias("n_same_layout"),
                    "nearest_mapping_id", "nearest_score"))


def recent_customers(uploads: DataFrame, days: int = 7) -> DataFrame:
    """Q7: per tenant the last upload time, uploads in total, and uploads in the last ``days``
    days before the newest upload in the data."""
    newest = uploads.agg(F.max("uploaded_at").alias("_max"))
    j = uploads.crossJoin(F.broadcast(newest))
    return j.groupBy("customer_id").agg(
        F.max("uploaded_at").alias("last_upload_at"),
        F.count(F.lit(1)).alias("n_uploads"),
        F.count_if(F.col("uploaded_at") >= F.col("_max") - F.expr(f"INTERVAL {days} DAYS"))
        .alias("n_recent"))


def approved_counts(corpus: DataFrame) -> DataFrame:
    """Q8: approved mappings per tenant and in total ('ALL')."""
    per = corpus.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_approved"))
    tot = corpus.agg(F.count(F.lit(1)).alias("n_approved")).select(
        F.lit("ALL").alias("customer_id"), "n_approved")
    return per.unionByName(tot)


def chat_context(uploads: DataFrame, cdm: DataFrame) -> DataFrame:
    """Q11: the context block per upload — CDM summary, the upload line, its source columns
    (the columns line is skipped when the stored profile is not readable JSON)."""
    summ = RG.summary_line(cdm).select("cdm_summary")
    keys = F.json_object_keys("schema_json")
    line = F.format_string("Current upload: %s from %s (%s, %s rows, %s columns)",
                           "file_name", "customer_id", "source_system",
                           F.col("row_count").cast("string"), F.col("column_count").cast("string"))
    cols = F.when(keys.isNotNull(), F.concat(F.lit("Source columns: "), F.array_join(keys, ", ")))
    return uploads.crossJoin(F.broadcast(summ)).select(
        "upload_id",
        F.concat_ws("\n", F.concat(F.lit("CDM fields: "), F.col("cdm_summary")), line, cols)
        .alias("context"))


def with_layout_id(df: DataFrame, names: str = "names") -> DataFrame:
    return df.withColumn("layout_id", F.sha2(F.array_join(names, " "), 256))
