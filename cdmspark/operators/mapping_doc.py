"""Mapping documents: parse model replies, read entries, bands, unmapped fields (M7, M8,
M12-M14, A3, W7, W8).

Documents stay text in the tables (as stored) and are parsed with ``from_json`` against the fixed
document schema where read; nothing is evaluated from their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.exprs import confidence_band, confidence_percent, truncate

_WS = r"^\s+|\s+$"


def strip_fence(text: Column) -> Column:
    """Drop a surrounding code fence and an optional ``json`` tag, trim whitespace."""
    raw = F.regexp_replace(text, _WS, "")
    inner = F.element_at(F.split(raw, "```", -1), 2)
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return F.regexp_replace(F.when(raw.startswith("```"), inner).otherwise(raw), _WS, "")


def is_json_object(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull() & text.startswith("{")


def parse_replies(replies: DataFrame, text_col: str = "reply_text") -> DataFrame:
    """Adds ``mapping_json`` (clean text), ``doc`` (parsed), ``parse_ok`` and, for bad
    replies, ``parse_error`` with a 500-character excerpt of the reply."""
    clean = F.col("mapping_json")
    ok = F.coalesce(is_json_object(clean), F.lit(False))
    # one step a column, so that a text is stripped once and parsed once for its flag
    return replies.withColumn("mapping_json", strip_fence(F.col(text_col))).withColumn("parse_ok", ok).withColumn(
        "mapping_json", F.when(F.col("parse_ok"), clean)).withColumns({
        "doc": F.from_json(F.col("mapping_json"), model.MAPPING_DOC_DDL),
        "parse_error": F.when(~F.col("parse_ok"), F.concat(F.lit("invalid JSON; raw: "),
                                            truncate(F.col(text_col), 500))),
    })


def parse_doc(text: Column) -> Column:
    """A stored mapping document -> struct (NULL when unreadable)."""
    return F.from_json(text, model.MAPPING_DOC_DDL)


def mapping_entries(mappings: DataFrame, json_col: str = "mapping_json",
                    keys: tuple[str, ...] = ("mapping_id",)) -> DataFrame:
    """One row per entry of each document (documents without entries keep one row with
    NULLs), with the band and percent of its confidence (M13)."""
    d = mappings.select(*keys, parse_doc(F.col(json_col)).alias("doc"))
    e = d.select(*keys, F.posexplode_outer("doc.mappings").alias("pos", "m"))
    return e.select(
        *keys, (F.col("pos") + 1).cast("int").alias("entry_no"),
        F.col("m.source_column").alias("source_column"),
        F.col("m.cdm_field").alias("cdm_field"),
        F.col("m.transformation").alias("transformation"),
        F.col("m.confidence").alias("confidence"),
        F.col("m.reasoning").alias("reasoning"),
        confidence_band(F.col("m.confidence")).alias("band"),
        confidence_percent(F.col("m.confidence")).alias("percent"))


def doc_summary(mappings: DataFrame, json_col: str = "mapping_json",
                keys: tuple[str, ...] = ("mapping_id",)) -> DataFrame:
    """M7 + A3: stated overall confidence (default 0.0), the mean over mapped entries, number of
    entries (unreadable -> 0), mapped and unmapped-field counts, band of the overall score."""
    d = mappings.select(*keys, parse_doc(F.col(json_col)).alias("doc"))
    mapped = F.filter("doc.mappings", lambda m: m["cdm_field"].isNotNull())
    mean = F.aggregate(F.transform(mapped, lambda m: m["confidence"].cast("double")),
                       F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    overall = F.coalesce(F.col("doc.overall_confidence"), F.lit(0.0))
    return d.select(
        *keys,
        overall.alias("overall_confidence"),
        F.when(F.size(mapped) > 0, F.round(mean / F.size(mapped), 6)).otherwise(F.lit(0.0))
        .alias("mean_confidence"),
        F.coalesce(F.size("doc.mappings"), F.lit(0)).alias("n_entries").cast("int"),
        F.coalesce(F.size(mapped), F.lit(0)).cast("int").alias("n_mapped"),
        F.coalesce(F.size("doc.unmapped_cdm_fields"), F.lit(0)).cast("int").alias("n_unmapped"),
        confidence_band(overall).alias("band"),
        confidence_percent(overall).alias("percent"))


def unmapped_fields(mappings: DataFrame, cdm: DataFrame, json_col: str = "mapping_json",
                    key: str = "mapping_id") -> DataFrame:
    """M8: per document, the CDM fields no entry targets (sorted), computed from the entries:
    (document x CDM fields) anti-joined with the proposed fields."""
    ent = (mapping_entries(mappings, json_col, (key,))
           .filter(F.col("cdm_field").isNotNull())
           .select(key, F.col("cdm_field").alias("field_name")).distinct())
    grid = mappings.select(key).distinct().crossJoin(
        F.broadcast(cdm.select("field_name")))  # CDM registry: tens of rows
    miss = grid.join(ent, [key, "field_name"], "left_anti")
    return (mappings.select(key).distinct()
            .join(miss.groupBy(key).agg(F.array_sort(F.collect_list("field_name"))
                                        .alias("unmapped_cdm_fields")), key, "left")
            .select(key, F.coalesce("unmapped_cdm_fields", F.array().cast("array<string>"))
                    .alias("unmapped_cdm_fields"),
                    F.coalesce(F.size("unmapped_cdm_fields"), F.lit(0)).cast("int")
                    .alias("n_unmapped")))


def final_mapping(final: Column, original: Column) -> Column:
    """The reviewer's edited document wins; '' counts as absent."""
    return F.coalesce(F.nullif(final, F.lit("")), original)


def edit_history(reviews: DataFrame) -> DataFrame:
    """Per review whose final document differs from the proposal, the entries whose target
    field or transformation changed (full outer join of both entry lists on source column)."""
    keys = ("review_id", "mapping_id")
    before = (mapping_entries(reviews, "proposed_mapping_json", keys)
              .select(*keys, "source_column", F.col("cdm_field").alias("field_before"),
                      F.col("transformation").alias("transformation_before")))
    after = (mapping_entries(reviews, "final_mapping_json", keys)
             .select(*keys, "source_column", F.col("cdm_field").alias("field_after"),
                     F.col("transformation").alias("transformation_after")))
    j = before.join(after, [*keys, "source_column"], "full_outer")
    changed = (~F.col("field_before").eqNullSafe(F.col("field_after"))
               | ~F.col("transformation_before").eqNullSafe(F.col("transformation_after")))
    return j.filter(F.col("source_column").isNotNull() & changed)
