"""The driver's ``events`` table in the role of the workflow log.

``user_id`` is an upload; ``event_type`` is the step: signup = the file was uploaded, click = a
mapping was proposed (the model's reply text is built from the upload's layout), purchase =
approve, error = reject, view = no change. Order is (ts, event_id). ``value / max(value)`` is the
overall confidence a reply states, and ``props.k`` picks the reply's shape and whether the
reviewer edited the mapping:

* reply: k % 10 = 0 fenced with a ``json`` tag, 1 fenced without tag, 2 cut short (bad JSON),
  3 without ``overall_confidence`` and with the last column left unmapped, else plain;
* decision: k % 4 = 0 carries an edited final mapping (last column unmapped), else ``''``.

Everything here is derived row by row from ``events``; the only fixed inputs are the six layouts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.local import values_frame
from .tables import table

N_LAYOUTS = len(model.LAYOUTS)
REPLY_VARIANTS = 5
TRANSFORM_FOR_TYPE = {"date": "CAST(x AS DATE)"}


def _entry(src: str, fld: str | None, ptype: str) -> dict:
    words = fld.split("_") if fld else []
    by_name = any(w in src.lower() for w in words)
    return {
        "source_column": src,
        "cdm_field": fld,
        "transformation": TRANSFORM_FOR_TYPE.get(ptype) if fld else None,
        "confidence": 0.95 if by_name else 0.8,
        "reasoning": "column name matches the field" if by_name else "values match the field",
    }


def _doc_parts(layout: int, drop_last: bool, with_conf: bool) -> tuple[str, str]:
    cols = model.LAYOUTS[layout][2]
    entries = [_entry(s, None if (drop_last and i == len(cols) - 1) else f, t)
               for i, (s, f, t) in enumerate(cols)]
    mapped = {e["cdm_field"] for e in entries if e["cdm_field"]}
    unmapped = [n for n in model.CDM_NAMES if n not in mapped]
    head = '{"mappings": ' + json.dumps(entries)
    tail = ', "unmapped_cdm_fields": ' + json.dumps(unmapped) + ', "notes": "layout ' \
        + str(layout) + '"}'
    if with_conf:
        return head + ', "overall_confidence": ', tail
    return head + tail, ""


def reply_templates() -> list[tuple]:
    """(layout, variant, prefix, suffix, has_conf) — the reply is prefix [+ conf] + suffix."""
    out = []
    for lay in range(N_LAYOUTS):
        p, s = _doc_parts(lay, False, True)
        out.append((lay, 0, "```json\n" + p, s + "\n```", True))
        out.append((lay, 1, "```\n" + p, s + "\n```", True))
        out.append((lay, 2, p[:60], "", False))
        nc, _ = _doc_parts(lay, True, False)
        out.append((lay, 3, nc, "", False))
        out.append((lay, 4, p, s, True))
    return out


def edited_docs() -> list[tuple]:
    """(layout, final_mapping_json) — the reviewer's edit: last column unmapped."""
    out = []
    for lay in range(N_LAYOUTS):
        p, s = _doc_parts(lay, True, True)
        out.append((lay, p + "0.90" + s))
    return out


def schema_docs() -> list[tuple]:
    """(layout, schema_json) — the stored profile document, form 2 {col: {type, cdm_field}}."""
    return [(lay, json.dumps({s: {"type": t, "cdm_field": f} for s, f, t in cols}))
            for lay, (_, _, cols) in enumerate(model.LAYOUTS)]


def confidence_text(v: Column, vmax: Column) -> Column:
    """value / max(value) rounded half up to two places, as 'd.dd' text."""
    n = F.floor(v / vmax * F.lit(100) + F.lit(0.5)).cast("bigint")
    return F.concat((n / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((n % 100).cast("string"), 2, "0"))


def layouts_info(spark: SparkSession) -> DataFrame:
    rows = [(i, t, s, sd, len(cols))
            for (i, sd), (t, s, cols) in zip(schema_docs(), model.LAYOUTS)]
    return values_frame(spark, rows, "layout int, customer_id string, source_system string, "
                                     "schema_json string, column_count int")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the upload, layout and rule key attached."""
    ev = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.select(
        "event_id", "ts", "event_type", "value",
        F.concat(F.lit("WU"), F.col("user_id").cast("string")).alias("upload_id"),
        (F.col("user_id") % N_LAYOUTS).cast("int").alias("layout"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """The uploads table without its status (status is derived from events, W1)."""
    ev = events(spark, sf)
    per = ev.groupBy("upload_id", "layout").agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("uploaded_at"),
        F.count(F.lit(1)).alias("row_count"))
    info = F.broadcast(layouts_info(spark))
    return (per.join(info, "layout")
            .select("upload_id", "customer_id",
                    F.concat(F.lower("customer_id"), F.lit("_"), F.lower("source_system"),
                             F.lit("_upload_"), F.substring("upload_id", 3, 20), F.lit(".csv"))
                    .alias("file_name"),
                    "source_system", "uploaded_at", F.col("row_count").cast("bigint"),
                    "column_count", "schema_json", F.lit("[]").alias("sample_data_json"),
                    F.lit(None).cast("string").alias("error_message"), "layout"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """One model reply per click: (event_id, upload_id, layout, ts, reply_text)."""
    ev = events(spark, sf)
    vmax = ev.agg(F.max("value").alias("vmax"))
    tpl = values_frame(spark, reply_templates(),
                       "layout int, variant int, prefix string, suffix string, has_conf boolean")
    clicks = (ev.filter(F.col("event_type") == "click")
              .withColumn("variant", F.when(F.col("k") % 10 < 4, F.col("k") % 10)
                          .otherwise(F.lit(4)).cast("int")))
    j = clicks.crossJoin(F.broadcast(vmax)).join(F.broadcast(tpl), ["layout", "variant"])
    text = F.concat(F.col("prefix"),
                    F.when(F.col("has_conf"), confidence_text(F.col("value"), F.col("vmax")))
                    .otherwise(F.lit("")),
                    F.col("suffix"))
    return j.select("event_id", "upload_id", "layout", "ts", text.alias("reply_text"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision requests: (event_id, upload_id, layout, ts, decision, reviewer, notes,
    final_mapping_json, k) — purchase approves, error rejects."""
    ev = events(spark, sf)
    ed = values_frame(spark, edited_docs(), "layout int, edited string")
    d = ev.filter(F.col("event_type").isin("purchase", "error"))
    return (d.join(F.broadcast(ed), "layout")
            .select("event_id", "upload_id", "layout", "ts",
                    F.when(F.col("event_type") == "purchase", "APPROVED").otherwise("REJECTED")
                    .alias("decision"),
                    F.lit(None).cast("string").alias("reviewer"),
                    F.lit("").alias("reviewer_notes"),
                    F.when(F.col("k") % 4 == 0, F.col("edited")).otherwise(F.lit(""))
                    .alias("final_mapping_json")))
