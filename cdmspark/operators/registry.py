"""The CDM registry: seed, add fields in batches, list, look up, summarise.

The registry is a small table (tens to hundreds of rows), so it is broadcast where it is joined.
Additions are a batch: names already present are refused (returned with a reason, not raised),
duplicates inside the batch keep their first row, and new ids continue the numeric maximum.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.local import values_frame

PROPOSAL_COLUMNS = ["field_name", "display_name", "data_type", "description", "example_values",
                    "is_required", "source_customer"]


def cdm_seed(spark: SparkSession, as_of: _dt.datetime) -> DataFrame:
    """The seeded registry (S10 content), ``added_at`` fixed for repeatable runs."""
    rows = [(fid, name, disp, dtype, desc, req, ex, model.CDM_SEED_ADDED_BY, as_of,
             model.CDM_SEED_ADDED_BY)
            for fid, name, disp, dtype, desc, req, ex in model.CDM_FIELDS]
    return values_frame(spark, rows, model.CDM_SCHEMA)


def field_number(field_id) -> F.Column:
    """Numeric part of an id like 'f017' (NULL when it has none)."""
    return F.regexp_extract(field_id, r"([0-9]+)", 1).try_cast("int")


def next_field_number(cdm: DataFrame) -> DataFrame:
    """A2: one row with the next free number (numeric max + 1; 1 on an empty registry)."""
    return cdm.agg((F.coalesce(F.max(field_number(F.col("field_id"))), F.lit(0)) + 1)
                   .alias("next_no"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; of rows with one key the smallest in the
    order of their other columns."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*new.columns)
    return one.join(existing.select(key), key, "left_anti")


def field_list(cdm: DataFrame) -> list[tuple]:
    """The registry in field-id order as the tuples that plans and sinks take (id, name, display name, type,
    description, required, examples): a few words a field reach the driver."""
    names = ["field_id", "field_name", "display_name", "data_type", "description", "is_required", "example_values"]
    rows = cdm.select(*names).collect()
    number = lambda r: (int("".join(ch for ch in r["field_id"] or "" if ch.isdigit()) or 0), r["field_name"])
    return [(*r[:5], bool(r["is_required"]), r[6]) for r in sorted(rows, key=number)]


def extended_mappings(mappings: DataFrame, headers: DataFrame, fields: list[tuple]) -> DataFrame:
    """``mappings`` (layout_id, source_column, cdm_field, transformation) and, for every field the registry has
    beyond the seed, the source column of a layout whose normalised name it is."""
    added = [f[1] for f in fields if f[1] not in model.CDM_NAMES]
    columns = headers.select("layout_id", "names").distinct().select("layout_id", F.explode("names").alias("source_column"))
    named = columns.withColumn("cdm_field", normalized_name(F.col("source_column"))).filter(F.col("cdm_field").isin(*added))
    first = named.groupBy("layout_id", "cdm_field").agg(F.min("source_column").alias("source_column"))
    return mappings.unionByName(first.withColumn("transformation", F.lit(None).cast("string")).select(*mappings.columns))


def add_fields(cdm: DataFrame, proposals: DataFrame, added_by: str,
               as_of: _dt.datetime) -> DataFrame:
    """(field rows with ids for accepted names) + (refused names with a reason).

    Output columns: the CDM schema plus ``outcome`` ('added' or 'refused: exists') and
    ``reason``. Ids continue from A2 in field-name order.
    """
    first = Window.partitionBy("field_name").orderBy(F.col("source_customer"))
    batch = (proposals.select(*PROPOSAL_COLUMNS)
             .withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k"))
    names = F.broadcast(cdm.select("field_name", F.lit(True).alias("_exists")))
    j = batch.join(names, "field_name", "left")
    new = j.filter(F.col("_exists").isNull()).drop("_exists")
    refused = j.filter(F.col("_exists")).drop("_exists")
    # dense numbering of a registry-sized batch (one row per new field name)
    order = Window.orderBy("field_name")
    numbered = (new.crossJoin(F.broadcast(next_field_number(cdm)))
                .withColumn("field_id", F.format_string(
                    "f%03d", F.col("next_no") + F.row_number().over(order) - 1)))
    ts = F.lit(as_of).cast("timestamp")
    cols = [F.col("field_id"), "field_name", "display_name", "data_type", "description",
            "is_required", "example_values", F.lit(added_by).alias("added_by"),
            ts.alias("added_at"), "source_customer"]
    added = numbered.select(*cols, F.lit("added").alias("outcome"))
    ref = refused.select(F.lit(None).cast("string").alias("field_id"), *cols[1:],
                         F.lit("refused: exists").alias("outcome"))
    return added.unionByName(ref)


def registry_after(cdm: DataFrame, added: DataFrame) -> DataFrame:
    """The registry with the accepted additions appended (S9 on field_name)."""
    acc = added.filter(F.col("outcome") == "added").select(*cdm.columns)
    return cdm.unionByName(insert_if_absent(cdm, acc, "field_name"))


def list_fields(cdm: DataFrame) -> DataFrame:
    """D1 + O2: all definitions by field id, with the total beside each row."""
    total = cdm.agg(F.count(F.lit(1)).alias("total"))
    return cdm.crossJoin(F.broadcast(total)).orderBy("field_id")


def summary_line(cdm: DataFrame) -> DataFrame:
    """D3: 'name (TYPE), name (TYPE), ...' in field-id order, one row."""
    item = F.struct("field_id", F.format_string("%s (%s)", "field_name", "data_type").alias("t"))
    return cdm.agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)),
                                            lambda x: x["t"]), ", ").alias("cdm_summary"),
                   F.count(F.lit(1)).alias("n_fields"))


def lookup(cdm: DataFrame, field_name: str) -> DataFrame:
    """One definition by name (empty frame when absent)."""
    return cdm.filter(F.col("field_name") == F.lit(field_name))


def normalized_name(c) -> F.Column:
    """Column name folded for grouping: camelCase split, non-alphanumerics to '_', lower."""
    s = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(s, r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(s, r"^_+|_+$", ""))


def extension_candidates(unmapped: DataFrame, min_customers: int = 1) -> DataFrame:
    """M9: unmapped source columns grouped by normalised name; a name seen at ``min_customers``
    or more tenants is a candidate new CDM field.

    ``unmapped``: customer_id, source_column, profile_type (integer/decimal/date/string).
    """
    t = F.upper(F.coalesce(F.col("profile_type"), F.lit("string")))
    return (unmapped.withColumn("field_name", normalized_name(F.col("source_column")))
            .groupBy("field_name")
            .agg(F.count_distinct("customer_id").alias("n_customers"),
                 F.count(F.lit(1)).alias("n_columns"),
                 F.min("source_column").alias("example_source_column"),
                 F.max(F.when(t.isin("INTEGER", "DECIMAL", "DATE"), t)).alias("_t"),
                 F.min("customer_id").alias("source_customer"))
            .filter(F.col("n_customers") >= min_customers)
            .select("field_name", "n_customers", "n_columns", "example_source_column",
                    F.coalesce("_t", F.lit("STRING")).alias("data_type"), "source_customer"))


def candidates_as_proposals(cands: DataFrame) -> DataFrame:
    """M9 -> D2 input: display name from the field name, description from its origin."""
    return cands.select(
        "field_name",
        F.initcap(F.regexp_replace("field_name", "_", " ")).alias("display_name"),
        "data_type",
        F.concat(F.lit("Proposed from source column "), F.col("example_source_column"))
        .alias("description"),
        F.col("example_source_column").alias("example_values"),
        F.lit(False).alias("is_required"),
        "source_customer")
