"""Profile every column of every upload in one job.

Input is the raw-upload pair (rows: upload_id, row_ord, vals; headers: upload_id, names, ...).
Values go long once (P1) and are aggregated per (upload, column position): class flags, null and
distinct counts are partial aggregates (map-side combine), and the first three non-null samples
use ``row_number() <= 3``, which Spark plans as a partial window-group limit before the shuffle,
so a huge upload never sends more than three rows per column per task to one reducer. Column names
attach after aggregation, on one row per column.

Two modes for the column class (P2):

* ``typed`` (default): integer (nulls allowed), decimal, ISO date, else string.
* ``compat``: reads like pandas' CSV reader — an integer column with a null becomes decimal, an
  all-null column is decimal, dates stay text (string), booleans are string.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.exprs import is_null_token, layout_id_of, layout_text
from ..functions.materialize import materialize, materialize_all

INT_RX = r"^[-+]?[0-9]+$"
NUM_RX = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
DATE_RX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ALL = ("all_int", "all_num", "all_date", "all_bool")


def long_values(rows: DataFrame) -> DataFrame:
    """Wide -> long, (upload_id, row_ord, ordinal, value) with 1-based ordinals."""
    return (rows.select("upload_id", "row_ord", F.posexplode("vals").alias("pos", "value"))
            .select("upload_id", "row_ord", (F.col("pos") + 1).alias("ordinal"), "value"))


def cap_rows(rows: DataFrame, cap: int) -> DataFrame:
    """S3: the first ``cap`` rows of each upload by row order (partial group limit before shuffle)."""
    w = Window.partitionBy("upload_id").orderBy("row_ord")
    return rows.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= cap)


def _flags(v: Column) -> dict[str, Column]:
    t = F.trim(v)
    return {
        "is_null": is_null_token(v),
        "is_int": t.rlike(INT_RX),
        "is_num": t.rlike(NUM_RX),
        "is_date": t.rlike(DATE_RX) & t.try_cast("date").isNotNull(),
        "is_bool": F.lower(t).isin("true", "false"),
    }


def float_text(d: Column) -> Column:
    """A double in plain digits with a decimal point, as pandas prints it below 1e16."""
    plain = F.regexp_replace(d.try_cast("decimal(38,10)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    usual = (d == 0) | ((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7))
    return F.when(usual | (F.abs(d) >= 1e16) | (F.abs(d) < 1e-4), d.cast("string")).otherwise(plain)


def _class(mode: str) -> tuple[Column, Column]:
    """(cdm_type, dtype) from the per-column aggregates."""
    nn = F.col("n_nonnull")
    nulls = F.col("null_count")
    if mode == "compat":
        cdm = (F.when(nn == 0, "decimal")
               .when(F.col("all_int") & (nulls == 0), "integer")
               .when(F.col("all_num"), "decimal")
               .otherwise("string"))
        dtype = (F.when(nn == 0, "float64")
                 .when(F.col("all_int") & (nulls == 0), "int64")
                 .when(F.col("all_num"), "float64")
                 .when(F.col("all_bool") & (nulls == 0), "bool")
                 .otherwise("object"))
        return cdm, dtype
    cdm = (F.when(nn == 0, "string")
           .when(F.col("all_int"), "integer")
           .when(F.col("all_num"), "decimal")
           .when(F.col("all_date"), "date")
           .otherwise("string"))
    dtype = (F.when(nn == 0, "object")
             .when(F.col("all_int"), F.when(nulls == 0, "int64").otherwise("Int64"))
             .when(F.col("all_num"), "float64")
             .when(F.col("all_date"), "date")
             .when(F.col("all_bool"), "boolean")
             .otherwise("object"))
    return cdm, dtype


#: One row of so many is looked at to find out how far the first rows of an upload can reach.
BOUND_SHARE = 32


def first_rows(rows: DataFrame, cap: int) -> DataFrame:
    """``cap_rows`` of stored rows, without a sort of all of them: the ``cap``-th of a part of an upload's rows
    comes no earlier than the ``cap``-th of all, so rows after it are left out before the ranking. Uploads
    whose part has fewer rows are ranked whole."""
    part = rows.select("upload_id", "row_ord").filter(F.pmod(F.xxhash64("row_ord"), F.lit(BOUND_SHARE)) == 0)
    bound = materialize(cap_rows(part, cap).filter(F.col("row_no") == cap).select("upload_id", F.col("row_ord").alias("bound")))
    near = rows.join(bound, "upload_id", "left").filter(F.col("bound").isNull() | (F.col("row_ord") <= F.col("bound")))
    return cap_rows(near.drop("bound"), cap)


def _top_values(lv: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("upload_id", "ordinal").orderBy("row_ord")
    return (lv.withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= k)
            .groupBy("upload_id", "ordinal")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "row_ord", "value"))),
                             lambda x: F.struct(x["row_ord"].alias("row_ord"), x["value"].alias("value"))).alias("samples")))


def first_samples(rows: DataFrame, agg: DataFrame, k: int = model.SAMPLE_VALUES,
                  probe: int = model.ROW_CAP) -> DataFrame:
    """P5: the first ``k`` non-null values of every column in row order, exactly, with their rows' place.

    Sorting every value of a long table is the costly way. Instead the first ``probe`` rows of
    each upload (a row-level top-k, partial before the shuffle) give the samples of nearly every
    column; only columns that still have fewer than ``k`` samples but more non-null values
    (``agg.n_nonnull``) are ranked over all their values, and only those groups are shuffled.
    """
    head = first_rows(rows, probe)
    quick = materialize(_top_values(long_values(head).filter(~is_null_token(F.col("value"))), k))  # k values a column
    need = materialize(agg.select("upload_id", "ordinal", "n_nonnull")
                       .join(quick, ["upload_id", "ordinal"], "left")
                       .filter(F.coalesce(F.size("samples"), F.lit(0))
                               < F.least(F.col("n_nonnull"), F.lit(k)))
                       .select("upload_id", "ordinal"))
    if need.isEmpty():  # else the plan below, whose sizes Spark cannot foresee, shuffles every value
        return quick
    lv = long_values(rows).filter(~is_null_token(F.col("value")))
    slow = _top_values(lv.join(need, ["upload_id", "ordinal"]), k)
    return quick.join(need, ["upload_id", "ordinal"], "left_anti").unionByName(slow)


def _counts(lv: DataFrame, *more: Column) -> DataFrame:
    """Null counts and class flags per (upload_id, ordinal) of long values; a column costs a state a task."""
    lv = lv.select("upload_id", "ordinal", "value", *[c.alias(k) for k, c in _flags(F.col("value")).items()])
    return lv.groupBy("upload_id", "ordinal").agg(
        F.count_if("is_null").alias("null_count"), F.count_if(~F.col("is_null")).alias("n_nonnull"), *more,
        *[F.bool_and(F.col("is_null") | F.col(f"is_{k[4:]}")).alias(k) for k in _ALL])


#: Distinct values are counted in so many parts at most, of this many rows at least, one after the other.
MOST_PARTS, ROWS_A_PART = 4, 1 << 20


def unique_counts(rows: DataFrame, numeric: DataFrame | None = None) -> DataFrame:
    """(upload_id, ordinal, unique_count), exact. Values are compared as texts, those of the columns that
    ``numeric`` (upload_id, ordinal) names as parsed numbers. Only the distinct keys of a task are shuffled,
    and nothing but the keys; those of many rows in parts by a hash of the value, so that a part's shuffle is
    gone before the next."""
    n = min(MOST_PARTS, max(1, rows.count() // ROWS_A_PART))
    if numeric is not None:
        places = numeric.groupBy("upload_id").agg(F.collect_list("ordinal").alias("numeric"))
        rows = rows.join(places, "upload_id", "left")
    lv = rows.select("upload_id", *(["numeric"] if numeric is not None else []), F.posexplode("vals").alias("pos", "value"))
    lv = lv.withColumn("ordinal", F.col("pos") + 1).filter(~is_null_token(F.col("value")))
    as_number = F.lit(False) if numeric is None else F.coalesce(F.array_contains("numeric", F.col("ordinal")), F.lit(False))
    number = F.trim("value").try_cast("double") + F.lit(0.0)  # 0.0 and -0.0 are one number
    keys = lv.select("upload_id", "ordinal", F.when(as_number, number).alias("number"),
                     F.when(~as_number, F.col("value")).alias("text")).filter("number is not null or text is not null")

    def counted(keys: DataFrame) -> DataFrame:
        return keys.distinct().groupBy("upload_id", "ordinal").agg(F.count(F.lit(1)).alias("unique_count"))
    if n == 1:
        return counted(keys)
    part = F.pmod(F.xxhash64("number", "text"), F.lit(n))
    return materialize_all([counted(keys.filter(part == k)) for k in range(n)]).groupBy("upload_id", "ordinal").agg(
        F.sum("unique_count").alias("unique_count"))


def column_stats(rows: DataFrame, mode: str = "typed") -> DataFrame:
    """P2-P5 per (upload_id, ordinal), before names are attached."""
    agg = materialize(_counts(long_values(rows)))  # one row per column
    cdm, dtype = _class(mode)
    numeric = agg.filter(dtype.isin("int64", "float64")).select("upload_id", "ordinal") if mode == "compat" else None
    agg = agg.join(unique_counts(rows, numeric), ["upload_id", "ordinal"], "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0)))
    agg = materialize(agg)  # read by the sample step and the output
    samples = first_samples(rows, agg, model.SAMPLE_VALUES).select(
        "upload_id", "ordinal", F.transform("samples", lambda x: x["value"]).alias("raw_samples"))
    out = agg.join(samples, ["upload_id", "ordinal"], "left").withColumns(
        {"cdm_type": cdm, "dtype": dtype})
    raw = F.coalesce(F.col("raw_samples"), F.array().cast("array<string>"))
    if mode == "compat":
        # pandas counts and renders parsed numbers: '007' is '7', '5' in a float column '5.0'
        sv = (F.when(F.col("dtype") == "int64",
                     F.transform(raw, lambda x: F.trim(x).try_cast("bigint").cast("string")))
              .when(F.col("dtype") == "float64",
                    F.transform(raw, lambda x: float_text(F.trim(x).try_cast("double"))))
              .otherwise(raw))
    else:
        sv = raw
    return out.withColumn("sample_values", sv)


def profile(rows: DataFrame, headers: DataFrame, mode: str = "typed",
            row_cap: int | None = None, approximate: bool = False) -> DataFrame:
    """One row per (upload, column), in PROFILE_SCHEMA order. ``approximate`` (typed mode): distinct
    counts from sketches, so that no value is shuffled for them."""
    r = cap_rows(rows, row_cap) if row_cap else rows
    if approximate:
        if mode != "typed":
            raise ValueError("sketches count texts; the compat mode counts parsed numbers")
        return profile_of_states(profile_states(r), headers)
    st = column_stats(r, mode)
    return (st.join(headers.select("upload_id", "names"), "upload_id")
            .select("upload_id",
                    F.element_at("names", F.col("ordinal")).alias("column_name"),
                    F.col("ordinal").cast("int").alias("ordinal"),
                    "dtype", "cdm_type", "sample_values",
                    F.col("null_count").cast("bigint").alias("null_count"),
                    F.col("unique_count").cast("bigint").alias("unique_count")))


# --- mergeable states (P2-P5 of uploads that arrive in parts; approximate distinct counts) ----------

#: log2 of the sketch's registers; the relative standard error of a distinct count is 1.04 / 2 ** (LG_K / 2).
LG_K = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)


#: Columns whose states a task keeps in a hash table (some kilobytes each) before it sorts the values instead.
STATES_A_TASK = 8192


@contextmanager
def _states_in_memory(spark: SparkSession) -> Iterator[None]:
    """Spark sorts all rows of an aggregation with sketches once a task has 128 keys, which some ten uploads
    have; here ``STATES_A_TASK`` are kept first."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(max(int(kept), STATES_A_TASK)))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def profile_states(rows: DataFrame) -> DataFrame:
    """One row per (upload_id, ordinal) of ``rows``, of bounded size, that merges with states of other rows
    of the upload: counts, class flags, a sketch of the distinct values and the first samples with their
    row order. No value is shuffled but the samples: every column costs a state a task."""
    sketch = F.hll_sketch_agg(F.when(~F.col("is_null"), F.col("value")), LG_K).alias("sketch")
    with _states_in_memory(rows.sparkSession):
        counts = materialize(_counts(long_values(rows), sketch))
    return counts.join(first_samples(rows, counts), ["upload_id", "ordinal"], "left")


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same columns as one state each; the order of merging does not matter."""
    none = F.filter(F.first("samples"), lambda x: F.lit(False))
    merged = states.groupBy("upload_id", "ordinal").agg(
        F.sum("null_count").alias("null_count"), F.sum("n_nonnull").alias("n_nonnull"),
        F.hll_union_agg("sketch").alias("sketch"), *[F.bool_and(k).alias(k) for k in _ALL],
        F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, model.SAMPLE_VALUES).alias("samples"), none.alias("none"))
    return merged.withColumn("samples", F.coalesce("samples", "none")).drop("none")


def profile_of_states(states: DataFrame, headers: DataFrame) -> DataFrame:
    """P1-P5 in typed mode from merged states, in PROFILE_SCHEMA order; ``unique_count`` is the sketch's
    estimate (relative standard error ``DISTINCT_ERROR``, exact for few values), all else exact."""
    cdm, dtype = _class("typed")
    values = F.transform(F.col("samples"), lambda x: x["value"])
    return (merge_states(states).withColumns({"cdm_type": cdm, "dtype": dtype})
            .join(headers.select("upload_id", "names"), "upload_id")
            .select("upload_id", F.element_at("names", F.col("ordinal")).alias("column_name"),
                    F.col("ordinal").cast("int").alias("ordinal"), "dtype", "cdm_type",
                    F.coalesce(values, F.array().cast("array<string>")).alias("sample_values"),
                    F.col("null_count").cast("bigint").alias("null_count"),
                    F.least(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)), "n_nonnull").cast("bigint").alias("unique_count")))


def upload_summary(rows: DataFrame, headers: DataFrame, row_cap: int | None = None) -> DataFrame:
    """P6 + S3: row count as read (at most ``row_cap`` if given), the true count, column count."""
    n = rows.groupBy("upload_id").agg(F.count(F.lit(1)).alias("true_row_count"))
    cnt = (F.least(F.col("true_row_count"), F.lit(row_cap)) if row_cap
           else F.col("true_row_count"))
    return (headers.join(n, "upload_id", "left")
            .select("upload_id",
                    F.coalesce(cnt, F.lit(0)).cast("bigint").alias("row_count"),
                    F.coalesce(F.col("true_row_count"), F.lit(0)).cast("bigint")
                    .alias("true_row_count"),
                    F.size("names").cast("int").alias("column_count")))


def profile_json(profile_rows: DataFrame) -> DataFrame:
    """(upload_id, schema_json) — columns in file order, form 1 of the profile document."""
    entry = F.struct(
        F.col("ordinal"), F.col("column_name"),
        F.struct("dtype", "cdm_type", "sample_values", "null_count", "unique_count").alias("info"))
    return (profile_rows.groupBy("upload_id")
            .agg(F.array_sort(F.collect_list(entry)).alias("cols"))
            .select("upload_id", F.to_json(F.map_from_entries(F.transform(
                "cols", lambda c: F.struct(c["column_name"], c["info"])))).alias("schema_json")))


def sample_rows_json(rows: DataFrame, headers: DataFrame, n: int = model.SAMPLE_ROWS, stored: bool = False) -> DataFrame:
    """(upload_id, sample_data_json) — the first ``n`` rows as JSON records, text values. ``stored`` rows
    may be read twice, so that not all of them are sorted."""
    first = first_rows(rows, n) if stored else cap_rows(rows, n)
    rec = F.map_from_arrays("names", F.slice("vals", 1, F.size("names")))
    return (first.join(headers.select("upload_id", "names"), "upload_id")
            .groupBy("upload_id")
            .agg(F.array_sort(F.collect_list(F.struct("row_no", F.to_json(rec).alias("rec"))))
                 .alias("r"))
            .select("upload_id",
                    F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["rec"]), ","),
                             F.lit("]")).alias("sample_data_json")))


def parse_profile_json(docs: DataFrame, json_col: str = "schema_json") -> DataFrame:
    """A profile document in either stored form -> rows (upload_id, ordinal, column_name,
    cdm_type, sample_values, null_count, unique_count, cdm_field); unreadable text gives no rows.
    """
    m = F.from_json(F.col(json_col), model.PROFILE_DOC_DDL)
    return (docs.select("upload_id", F.posexplode(m).alias("pos", "column_name", "info"))
            .select("upload_id", (F.col("pos") + 1).cast("int").alias("ordinal"), "column_name",
                    F.coalesce(F.nullif(F.col("info.cdm_type"), F.lit("")), F.col("info.type"),
                               F.lit("string")).alias("cdm_type"),
                    F.coalesce(F.col("info.sample_values"), F.array().cast("array<string>"))
                    .alias("sample_values"),
                    F.col("info.null_count").alias("null_count"),
                    F.col("info.unique_count").alias("unique_count"),
                    F.col("info.cdm_field").alias("cdm_field")))


def layout_signatures(headers: DataFrame) -> DataFrame:
    """(upload_id, layout_text, layout_id) — joined column names and their sha-256."""
    return headers.select("upload_id", layout_text(F.col("names")).alias("layout_text"),
                          layout_id_of(F.col("names")).alias("layout_id"))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, as one union of count aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
