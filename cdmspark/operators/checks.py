"""Data checks the relational store used to enforce (V1-V5): all checks of a table in one pass.

Each check returns counts, never raises: one row per (table, check) with the offending count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model


def not_null(cols: list[str]) -> dict[str, Column]:
    """V3: NULLs in NOT NULL columns."""
    return {f"not null {c}": F.col(c).isNull() for c in cols}


def max_length(df: DataFrame, limits: dict[str, int]) -> dict[str, Column]:
    """V3: text longer than its VARCHAR(n)."""
    return {f"length {c} <= {n}": F.length(F.col(c)) > n for c, n in limits.items() if c in df.columns}


def allowed_values(col: str, allowed: list[str]) -> dict[str, Column]:
    """V4: values outside the allowed list (NULL passes, as in a CHECK constraint)."""
    return {f"allowed {col}": F.col(col).isNotNull() & ~F.col(col).isin(*allowed)}


def defaults_applied(defaults: dict[str, object]) -> dict[str, Column]:
    """V5: rows that take each default."""
    return {f"default {c}": F.col(c).isNull() for c in defaults}


def with_parent(child: DataFrame, col: str, parent: DataFrame, parent_key: str) -> tuple[DataFrame, dict[str, Column]]:
    """V2: the child with a flag for its parent, and the check that a reference has a parent row
    (a NULL reference counts as an orphan)."""
    flag = f"_has_{col}"
    keys = parent.select(F.col(parent_key).alias(col)).distinct().withColumn(flag, F.lit(True))
    return child.join(keys, col, "left"), {f"foreign key {col}": F.col(flag).isNull()}


def check_table(df: DataFrame, table: str, key: str | None, checks: dict[str, Column]) -> DataFrame:
    """(table_name, check_name, n_rows, n_bad): V1 (the key is NULL or shared) where there is a key,
    and every other check, in one aggregate by key and one over its groups."""
    names = list(checks)
    flags = [F.count_if(checks[n]).alias(f"b{i}") for i, n in enumerate(names)]
    if key:
        per = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), *flags)
        pk = [F.sum(F.when(F.col("k").isNull() | (F.col("n") > 1), F.col("n")).otherwise(0)).alias("pk")]
        total = per.agg(F.sum("n").alias("n"), *pk, *[F.sum(f"b{i}").alias(f"b{i}") for i in range(len(names))])
    else:
        total = df.agg(F.count(F.lit(1)).alias("n"), *flags)
    rows = [(f"primary key {key}", "pk")] if key else []
    rows += [(n, f"b{i}") for i, n in enumerate(names)]
    return total.select(F.inline(F.array(*[F.struct(
        F.lit(table).alias("table_name"), F.lit(n).alias("check_name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(c, F.lit(0)).cast("bigint").alias("n_bad")) for n, c in rows])))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """V5: fill the declared defaults on write."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()
                           if c in df.columns})


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


UPLOAD_DEFAULTS = {"status": model.DEFAULT_UPLOAD_STATUS,
                   "source_system": model.DEFAULT_SOURCE_SYSTEM}
REVIEW_DEFAULTS = {"reviewer": model.DEFAULT_REVIEWER}
MAPPING_DEFAULTS = {"status": model.DEFAULT_MAPPING_STATUS}
