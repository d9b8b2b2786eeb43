"""Helpers that the operators share: scans, the shared folder, stored intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table

__all__ = ["new_folder", "packed", "small_batches", "store", "table", "text_of", "unpacked", "whole_text"]

BATCH_ROWS = 1000


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder name nobody used before, in the folder of ``spark.checkpoint.dir``, which the
    driver and every executor see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, so an
    executor lost later costs a read of files, not a rerun."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text"):
    """The text column, a null counting as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``: whatever names its columns have (``__key``, ``a.b``), none
    meets a column that an operator adds."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``packed`` rows again, ``changed`` ones by their new expressions."""
    changed = changed or {}
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def text_of(column: str) -> Column:
    """The text of a ``packed`` row, a null counting as the empty text."""
    return F.coalesce(F.col("row")[column].cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most ``BATCH_ROWS`` rows at a time: texts are thousands of characters
    long, and a batch is held by the JVM and by the worker. Lowers the session's setting only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
