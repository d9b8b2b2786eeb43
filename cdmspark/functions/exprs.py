"""Column expressions shared by the operators; all are built-in Spark functions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def layout_text(names: Column) -> Column:
    """The layout signature text, column names joined by one space."""
    return F.array_join(names, " ")


def layout_id_of(names: Column) -> Column:
    """A repeatable layout id, sha-256 of the signature text."""
    return F.sha2(layout_text(names), 256)


def stable_id(*parts: Column) -> Column:
    """Repeatable id from a natural key (in place of a random uuid)."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def confidence_band(score: Column) -> Column:
    """High / medium / low at the fixed thresholds."""
    return (F.when(score >= F.lit(model.BAND_HIGH), "high")
            .when(score >= F.lit(model.BAND_MEDIUM), "medium")
            .otherwise("low"))


def confidence_percent(score: Column) -> Column:
    """Percent rounded half up, as an integer."""
    return F.floor(score * F.lit(100) + F.lit(0.5)).cast("int")


def status_label(status: Column) -> Column:
    """Status code -> label; unknown codes fall back to the PENDING_MAPPING label."""
    kv = []
    for code, label in model.STATUS_LABELS:
        kv += [F.lit(code), F.lit(label)]
    return F.coalesce(F.element_at(F.create_map(*kv), status), F.lit(model.STATUS_LABEL_DEFAULT))


def blank_to_null(c: Column) -> Column:
    """Empty or all-blank text is absent."""
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def is_null_token(c: Column) -> Column:
    """A cell pandas would read as missing: NULL or one of its default null tokens."""
    return c.isNull() | c.isin(*model.PANDAS_NULL_TOKENS)


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def file_size_label(size: Column) -> Column:
    """Byte count -> 'n B' / 'n.n KB' / 'n.n MB'."""
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 * 1024,
                  F.concat(F.format_number(size / F.lit(1024.0), 1), F.lit(" KB")))
            .otherwise(F.concat(F.format_number(size / F.lit(1024.0 * 1024.0), 1), F.lit(" MB"))))


def date_label(ts: Column) -> Column:
    """A timestamp as 'Jan 5, 2026, 03:04 PM'."""
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def id_prefix(c: Column) -> Column:
    """The first eight characters of an id, as lists show it."""
    return truncate(c, 8)
