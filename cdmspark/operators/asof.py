"""Skew-safe "last value before" (as-of) per key, without one task per key.

A window ``partitionBy(key).orderBy(t)`` puts all rows of a key in one task, and one key may hold a
third of all rows. Instead the whole sequence is cut into pieces of about equally many rows, by
quantiles of the first order column and, where one value of it fills several quantiles, by quantiles
of the second. The edges are fixed numbers once read, so every branch of the plan and every retried
task computes the same piece for a row.
The scan then runs in two levels:

1. inside each (key, piece): ``last(value, ignorenulls)`` over the earlier rows;
2. across pieces: each piece's last value goes to a small table (one row per non-empty piece),
   and a window over key ordered by piece gives the carry-in from earlier pieces (rows per key are
   bounded by the number of pieces, not by the data).

The answer per row is the local value, else the carry-in. All built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranges import ordered_pieces


def order_number(df: DataFrame, name: str) -> Column:
    """An order column as a bigint that sorts the same way."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint")
    return c.cast("bigint")


def last_before(df: DataFrame, key: str, order: list[str], value: str, out: str,
                pieces: int | None = None, inclusive: bool = False) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the same ``key`` strictly before each row in
    ``order`` (or up to and including the row when ``inclusive``)."""
    r = ordered_pieces(df, order_number(df, order[0]), order_number(df, order[-1]), "_piece", pieces)
    upto = 0 if inclusive else -1
    w_local = (Window.partitionBy(key, "_piece").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, upto))
    r = r.withColumn("_local", F.last(value, ignorenulls=True).over(w_local))
    last_in_piece = (r.filter(F.col(value).isNotNull())
                     .groupBy(key, "_piece")
                     .agg(F.max_by(F.col(value), F.struct(*order)).alias("_piece_last")))
    # one row per non-empty (key, piece), at most as many as pieces per key: carry-in = last value of an
    # earlier piece
    w_carry = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = (r.select(key, "_piece").distinct()
             .join(last_in_piece, [key, "_piece"], "left")
             .withColumn("_carry_in", F.last("_piece_last", ignorenulls=True).over(w_carry))
             .select(key, "_piece", "_carry_in"))
    return (r.join(carry, [key, "_piece"], "left")
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry_in")))
            .drop("_piece", "_local", "_carry_in"))
