"""Ranges of an ordered column that hold about equally many rows, heavy values included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_PIECE, MIN_PIECES, MAX_PIECES = 10_000, 64, 4096


def range_index(at: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` lie below ``at`` (0 for null): a search in two steps, among
    every ``step``-th edge and then among the ``step`` edges after it."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    groups = F.split(F.lit(";".join(",".join(map(str, edges[i:i + step]))
                                    for i in range(0, len(edges), step))), ";")
    heads = F.split(F.lit(",".join(map(str, edges[::step]))), ",").cast("array<bigint>")

    def below(a: Column) -> Column:
        return F.size(F.filter(a, lambda e: e < at))

    inside = F.element_at(F.transform(F.array(below(heads)), lambda g: F.when(g == 0, F.lit(0)).otherwise(
        (g - 1) * step + below(F.split(F.get(groups, g - 1), ",").cast("array<bigint>")))), 1)
    return F.when(at.isNull(), F.lit(0)).otherwise(inside)


def _quantiles(df: DataFrame, at: Column, pieces: int) -> list[int]:
    got = df.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], pieces * 20).alias("q")).first()["q"]
    return sorted(got or [])


def ordered_pieces(df: DataFrame, at: Column, tie: Column, out: str, pieces: int | None = None) -> DataFrame:
    """Add ``out``, a number that never falls along the order (``at``, ``tie``) and takes about equally
    many rows each: quantiles of ``at`` (bigint), and for values of ``at`` that alone fill several
    quantiles, quantiles of ``tie`` (bigint) among them. The edges, at most ``MAX_PIECES`` numbers
    each, are what the driver sees; ``pieces`` follows the number of rows unless given."""
    if pieces is None:
        pieces = min(MAX_PIECES, max(MIN_PIECES, df.count() // ROWS_A_PIECE))
    edges = _quantiles(df, at, pieces)
    heavy = sorted({a for a, b in zip(edges, edges[1:]) if a == b})
    first = range_index(at, sorted(set(edges))) * 2
    if not heavy:
        return df.withColumn(out, first.cast("bigint") * MAX_PIECES)
    is_heavy = F.coalesce(at.isin(heavy), F.lit(False))
    ties = sorted(set(_quantiles(df.filter(is_heavy), tie, pieces)))
    second = F.when(is_heavy, range_index(tie, ties)).otherwise(F.lit(0))
    return df.withColumn(out, (first + is_heavy.cast("int")).cast("bigint") * MAX_PIECES + second)
