"""Strict upload state machine as an ordered fold, without one task per upload.

States: NONE, PENDING_MAPPING, PENDING_REVIEW, APPROVED. Steps and their legal moves:
upload (from NONE, PENDING_MAPPING or APPROVED -> PENDING_MAPPING), map (PENDING_MAPPING ->
PENDING_REVIEW), approve (PENDING_REVIEW -> APPROVED), reject (PENDING_REVIEW ->
PENDING_MAPPING). An illegal step leaves the state unchanged and is counted.

Each step is a function on the 4 states (next state, illegal flag per start state); functions
compose associatively. Each (upload, piece) folds its own steps in order, and each upload then
composes its piece summaries in piece order. Pieces hold about equally many rows of the whole log
(their number follows the row count), also when one upload holds a third of all steps at one instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import ordered_pieces
from .asof import order_number

STATES = ["NONE", "PENDING_MAPPING", "PENDING_REVIEW", "APPROVED"]
STEPS = ["upload", "map", "approve", "reject"]
# next state per (step, current state) and whether the step is illegal there
NEXT = [[1, 1, 2, 1], [0, 2, 2, 3], [0, 1, 3, 3], [0, 1, 1, 3]]
ILLEGAL = [[0, 0, 1, 0], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 0, 1]]


def _lit2(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])


def _identity() -> Column:
    return F.struct(F.array(*[F.lit(i) for i in range(4)]).alias("to"),
                    F.array(*[F.lit(0) for _ in range(4)]).alias("bad"))


def _apply_step(acc: Column, step: Column) -> Column:
    nxt = F.element_at(_lit2(NEXT), step + 1)
    ill = F.element_at(_lit2(ILLEGAL), step + 1)
    return F.struct(
        F.transform(acc["to"], lambda s: F.element_at(nxt, s + 1)).alias("to"),
        F.zip_with(acc["bad"], acc["to"], lambda b, s: b + F.element_at(ill, s + 1)).alias("bad"))


def _compose(acc: Column, g: Column) -> Column:
    return F.struct(
        F.transform(acc["to"], lambda s: F.element_at(g["to"], s + 1)).alias("to"),
        F.zip_with(acc["bad"], acc["to"], lambda b, s: b + F.element_at(g["bad"], s + 1))
        .alias("bad"))


def strict_states(steps: DataFrame, key: str = "upload_id", pieces: int | None = None) -> DataFrame:
    """(key, state, illegal_steps, n_steps) from (key, ts, event_id, step) rows."""
    s = ordered_pieces(steps, order_number(steps, "ts"), order_number(steps, "event_id"), "_piece", pieces)
    s = s.withColumn("_code", F.array_position(F.array(*[F.lit(x) for x in STEPS]), F.col("step")).cast("int") - 1)
    per_piece = (s.groupBy(key, "_piece")
                 .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "_code")))
                      .alias("evs"), F.count(F.lit(1)).alias("n"))
                 .select(key, "_piece", "n",
                         F.aggregate("evs", _identity(),
                                     lambda acc, e: _apply_step(acc, e["_code"])).alias("f")))
    per_key = (per_piece.groupBy(key)
               .agg(F.array_sort(F.collect_list(F.struct("_piece", "f"))).alias("fs"),
                    F.sum("n").alias("n_steps"))
               .select(key, "n_steps",
                       F.aggregate("fs", _identity(), lambda acc, p: _compose(acc, p["f"]))
                       .alias("f")))
    names = F.array(*[F.lit(x) for x in STATES])
    return per_key.select(key, F.element_at(names, F.element_at("f.to", 1) + 1).alias("state"),
                          F.element_at("f.bad", 1).cast("bigint").alias("illegal_steps"),
                          F.col("n_steps").cast("bigint"))
