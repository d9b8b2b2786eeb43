"""As-of (skew-safe) against a plain window, and registry additions."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from cdmspark.functions.local import values_frame
from cdmspark.operators import asof
from cdmspark.operators import registry as RG


def test_last_before_matches_window_with_a_hot_key(spark):
    # one key holds most rows and spans every piece; values are sparse
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 10 else f"k{i % 7}", base + dt.timedelta(minutes=i), i,
             i if i % 13 == 0 else None) for i in range(3000)]
    df = values_frame(spark, rows, "key string, ts timestamp, id bigint, v bigint")
    got = asof.last_before(df, "key", ["ts", "id"], "v", "prev", pieces=16)
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.last("v", ignorenulls=True).over(w))
    j = got.join(ref.select("id", "ref"), "id")
    assert j.count() == 3000
    assert j.filter(~F.col("prev").eqNullSafe(F.col("ref"))).count() == 0
    inc = asof.last_before(df, "key", ["ts", "id"], "v", "prev", pieces=16, inclusive=True)
    row = inc.filter("id = 13").collect()[0]
    assert row["prev"] == 13


def test_a_third_of_all_rows_at_one_instant(spark):
    """One key with a third of the rows at one timestamp: no piece holds many of them, and both the
    as-of lookup and the state machine stay right."""
    from cdmspark.functions.ranges import ordered_pieces
    from cdmspark.operators import statemachine as SM
    base = dt.datetime(2024, 1, 1)
    steps = SM.STEPS
    rows = [("hot", base + dt.timedelta(minutes=500), i * 3, i if i % 11 == 0 else None, steps[i % 4]) for i in range(1000)]
    rows += [(f"k{i % 9}", base + dt.timedelta(minutes=i), i * 3 + 1, i if i % 5 == 0 else None, steps[i % 4]) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, v long, step string")
    cut = ordered_pieces(df, asof.order_number(df, "ts"), F.col("id"), "p", 30)
    assert cut.groupBy("p").count().agg(F.max("count")).first()[0] <= 220
    order = [r["p"] for r in cut.orderBy("ts", "id").collect()]
    assert order == sorted(order)
    got = {r["id"]: r["prev"] for r in asof.last_before(df, "key", ["ts", "id"], "v", "prev", pieces=30).collect()}
    last, state, bad = {}, {}, {}
    for key, _, i, v, step in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == last.get(key)
        last[key] = v if v is not None else last.get(key)
        at, code = state.get(key, 0), steps.index(step)
        bad[key] = bad.get(key, 0) + SM.ILLEGAL[code][at]
        state[key] = SM.NEXT[code][at]
    out = SM.strict_states(df.withColumnRenamed("id", "event_id"), key="key", pieces=30).collect()
    assert {r["key"]: (r["state"], r["illegal_steps"]) for r in out} == {k: (SM.STATES[state[k]], bad[k]) for k in state}


def test_add_fields_refuses_existing_and_numbers_numerically(spark):
    as_of = dt.datetime(2026, 1, 1)
    cdm = RG.cdm_seed(spark, as_of)
    big = values_frame(spark, [("f999", "x999", "X", "STRING", "", False, "", "u", as_of, ""),
                               ("f1000", "x1000", "X", "STRING", "", False, "", "u", as_of, "")],
                       cdm.schema)
    reg = cdm.unionByName(big)
    props = values_frame(spark, [("revenue", "Revenue", "DECIMAL", "dup", "", False, "C1"),
                                 ("promo", "Promo", "DECIMAL", "new", "", False, "C2"),
                                 ("promo", "Promo", "DECIMAL", "dup in batch", "", False, "C3"),
                                 ("brand", "Brand", "STRING", "new", "", False, "C1")],
                         "field_name string, display_name string, data_type string, "
                         "description string, example_values string, is_required boolean, "
                         "source_customer string")
    out = {r["field_name"]: r for r in RG.add_fields(reg, props, "user", as_of).collect()}
    assert out["revenue"]["outcome"] == "refused: exists"
    assert out["brand"]["field_id"] == "f1001" and out["promo"]["field_id"] == "f1002"
    assert out["promo"]["source_customer"] == "C2"
    assert RG.next_field_number(cdm).collect()[0][0] == 18
    line = RG.summary_line(cdm).collect()[0]["cdm_summary"]
    assert line.startswith("date (DATE), customer_id (STRING)")


def test_normalized_names(spark):
    df = values_frame(spark, [("WeekEndDate",), ("GROSS_SALES_EUR",), ("sku number",)], "c string")
    got = [r[0] for r in df.select(RG.normalized_name(F.col("c"))).collect()]
    assert got == ["week_end_date", "gross_sales_eur", "sku_number"]


def test_strict_state_machine_matches_sequential_fold(spark):
    import random
    from cdmspark.operators import statemachine as SM
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(2000):
        key = "hot" if i % 4 else f"k{i % 5}"
        rows.append((key, base + dt.timedelta(seconds=i * 37), i, rnd.choice(SM.STEPS)))
    df = values_frame(spark, rows, "upload_id string, ts timestamp, event_id bigint, step string")
    got = {r["upload_id"]: (r["state"], r["illegal_steps"], r["n_steps"])
           for r in SM.strict_states(df, pieces=8).collect()}
    ref = {}
    for key in {r[0] for r in rows}:
        state, bad, n = 0, 0, 0
        for _, _, _, step in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            code = SM.STEPS.index(step)
            bad += SM.ILLEGAL[code][state]
            state = SM.NEXT[code][state]
            n += 1
        ref[key] = (SM.STATES[state], bad, n)
    assert got == ref
