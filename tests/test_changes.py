"""Tables that change: newest row per key, corrected uploads, added fields, strict dates, streamed states."""

import datetime as dt
import itertools

import pytest

from pyspark.sql import types as T

from cdmspark import model
from cdmspark.operators import conform as C
from cdmspark.operators import registry as RG
from cdmspark.operators import statemachine as SM
from cdmspark.sources import sinks as SK
from cdmspark.streaming import states as SS

HEADS = [("u1", "L", "T", "POS", ["d", "s", "q", "r", "Brand Code"]), ("u2", "L", "T", "POS", ["d", "s", "q", "r", "Brand Code"])]
MAPS = [("L", a, b, None) for a, b in zip("dsqr", ["date", "product_sku", "units_sold", "revenue"])]
BRAND = ("f018", "brand_code", "Brand Code", "INTEGER", "", False, None)


def _plans(spark, fields=None):
    heads = spark.createDataFrame(HEADS, "upload_id string, layout_id string, customer_id string, source_system string, names array<string>")
    maps = spark.createDataFrame(MAPS, "layout_id string, source_column string, cdm_field string, transformation string")
    return C.upload_plans(heads, RG.extended_mappings(maps, heads, fields) if fields else maps, fields)


def _checked(spark, rows, fields=None):
    raw = spark.createDataFrame([(u, list(v)) for u, v in rows], "upload_id string, vals array<string>")
    return C.conform_checked(raw, _plans(spark, fields), dt.datetime(2026, 1, 1), fields)


def _skus(df):
    return sorted((r.upload_id, r.product_sku) for r in df.collect())


def row(sku, revenue="2", day="2024-01-01", brand="7"):
    return (day, sku, "1", revenue, brand)


def test_a_corrected_upload_replaces_the_first(spark, tmp_root, monkeypatch):
    SK.load_sales(spark, _checked(spark, [("u1", row("a")), ("u1", row("b", "x")), ("u2", row("c"))]), tmp_root)
    second = _checked(spark, [("u1", row("A")), ("u1", row("B"))])
    # a replacement that breaks off before the manifest shows the old rows
    monkeypatch.setattr(SK, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        SK.replace_sales(spark, second, tmp_root)
    monkeypatch.undo()
    assert _skus(SK.read_sales(spark, tmp_root)) == [("u1", "a"), ("u2", "c")]
    assert SK.replace_sales(spark, second, tmp_root) == 2
    assert _skus(SK.read_sales(spark, tmp_root)) == [("u1", "A"), ("u1", "B"), ("u2", "c")]
    assert SK.read_quarantine(spark, tmp_root).count() == 0
    assert _skus(SK.read_sales(spark, tmp_root, as_of=1)) == [("u1", "a"), ("u2", "c")]
    assert SK.read_quarantine(spark, tmp_root, as_of=1).count() == 1
    # approving again loads nothing, compacting changes nothing, an empty correction takes all rows away
    SK.load_sales(spark, second, tmp_root)
    assert SK.compact_sales(spark, tmp_root) == 3
    assert _skus(SK.read_sales(spark, tmp_root)) == [("u1", "A"), ("u1", "B"), ("u2", "c")]
    gone = spark.createDataFrame([("u2",)], "upload_id string")
    SK.replace_sales(spark, second.limit(0), tmp_root, gone)
    assert _skus(SK.read_sales(spark, tmp_root)) == [("u1", "A"), ("u1", "B")]
    assert _skus(SK.read_sales(spark, tmp_root, as_of=3)) == [("u1", "A"), ("u1", "B"), ("u2", "c")]


def test_added_fields_are_loaded_and_older_batches_have_none(spark, tmp_root):
    fields = [*model.CDM_FIELDS, BRAND]
    SK.load_sales(spark, _checked(spark, [("u1", row("a"))]), tmp_root)
    assert SK.read_sales(spark, tmp_root).columns == model.SALES_COLUMNS
    SK.load_sales(spark, _checked(spark, [("u2", row("b", brand="8")), ("u2", row("c", brand="none")), ("u2", row("d", brand=None))], fields),
                  tmp_root, fields)
    got = SK.read_sales(spark, tmp_root)
    assert got.columns == [*model.SALES_COLUMNS, "brand_code"]
    assert sorted((r.product_sku, r.brand_code) for r in got.collect()) == [("a", None), ("b", 8), ("d", None)]
    assert SK.read_quarantine(spark, tmp_root).select("cast_errors").first()[0] == ["brand_code"]
    SK.compact_sales(spark, tmp_root)
    assert sorted((r.product_sku, r.brand_code) for r in SK.read_sales(spark, tmp_root).collect()) == [("a", None), ("b", 8), ("d", None)]


def test_field_list_and_clashing_field_names(spark):
    cdm = RG.cdm_seed(spark, dt.datetime(2026, 1, 1))
    assert RG.field_list(cdm) == [tuple(f) for f in model.CDM_FIELDS]
    assert model.target_column("sale_date") == "sale_date_field" and model.target_column("date") == "sale_date"


@pytest.mark.parametrize("text,day", [
    ("2024-01-05", dt.date(2024, 1, 5)), (" 2024-01-05 ", dt.date(2024, 1, 5)), ("2024-01-05 10:20:30", dt.date(2024, 1, 5)),
    ("2024-01-05T10:20:30.5Z", dt.date(2024, 1, 5)), ("2024-01-05 garbage", None), ("2024-01-05Tx", None), ("2024", None),
    ("2024-5", None), ("12024-01-05", None), ("2024-02-30", None), ("2024-01-05 25:00", None), ("2024-01-05T", None)])
def test_a_date_is_one_as_a_whole(spark, text, day):
    (r,) = _checked(spark, [("u1", row("a", day=text))]).collect()
    assert r.sale_date == day and r.cast_errors == ([] if day else ["date"]) and r.accepted == (day is not None)


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])


def test_newest_row_counts_in_any_order_of_arrival(spark, tmp_root):
    batches = [[("a", 1, "a1"), ("b", 5, "b5")], [("a", 3, "a3"), ("b", 2, "b2"), ("a", 2, "a2")], [("c", 0, "c0"), ("a", 3, "a3")]]
    for n, order in enumerate(itertools.permutations(range(3))):
        log = SK.KeyedLog(spark, f"{tmp_root}/{n}", SCHEMA, "k", ("at",))
        assert log.read().count() == 0 and log.compact() == -1
        for epoch, k in enumerate(order):
            log.put(spark.createDataFrame(batches[k], SCHEMA), epoch)
            if epoch == n % 3:
                assert log.compact() == epoch == log.compact()
        log.put(spark.createDataFrame(batches[order[2]], SCHEMA), 2)  # the last micro-batch runs again
        assert sorted(tuple(r) for r in log.read().collect()) == [("a", 3, "a3"), ("b", 5, "b5"), ("c", 0, "c0")]


def test_a_base_that_broke_off_is_not_read(spark, tmp_root, monkeypatch):
    log = SK.KeyedLog(spark, tmp_root, SCHEMA, "k", ("at",))
    log.put(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    monkeypatch.setattr(SK, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.compact()
    monkeypatch.undo()
    assert [tuple(r) for r in log.read().collect()] == [("a", 1, "x")]


def test_streamed_states_equal_the_batch_after_a_restart(spark, tmp_root):
    base = dt.datetime(2026, 1, 1)
    steps = [(f"u{i % 3}", base + dt.timedelta(hours=i // 2), i, ["upload", "map", "approve", "map", "reject", "upload"][(i * 7 + i // 3) % 6])
             for i in range(60)]
    schema = T.StructType([T.StructField("upload_id", T.StringType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("event_id", T.LongType()), T.StructField("step", T.StringType())])
    # every step comes at most ten hours late
    arrival = sorted(steps, key=lambda s: (s[1] + dt.timedelta(hours=(s[2] * 5) % 10), s[2]))
    files = [arrival[a:a + 15] for a in range(0, 60, 15)]
    for run in (files[:2], files[2:]):
        for rows in run:
            SK.append(spark.createDataFrame(rows, schema).coalesce(1), f"{tmp_root}/in")
        SS.strict_states_stream(spark, f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ck", schema, "10 hours", 1)
    want = SM.strict_states(spark.createDataFrame(steps, schema)).select("upload_id", "state", "illegal_steps", "n_steps")
    got = SS.latest_states(spark, f"{tmp_root}/out")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert SS.fold((0, 0, 0), [(0, 0, 0), (1, 1, 1), (2, 2, 1)]) == (2, 1, 3)


def test_insert_if_absent_takes_the_smallest_row(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 9)], "k string, v int")
    old = spark.createDataFrame([("b", 0)], "k string, v int")
    assert [tuple(r) for r in RG.insert_if_absent(old, new, "k").select("k", "v").collect()] == [("a", 1)]
