"""P1-P9 on a hand-written upload: both class modes, null tokens, samples, documents."""

from pyspark.sql import functions as F

from cdmspark.functions.local import values_frame
from cdmspark.operators import profile as P


def _upload(spark):
    names = ["i", "i_null", "dec", "dt", "flag", "empty", "txt"]
    rows = [["1", "1", "1.5", "2024-01-01", "true", "", "a"],
            ["007", "NA", "2", "2024-01-02", "false", "nan", "b"],
            ["3", "3", "", "2024-01-03", "true", "", "a"],
            ["4", "", "4.25", "2024-01-04", "false", "NULL", "c"]]
    raw = values_frame(spark, [("u", i, r) for i, r in enumerate(rows)],
                       "upload_id string, row_ord int, vals array<string>")
    heads = values_frame(spark, [("u", names)], "upload_id string, names array<string>")
    return raw, heads


def _by_col(df):
    return {r["column_name"]: r for r in df.collect()}


def test_typed_mode(spark):
    raw, heads = _upload(spark)
    p = _by_col(P.profile(raw, heads, "typed"))
    assert p["i"]["cdm_type"] == "integer" and p["i"]["dtype"] == "int64"
    assert p["i_null"]["cdm_type"] == "integer" and p["i_null"]["null_count"] == 2
    assert p["dec"]["cdm_type"] == "decimal"
    assert p["dt"]["cdm_type"] == "date"
    assert p["flag"]["cdm_type"] == "string" and p["flag"]["dtype"] == "boolean"
    assert p["empty"]["null_count"] == 4 and p["empty"]["cdm_type"] == "string"
    assert p["txt"]["unique_count"] == 3
    assert p["txt"]["sample_values"] == ["a", "b", "a"]


def test_compat_mode_reads_like_pandas(spark):
    raw, heads = _upload(spark)
    p = _by_col(P.profile(raw, heads, "compat"))
    assert p["i"]["dtype"] == "int64" and p["i"]["sample_values"] == ["1", "7", "3"]
    assert p["i_null"]["cdm_type"] == "decimal"            # int with a null -> float
    assert p["i_null"]["sample_values"] == ["1.0", "3.0"]
    assert p["empty"]["cdm_type"] == "decimal"             # all null -> float
    assert p["dt"]["cdm_type"] == "string"                 # dates stay text
    assert p["flag"]["dtype"] == "bool"


def test_compat_counts_and_prints_numbers(spark):
    from pyspark.sql import functions as F
    heads = spark.createDataFrame([("u", ["a", "b"])], "upload_id string, names array<string>")
    raw = spark.createDataFrame([("u", i, v) for i, v in enumerate([["007", "5"], ["7", "5.0"], ["8", "1234567891.25"]])],
                                "upload_id string, row_ord int, vals array<string>")
    p = {r["column_name"]: r for r in P.profile(raw, heads, "compat").collect()}
    assert p["a"]["unique_count"] == 2 and p["a"]["sample_values"] == ["7", "7", "8"]
    assert p["b"]["unique_count"] == 2 and p["b"]["sample_values"] == ["5.0", "5.0", "1234567891.25"]
    df = spark.createDataFrame([(x,) for x in (0.0, 1e7, -12345678.5, 0.0002, 1.5)], "d double")
    assert [r[0] for r in df.select(P.float_text(F.col("d"))).collect()] == ["0.0", "10000000.0", "-12345678.5", "0.0002", "1.5"]


def test_row_cap_and_summary(spark):
    raw, heads = _upload(spark)
    s = P.upload_summary(raw, heads, row_cap=3).collect()[0]
    assert (s["row_count"], s["true_row_count"], s["column_count"]) == (3, 4, 7)
    assert P.cap_rows(raw, 2).count() == 2


def test_profile_document_round_trip(spark):
    raw, heads = _upload(spark)
    prof = P.profile(raw, heads, "typed")
    doc = P.profile_json(prof)
    back = _by_col(P.parse_profile_json(doc))
    assert list(back) and back["dt"]["cdm_type"] == "date" and back["i"]["ordinal"] == 1
    form2 = values_frame(spark, [("u", '{"qty": {"type": "integer", "cdm_field": "units_sold"},'
                                       ' "x": {"cdm_type": "", "type": "decimal"}, "y": {}}')],
                         "upload_id string, schema_json string")
    b2 = _by_col(P.parse_profile_json(form2))
    assert b2["qty"]["cdm_type"] == "integer" and b2["qty"]["cdm_field"] == "units_sold"
    assert b2["x"]["cdm_type"] == "decimal" and b2["y"]["cdm_type"] == "string"
    bad = values_frame(spark, [("u", "{not json")], "upload_id string, schema_json string")
    assert P.parse_profile_json(bad).count() == 0


def test_signature(spark):
    _, heads = _upload(spark)
    r = P.layout_signatures(heads).collect()[0]
    assert r["layout_text"] == "i i_null dec dt flag empty txt" and len(r["layout_id"]) == 64


def _long_upload(spark, n=3000):
    rows = spark.range(n).select(F.lit("u").alias("upload_id"), F.struct("id").alias("row_ord"), F.array(
        (F.col("id") % 7).cast("string"), F.when(F.col("id") > n - 3, "x").otherwise("")).alias("vals"))
    small = spark.range(3).select(F.lit("v").alias("upload_id"), F.struct("id").alias("row_ord"),
                                  F.array(F.lit("07"), F.lit("7")).alias("vals"))
    return rows.unionByName(small)


def test_first_rows_are_those_of_a_full_ranking(spark):
    rows = _long_upload(spark, 20_000)
    for cap in (1, 5, 200):
        got, want = (sorted((r["upload_id"], r["row_ord"]["id"], r["row_no"]) for r in f(rows, cap).collect())
                     for f in (P.first_rows, P.cap_rows))
        assert got == want


def test_samples_past_the_first_rows_and_counts(spark):
    rows = _long_upload(spark)
    counts = {(r["upload_id"], r["ordinal"]): r["unique_count"] for r in P.unique_counts(rows).collect()}
    assert counts == {("u", 1): 7, ("u", 2): 1, ("v", 1): 1, ("v", 2): 1}
    numeric = spark.createDataFrame([("u", 1)], "upload_id string, ordinal int")
    assert {r["unique_count"] for r in P.unique_counts(rows, numeric).filter("upload_id = 'u' and ordinal = 1").collect()} == {7}
    heads = spark.createDataFrame([("u", ["a", "b"]), ("v", ["a", "b"])], "upload_id string, names array<string>")
    for p in (P.profile(rows, heads), P.profile(rows, heads, approximate=True)):
        got = {(r["upload_id"], r["column_name"]): (r["sample_values"], r["unique_count"]) for r in p.collect()}
        assert got[("u", "b")] == (["x", "x"], 1) and got[("u", "a")] == (["0", "1", "2"], 7) and got[("v", "a")] == (["07"] * 3, 1)


def test_samples_found_in_the_first_rows_need_no_second_pass(spark):
    rows = spark.range(50).select(F.lit("u").alias("upload_id"), F.struct("id").alias("row_ord"), F.array(F.lit("a")).alias("vals"))
    agg = P._counts(P.long_values(rows))
    plan = P.first_samples(rows, agg)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
