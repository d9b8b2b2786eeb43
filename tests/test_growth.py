"""Steps that must grow no faster than their input: what their plans move, and what one task holds."""

import re

from pyspark.sql import functions as F

from cdmspark.operators import retrieve as RT


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_minhash_pairs_do_not_move(spark):
    d = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} common") for k in range(50)], "id long, text string")
    q = spark.createDataFrame([(1, "w1 w2 common"), (2, "w9")], "id long, text string")
    got = RT.approx_sparse(RT.prose_terms(d, "id", "text"), RT.prose_terms(q, "id", "text"), k=3)
    assert not re.search(r"Exchange hashpartitioning\((query_id#\d+L?, doc_id|doc_id)", _plan(got))
    docs = {k: {f"w{k % 7}", f"w{k % 5}", "common"} for k in range(50)}
    best = sorted(docs, key=lambda k: (-len({"w1", "w2", "common"} & docs[k]) / len({"w1", "w2", "common"} | docs[k]), k))[:3]
    assert [r.doc_id for r in got.orderBy("rank").collect()] == best


def test_index_of_new_documents_moves_postings_by_id_once(spark, tmp_root):
    from cdmspark.operators import textindex as TX
    index = TX.TextIndex(spark, tmp_root)
    known = index._read("docs", TX.DOCS).select(F.col("doc_id").alias("id"))
    counts = RT.prose_terms(spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string"), "id", "text")
    plan = _plan(counts.join(known, "id", "left_anti"))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_a_missing_table_has_a_known_size(spark, tmp_root):
    from cdmspark.sources import sinks as SK
    none = SK.read_or_empty(spark, f"{tmp_root}/none", "upload_id string, seq bigint, tags array<string>")
    assert none.dtypes == [("upload_id", "string"), ("seq", "bigint"), ("tags", "array<string>")] and none.count() == 0
    big = spark.range(5).select(F.col("id").cast("string").alias("upload_id"))
    assert "SortMergeJoin" not in _plan(big.join(none.select("upload_id").distinct(), "upload_id", "left_anti"))


def test_sketches_of_many_columns_are_not_sorted(spark, monkeypatch):
    from cdmspark.operators import profile as P
    name, seen = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", []
    before, store = spark.conf.get(name), P.materialize
    monkeypatch.setattr(P, "materialize", lambda df: (seen.append(int(spark.conf.get(name))), store(df))[1])
    rows = spark.createDataFrame([(f"u{k}", 1, ["1", None]) for k in range(3)], "upload_id string, row_ord long, vals array<string>")
    assert P.profile_states(rows).count() == 6
    assert seen[0] >= P.STATES_A_TASK and spark.conf.get(name) == before


def test_a_deep_search_has_smaller_groups_of_queries(spark):
    from cdmspark.operators import dense as DN
    n = 1 << 17
    for k in (3, 64, 300):
        groups, pieces = DN._sides(spark.range(n), spark.range(n), k)
        assert n / groups * k <= max(DN.RESULTS, DN.LEAST_BLOCK * k) and pieces == -(-n // min(DN.BLOCK, -(-n // 3)))


def test_records_have_no_path_in_their_order(spark, tmp_root):
    from cdmspark.sources import csv_uploads as CU
    for name, text in (("a", "\n \nx,y\n1,2\n"), ("b", "y\r3\r")):
        with open(f"{tmp_root}/{name}.csv", "w", newline="") as f:
            f.write(text)
    rows, heads = CU.read_uploads(spark, tmp_root)
    assert "file_path" not in rows.schema["row_ord"].dataType.names
    names = {r.upload_id: r.names for r in heads.collect()}
    assert sorted((names[r.upload_id], r.vals) for r in rows.collect()) == [(["x", "y"], ["1", "2"]), (["y"], ["3"])]


def test_approved_schemas_are_those_of_the_corpus(spark):
    from cdmspark.operators import workflow as W
    rows = [("M1", "U1", "APPROVED", '{"a":1}', 1), ("M1", "U1", "APPROVED", '{"b":1}', 2), ("M2", "U2", "REJECTED", '{"c":1}', 3)]
    reviews = spark.createDataFrame(rows, "mapping_id string, upload_id string, decision string, source_schema string, event_id long")
    reviews = reviews.withColumns({"customer_id": F.lit("c"), "final_mapping_json": F.lit("{}"), "reviewer": F.lit("r"),
                                   "reviewed_at": F.col("event_id")})
    got = [tuple(r) for r in W.approved_schemas(reviews).collect()]
    assert got == [tuple(r) for r in W.approved_corpus(reviews).select("mapping_id", "source_schema").collect()] == [("M1", '{"b":1}')]


def test_a_load_works_out_and_writes_its_rows_once_and_unsorted(spark, tmp_root, monkeypatch):
    from cdmspark.sources import sinks as SK
    from tests.test_changes import _checked, _skus, row
    checked = _checked(spark, [("u1", row("a")), ("u1", row("b", "x")), ("u2", row("c"))])
    name, seen, kind = "spark.sql.maxConcurrentOutputFileWriters", [], type(checked.write)
    put = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda w, path, *a, **k: (seen.append((path, spark.conf.get(name))), put(w, path, *a, **k))[1])
    batch = SK.load_sales(spark, checked, tmp_root)
    monkeypatch.undo()
    assert [x for x in seen if "/totals/" not in x[0] and "/manifest" not in x[0]] == [(f"{tmp_root}/sales/batch={batch}", str(SK.OPEN_FILES))]
    assert spark.conf.get(name) == "0"
    assert _skus(SK.read_sales(spark, tmp_root)) == [("u1", "a"), ("u2", "c")]
    (r,) = SK.read_quarantine(spark, tmp_root).collect()
    assert (r.upload_id, r.product_sku, r.cast_errors, r.accepted) == ("u1", "b", ["revenue"], False)
    assert sorted((r.upload_id, r.rows_loaded, r.rows_rejected) for r in SK.manifest(spark, tmp_root).collect()) == [("u1", 1, 1), ("u2", 1, 0)]


def test_landed_rows_are_the_sales_rows_stored_by_field(spark, tmp_root):
    from cdmspark.sources import testdata as TD
    tables = {
        "region": [("r_regionkey", 1), ("r_name", "'EAST'")], "nation": [("n_nationkey", 1), ("n_regionkey", 1)],
        "supplier": [("s_suppkey", 10), ("s_nationkey", 1)], "customer": [("c_custkey", 7), ("c_name", "'C'")],
        "part": [("p_partkey", 3), ("p_name", "'P'"), ("p_type", "cast(null as string)"), ("p_retailprice", "2.5D")],
        "orders": [("o_orderkey", "id"), ("o_custkey", 7), ("o_orderpriority", "'LOW'")],
        "lineitem": [("l_orderkey", "id"), ("l_linenumber", "5"), ("l_partkey", 3), ("l_suppkey", 10), ("l_quantity", "2D"),
                     ("l_extendedprice", "9.5D"), ("l_discount", "0.1D"), ("l_tax", "0D"), ("l_returnflag", "'N'"), ("l_linestatus", "'O'"),
                     ("l_shipdate", "timestamp_ntz'2024-01-02 00:00:00'")]}
    for t, cols in tables.items():
        spark.range(6 if t in ("orders", "lineitem") else 1).selectExpr(*[f"{e} AS {c}" for c, e in cols]).write.parquet(f"{tmp_root}/{t}.parquet")
    want = TD.sales_rows(spark, tmp_root)
    assert TD.landed_rows(spark, tmp_root).schema == want.schema
    got = TD.landed_rows(spark, tmp_root, "l_linenumber")
    assert got.schema["row_ord"].dataType.names == ["l_linenumber"]
    assert "cell_revenue" in _plan(got)  # stored by field, put in order when read
    one = [sorted((r.upload_id, r.row_ord.l_linenumber, [str(v) for v in r.vals]) for r in x.collect()) for x in (got, want)]
    assert one[0] == one[1] and len(one[0]) == 6 and "2024-01-02 or so" in one[0][3][2]


def test_streamed_states_cost_calls_by_bucket_not_by_upload(spark, tmp_root):
    import datetime as dt

    from cdmspark.operators import statemachine as SM
    from cdmspark.sources import sinks as SK
    from cdmspark.streaming import states as SS
    rows = [(f"u{k % 40}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=k // 20), k, SM.STEPS[(k * 7 + k // 40) % 4]) for k in range(400)]
    rows.append(("u0", dt.datetime(2026, 1, 1, 5), None, "upload"))
    df = spark.createDataFrame(rows, "upload_id string, ts timestamp, event_id long, step string")
    for part in (F.col("ts") < "2026-01-01 10:00:00", F.col("ts") >= "2026-01-01 10:00:00"):
        SK.append(df.filter(part), f"{tmp_root}/in")
        SS.strict_states_stream(spark, f"{tmp_root}/in", f"{tmp_root}/out", f"{tmp_root}/ck", df.schema, "2 hours", buckets=3)
    state = spark.read.format("statestore").option("path", f"{tmp_root}/ck").option("stateVarName", "settled").load()
    assert 0 < state.select("key").distinct().count() <= 3
    want = SM.strict_states(df.fillna(SS.LAST, ["event_id"])).select("upload_id", "state", "illegal_steps", "n_steps")
    got = SS.latest_states(spark, f"{tmp_root}/out")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
