"""M7, M8, M12-M14, W7, W8 on hand-written documents."""

import json

from pyspark.sql import functions as F

from cdmspark.functions.exprs import confidence_band, confidence_percent, status_label
from cdmspark.functions.local import values_frame
from cdmspark.operators import mapping_doc as MD

DOC = {"mappings": [{"source_column": "a", "cdm_field": "revenue", "transformation": None,
                     "confidence": 0.9, "reasoning": "r"},
                    {"source_column": "b", "cdm_field": None, "transformation": None,
                     "confidence": 0.2, "reasoning": "r"}],
       "overall_confidence": 0.87, "unmapped_cdm_fields": ["date"], "notes": "n"}


def test_reply_parsing(spark):
    text = json.dumps(DOC)
    nocof = json.dumps({k: v for k, v in DOC.items() if k != "overall_confidence"})
    replies = values_frame(spark, [(1, text), (2, "```json\n" + text + "\n```"),
                                   (3, "```\n" + text + "\n```"), (4, text[:30]),
                                   (5, "  " + nocof + "\n"), (6, "[1, 2]")],
                           "id int, reply_text string")
    out = {r["id"]: r for r in MD.parse_replies(replies).collect()}
    assert all(out[i]["parse_ok"] for i in (1, 2, 3, 5))
    assert out[2]["mapping_json"] == text and out[3]["mapping_json"] == text
    assert not out[4]["parse_ok"] and out[4]["parse_error"].startswith("invalid JSON")
    assert not out[6]["parse_ok"]
    assert out[1]["doc"]["overall_confidence"] == 0.87
    summ = {r["mapping_id"]: r for r in MD.doc_summary(
        values_frame(spark, [(5, nocof), (9, "{bad")], "mapping_id int, mapping_json string"))
        .collect()}
    assert summ[5]["overall_confidence"] == 0.0 and summ[5]["n_entries"] == 2
    assert summ[5]["n_mapped"] == 1 and summ[9]["n_entries"] == 0


def test_bands_at_edges(spark):
    df = values_frame(spark, [(0.9,), (0.8999,), (0.7,), (0.6999,), (0.875,)], "s double")
    got = [(r[0], r[1]) for r in df.select(confidence_band(F.col("s")),
                                           confidence_percent(F.col("s"))).collect()]
    assert got == [("high", 90), ("medium", 90), ("medium", 70), ("low", 70), ("medium", 88)]


def test_status_labels(spark):
    df = values_frame(spark, [("PENDING",), ("APPROVED",), ("INGESTED",), (None,)], "s string")
    assert [r[0] for r in df.select(status_label(F.col("s"))).collect()] == [
        "Pending Review", "Approved", "Pending Mapping", "Pending Mapping"]


def test_final_mapping_and_edit_history(spark):
    orig = json.dumps(DOC)
    edited = json.loads(orig)
    edited["mappings"][1]["cdm_field"] = "discount"
    rv = values_frame(spark, [("r1", "m1", orig, json.dumps(edited)), ("r2", "m2", orig, "")],
                      "review_id string, mapping_id string, proposed_mapping_json string, "
                      "final string")
    rv = rv.withColumn("final_mapping_json",
                       MD.final_mapping(F.col("final"), F.col("proposed_mapping_json")))
    hist = MD.edit_history(rv).collect()
    assert len(hist) == 1 and hist[0]["source_column"] == "b"
    assert hist[0]["field_before"] is None and hist[0]["field_after"] == "discount"


def test_unmapped_fields(spark):
    from cdmspark.operators.registry import cdm_seed
    import datetime as dt
    cdm = cdm_seed(spark, dt.datetime(2026, 1, 1))
    m = values_frame(spark, [("m1", json.dumps(DOC))], "mapping_id string, mapping_json string")
    r = MD.unmapped_fields(m, cdm).collect()[0]
    assert r["n_unmapped"] == 16 and "revenue" not in r["unmapped_cdm_fields"]


def test_labels_of_lists(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    from cdmspark.functions import exprs as X
    df = spark.createDataFrame([(dt.datetime(2026, 1, 5, 15, 4), "0123456789", n) for n in (5, 2048, 3 * 1024 * 1024)],
                               "t timestamp_ntz, i string, n long")
    rows = df.orderBy("n").select(X.date_label(F.col("t")), X.id_prefix(F.col("i")), X.file_size_label(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("Jan 5, 2026, 03:04 PM", "01234567", x) for x in ("5 B", "2.0 KB", "3.0 MB")]


def test_tables_of_documents_are_not_broadcast(spark, tmp_root):
    from cdmspark.operators import retrieve as RT
    from cdmspark.operators import workflow as W
    def stored(name, ddl, row):
        spark.createDataFrame([row] * 3, ddl).write.parquet(f"{tmp_root}/{name}")
        return spark.read.parquet(f"{tmp_root}/{name}")
    reviews = stored("r", "review_id string, mapping_id string, upload_id string", ("R", "M", "U"))
    maps = stored("m", "mapping_id string, mapping_json string, confidence_score double, customer_id string, source_schema string, "
                       "cdm_mapping string", ("M", "{}" * 1000, 0.5, "C", "{}", "{}"))
    ups = stored("u", "upload_id string, file_name string, customer_id string, schema_json string", ("U", "f", "C", "{}" * 500))
    done = W.completed_reviews(reviews, maps, ups)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and done.count() == 27
    top = stored("t", "query_id string, doc_id string, score double, rank int", ("Q", "M", 1.0, 1)).limit(1)
    near = RT.neighbour_rows(top, maps)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1 and near.count() == 3
