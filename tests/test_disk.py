"""Steps whose files must not pile up: shuffles of finished writes, lines, distinct values, uploads and loads."""

import time

from pyspark.sql import functions as F

from cdmspark.functions import materialize as M
from cdmspark.operators import profile as P
from cdmspark.sources import testdata as TD


def _shuffles(spark) -> set:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def _none_left(spark, before: set) -> bool:
    for _ in range(50):
        if not _shuffles(spark) - before:
            return True
        time.sleep(0.2)
    return False


def test_a_stored_table_leaves_no_shuffle(spark):
    before, kept = _shuffles(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    got = M.materialize_all([df, df])
    assert _none_left(spark, before)
    assert sorted(r["count"] for r in got.collect()) == sorted(2 * [r["count"] for r in df.collect()])
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == kept


def _tables(spark, root: str) -> None:
    tables = {
        "region": [("r_regionkey", 1), ("r_name", "'EAST'")], "nation": [("n_nationkey", 1), ("n_regionkey", 1)],
        "supplier": [("s_suppkey", 10), ("s_nationkey", 1)], "customer": [("c_custkey", 7), ("c_name", "'C'")],
        "part": [("p_partkey", 3), ("p_name", "'P'"), ("p_type", "cast(null as string)"), ("p_retailprice", "2.5D")],
        "orders": [("o_orderkey", "nullif(id div 2, 9)"), ("o_custkey", 7), ("o_orderpriority", "'LOW'")],
        "lineitem": [("l_orderkey", "nullif(id div 3, 4)"), ("l_linenumber", "int(1 + id % 7)"), ("l_partkey", 3), ("l_suppkey", 10),
                     ("l_quantity", "double(id % 5)"), ("l_extendedprice", "if(id = 8, null, 9.5D * id)"), ("l_discount", "0.1D"),
                     ("l_tax", "0D"), ("l_returnflag", "'N'"), ("l_linestatus", "'O'"),
                     ("l_shipdate", "if(id = 11, null, timestamp_ntz'2024-01-02 00:00:00')")]}
    for t, cols in tables.items():
        spark.range(30 if t in ("orders", "lineitem") else 1).selectExpr(*[f"{e} AS {c}" for c, e in cols]).write.parquet(f"{root}/{t}.parquet")


def _texts(rows) -> list:
    return sorted(str((r.upload_id, r.row_ord, r.vals)) for r in rows.collect())


def test_lines_joined_in_parts_are_the_sales_rows(spark, tmp_root, monkeypatch):
    _tables(spark, tmp_root)
    want = _texts(TD.sales_rows(spark, tmp_root))
    monkeypatch.setattr(TD, "LINES_A_PART", 7)
    seen, whole = [], TD.materialize_all
    monkeypatch.setattr(TD, "materialize_all", lambda parts: (seen.append(len(parts)), whole(parts))[1])
    before = _shuffles(spark)
    got = TD.landed_rows(spark, tmp_root)
    assert seen == [4] and _none_left(spark, before)
    assert _texts(got) == want and len(want) > 40  # orders come twice, some keys are null
    assert not any(c.startswith("cell_") for c in TD.landed_lines(spark, tmp_root).columns)


def test_distinct_values_are_counted_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([("u", k, [str(k % 5), "0" if k % 2 else "-0.0", None, "" if k else "x"]) for k in range(40)]
                                 + [("v", 1, ["NaN", "7", "07", "a"]), ("v", 2, ["n/a", "7.0", "7", "b"])],
                                 "upload_id string, row_ord long, vals array<string>")
    numbers = spark.createDataFrame([("u", 2), ("v", 2), ("v", 3)], "upload_id string, ordinal int")
    one = [sorted(tuple(r) for r in P.unique_counts(rows, n).collect()) for n in (None, numbers)]
    monkeypatch.setattr(P, "ROWS_A_PART", 10)
    before = _shuffles(spark)
    got = [P.unique_counts(rows, n) for n in (None, numbers)]
    assert _none_left(spark, before)
    assert [sorted(tuple(r) for r in g.collect()) for g in got] == one
    assert one[0][:2] == [("u", 1, 5), ("u", 2, 2)] and ("u", 2, 1) in one[1] and ("v", 3, 1) in one[1]


def test_two_proposers_share_one_profile(spark, monkeypatch):
    from cdmspark.plans import catalog as CAT
    prof, seen = spark.range(1), []
    none = spark.createDataFrame([], "upload_id string, source_column string, cdm_field string")
    monkeypatch.setattr(CAT, "_typed_profile", lambda *a: (seen.append("profile"), prof)[1])
    monkeypatch.setattr(CAT, "_loo_proposals", lambda s, sf, p=None: (seen.append(p), none)[1])
    monkeypatch.setattr(CAT.PR, "proposals", lambda *a, **k: none)
    CAT.proposer_comparison(spark, "/root/testdata/sf0.001")
    assert seen == ["profile", prof]


def test_samples_of_stored_rows_are_the_first_rows(spark):
    rows = spark.createDataFrame([(f"u{k % 2}", k, [str(k)]) for k in range(500)], "upload_id string, row_ord long, vals array<string>")
    heads = spark.createDataFrame([("u0", ["a"]), ("u1", ["b"])], "upload_id string, names array<string>")
    got = [sorted(tuple(r) for r in P.sample_rows_json(rows, heads, 3, stored=s).collect()) for s in (False, True)]
    assert got[0] == got[1] == [("u0", '[{"a":"0"},{"a":"2"},{"a":"4"}]'), ("u1", '[{"b":"1"},{"b":"3"},{"b":"5"}]')]


def test_deliveries_are_the_sales_rows(spark, tmp_root, monkeypatch):
    _tables(spark, tmp_root)
    monkeypatch.setattr(TD, "LINES_A_PART", 7)
    before = _shuffles(spark)
    rows, *deliveries = TD.delivered_rows(spark, tmp_root, 3)
    assert _none_left(spark, before)
    assert _texts(rows) == sorted(t for d in deliveries for t in _texts(d)) == _texts(TD.sales_rows(spark, tmp_root))
    assert all(_texts(d) for d in deliveries) and "delivery=" not in str(rows.schema)

    assert all(f.endswith(".zstd.parquet") for f in rows.inputFiles())


def test_uploads_written_in_parts_are_the_same_files(spark, tmp_root):
    import glob
    rows = spark.createDataFrame([(f"u{k % 5}", k, [str(k), 'a "b", c']) for k in range(40)], "upload_id string, row_ord long, vals array<string>")
    heads = spark.createDataFrame([(f"u{k}", "c1", "s1", ["x", "y"]) for k in range(6)],
                                  "upload_id string, customer_id string, source_system string, names array<string>")
    from cdmspark.sources import sinks as SK
    texts, before = [], _shuffles(spark)
    for n in (1, 3):
        SK.write_csv_uploads(rows, heads, f"{tmp_root}/{n}", parts=n)
        found = glob.glob(f"{tmp_root}/{n}/customer_id=c1/source_system=s1/upload_id=*/*.csv")
        assert len(found) == 6
        texts.append({f.split("upload_id=")[1][:2]: open(f).read() for f in found})
    assert texts[0] == texts[1] and texts[0]["u5"] == "x,y\n" and texts[0]["u1"].startswith('x,y\n1,"a ""b"", c"\n6,')
    assert _none_left(spark, before)


def test_parsed_uploads_keep_no_lines(spark, tmp_root, monkeypatch):
    import os

    from cdmspark.sources import csv_uploads as CU
    for name, text in (("a", 'x,y\n1,"2\n3"\n4\n'), ("b", "y\n5\n"), ("c", 'z\n"never\n'), ("d", "\n")):
        with open(f"{tmp_root}/{name}.csv", "w", newline="") as f:
            f.write(text)
    gone, store = [], CU.release
    monkeypatch.setattr(CU, "release", lambda df: (gone.extend(df.inputFiles()), store(df)))
    up = CU.scan_uploads(spark, tmp_root, parsed=True)
    assert gone and not any(os.path.exists(f.removeprefix("file://")) for f in gone)
    names = {r.upload_id: r.names for r in up.headers.collect()}
    assert sorted((names[r.upload_id], r.vals) for r in up.rows.collect()) == [(["x", "y"], ["1", "2\n3"]), (["x", "y"], ["4", None]), (["y"], ["5"])]
    assert sorted(r.error_message for r in up.refused.collect()) == ["a quoted cell never ends", "no columns to read: the file is empty"]


def test_landed_rows_are_gone_before_the_loads_are_compacted(spark, tmp_root, monkeypatch):
    import os

    from cdmspark.plans import changes as CH
    _tables(spark, tmp_root)
    landed, left, land, compact = [], [], TD.landed_rows, CH.SK.compact_sales
    monkeypatch.setattr(TD, "landed_rows", lambda *a: (lambda r: (landed.extend(r.inputFiles()), r)[1])(land(*a)))
    monkeypatch.setattr(CH.SK, "compact_sales", lambda *a: (left.extend(
        f for f in landed if os.path.exists(f.removeprefix("file://"))), compact(*a))[1])
    got = CH.reload_corrected_sales(spark, tmp_root)
    assert landed and not left
    assert got.count() and {r.upload_id[:2] for r in got.select("upload_id").distinct().collect()} >= {"U0", "U1"}


def test_best_of_strips_is_the_best_of_all():
    import numpy as np

    from cdmspark.operators import dense as DN
    rng = np.random.default_rng(5)
    for n, k, digits, kind in ((4000, 3, 9, "f8"), (4000, 3, 2, "f8"), (4000, 20, 5, "f4"), (50, 3, 9, "f8"), (2, 3, 9, "f8")):
        score, di = rng.normal(size=(6, n)).astype(kind), rng.permutation(n)
        score[1, :n // 2], score[2, 0], score[3, 1:] = 7.0, -np.inf, -np.inf
        r, c, s = DN._best(score.copy(), np.arange(6), di, k, digits)
        for q in range(6):
            rounded = np.round(score[q], digits)
            want = sorted((-v, d) for v, d in zip(rounded.tolist(), di.tolist()) if np.isfinite(v))[:k]
            assert [(-v, d) for v, d in zip(s[r == q].tolist(), di[c[r == q]].tolist())] == want


def test_an_index_state_is_worked_out_in_one_pass_over_its_postings(spark, tmp_root, monkeypatch):
    import math

    from cdmspark.operators import retrieve as RT
    from cdmspark.operators import textindex as TX
    texts = {k: " ".join(f"w{k % m}" for m in (2, 3, 5, 7) for _ in range(1 + k % m)) for k in range(90)}
    index = TX.TextIndex(spark, tmp_root)
    for batch in range(2):
        some = spark.createDataFrame([(k, t) for k, t in texts.items() if k % 2 == batch], "id long, text string")
        index.add(RT.prose_terms(some, "id", "text"), batch)
    kind, written = type(spark.range(1).write), []
    put = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda w, path, *a, **k: (written.append(path.rsplit("/", 1)[1]), put(w, path, *a, **k))[1])
    snap = index.publish()
    monkeypatch.undo()
    assert written == ["idf", "weights", "published"]
    tf = {k: {w: t.split().count(w) for w in set(t.split())} for k, t in texts.items()}
    df = {w: sum(w in d for d in tf.values()) for w in {w for d in tf.values() for w in d}}
    norm = {k: math.sqrt(sum((n * (math.log(91 / (df[w] + 1)) + 1)) ** 2 for w, n in d.items())) for k, d in tf.items()}
    assert {r.doc_id: round(r.norm, 9) for r in snap.norms.collect()} == {k: round(v, 9) for k, v in norm.items()}
    block = {(r.term, r.doc_id): (r.batch, r.block) for r in index.postings().collect()}
    most = {}
    for (w, k), at in block.items():
        most[(w, *at)] = max(most.get((w, *at), 0), tf[k][w] / norm[k])
    assert {(r.term, r.batch, r.block): round(r.most, 9) for r in snap.maxima.collect()} == {k: round(v, 9) for k, v in most.items()}
