"""Exact top-k (sparse with bound pruning, dense by blocks) against brute force."""

import math
import random

from pyspark.sql import functions as F

from cdmspark.functions.local import values_frame
from cdmspark.operators import dense as DN
from cdmspark.operators import retrieve as RT

WORDS = ["the", "and", "of", "sales", "revenue", "store", "date", "unit", "price", "cost",
         "margin", "region", "channel", "sku", "brand", "net", "gross", "week", "order", "item"]


def _brute_sparse(cw, qw, k):
    s = (qw.select(F.col("id").alias("query_id"), "term", F.col("w").alias("a"))
         .join(cw.select(F.col("id").alias("doc_id"), "term", F.col("w").alias("b")), "term")
         .groupBy("query_id", "doc_id").agg(F.sum(F.col("a") * F.col("b")).alias("score")))
    return RT.rank_top(s, k)


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())


def test_sparse_topk_equals_brute_force(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 30)))) for i in range(300)]
    qs = [(100 + i, " ".join(rnd.choice(WORDS) for _ in range(5))) for i in range(20)]
    d = values_frame(spark, docs, "id long, text string")
    q = values_frame(spark, qs, "id long, text string")
    cw, qw, st = RT.tfidf(RT.prose_terms(d, "id", "text"), RT.prose_terms(q, "id", "text"))
    ref = _rows(_brute_sparse(cw, qw, 3))
    for common in (2, 50, 10_000):  # nearly all common / mixed / all rare
        assert _rows(RT.topk_sparse(cw, qw, st, k=3, common_df=common)) == ref


def test_dense_topk_equals_brute_force(spark):
    rnd = random.Random(5)
    vecs = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    v = values_frame(spark, vecs, "id long, vec array<float>")
    got = _rows(DN.topk_dense(v, v, k=3, exclude_self=True))
    unit = {i: [x / math.sqrt(sum(y * y for y in vec)) for x in vec] for i, vec in vecs}
    # brute force in Python over float32 inputs
    import numpy as np
    ids = sorted(unit)
    m = np.array([np.array(vecs[i][1], dtype=np.float32).astype(np.float64) for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    ref = []
    for a, qa in enumerate(ids):
        order = sorted((-round(sims[a, b], 9), ids[b]) for b in range(len(ids)) if b != a)[:3]
        ref += [(qa, r + 1, db) for r, (_, db) in enumerate(order)]
    assert got == sorted(ref)


def test_neighbour_ids(spark):
    top = values_frame(spark, [("u1", "m2", 0.5, 2), ("u1", "m1", 0.9, 1)],
                       "query_id string, doc_id string, score double, rank int")
    r = RT.neighbour_ids(top).collect()[0]
    assert r["similar_ids"] == ["m1", "m2"] and r["similar_mapping_ids"] == '["m1","m2"]'
    assert r["similar_mappings_used"] == 2


def test_blocks_and_quantised_vectors(spark, monkeypatch):
    """More blocks change nothing; scores of the approximate result are exact, its recall is stated."""
    rnd = random.Random(9)
    centre = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vecs = [(i, [x + rnd.gauss(0, 0.2) for x in centre[i % 12 if i % 3 else 0]]) for i in range(600)]
    v = spark.createDataFrame(vecs, "id long, vec array<float>")
    exact = DN.topk_dense(v, v, k=3, exclude_self=True)
    want = _rows(exact)
    score = {(r["query_id"], r["doc_id"]): r["score"] for r in DN.topk_dense(v, v, k=600).collect()}
    monkeypatch.setattr(DN, "BLOCK", 50)
    monkeypatch.setattr(DN, "CELLS", 300)
    assert _rows(DN.topk_dense(v, v, k=3, exclude_self=True)) == want
    approx = DN.approx_dense(v, v, k=3, exclude_self=True)
    got = approx.collect()
    assert all(abs(r["score"] - score[r["query_id"], r["doc_id"]]) < 1e-9 for r in got)
    assert RT.recall(exact, approx).collect()[0]["recall"] > 0.9
    index = DN.QuantisedIndex(v, v, 3, exclude_self=True)
    assert 3 <= index.depth <= 100 and index.codes.filter("length(code) <> 16").isEmpty()
    empty = v.limit(0)
    assert DN.topk_dense(empty, v).count() == 0 == DN.approx_dense(empty, v).count()


def test_recall_on_the_given_embeddings(spark):
    from cdmspark.plans.catalog import lsh_recall
    from tests.conftest import SF_MID
    got = lsh_recall(spark, SF_MID).collect()[0]
    assert got["n_exact"] == 1500 and got["recall"] >= 0.9 and got["bytes_share"] <= 0.1


def test_codes_sum_like_distance_tables():
    """A product with the decoded vector is the sum of the products with the code's centroids."""
    import numpy as np
    rng = np.random.default_rng(1)
    x = DN.unit(rng.normal(size=(700, 30)))
    books = DN.Codebooks(x, codes=8, steps=4)
    codes = books.encode(x)
    assert codes.shape == (700, 8) and books.width == 4
    q = np.zeros(32)
    q[:30] = rng.normal(size=30)
    tables = [books.books[j] @ q[4 * j:4 * j + 4] for j in range(8)]
    by_table = sum(t[codes[:, j]] for j, t in enumerate(tables))
    assert np.allclose(books.decode(codes) @ q[:30], by_table, atol=1e-5)
    assert ((books.decode(codes) - x) ** 2).sum(1).mean() < 0.5


def test_copies_of_one_vector_do_not_deepen_the_rerank(spark):
    rnd = random.Random(3)
    one = [rnd.gauss(0, 1) for _ in range(16)]
    vecs = [(i, one if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(16)]) for i in range(900)]
    v = spark.createDataFrame(vecs, "id long, vec array<float>")
    assert DN.QuantisedIndex(v, v, 3, exclude_self=True).depth <= 40


def test_odd_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])], "id long, vec array<float>")
    want = {(1, 2), (2, 3), (3, 2), (4, 1)}
    assert {(r.query_id, r.doc_id) for r in DN.topk_dense(v, v, 1, True).collect()} == want
    assert {(r.query_id, r.doc_id) for r in DN.approx_dense(v, v, 3, True).filter("rank = 1").collect()} == want


def test_minhash_recall_on_the_given_texts(spark):
    from cdmspark.plans.catalog import similar_documents_minhash
    from tests.conftest import SF_MID

    def sets(name, key):
        terms = RT.prose_terms(spark.read.parquet(f"{SF_MID}/{name}.parquet"), key, "text")
        return {r["id"]: set(r["t"]) for r in terms.groupBy("id").agg(F.collect_set("term").alias("t")).collect()}

    docs, found = sets("documents", "doc_id"), {}
    for r in similar_documents_minhash(spark, SF_MID).collect():
        found.setdefault(r["query_id"], set()).add(r["doc_id"])
    hits = []
    for q, terms in sets("benchmark", "item_id").items():
        exact = sorted(docs, key=lambda d: (-len(terms & docs[d]) / len(terms | docs[d]), d))[:3]
        hits += [d in found.get(q, ()) for d in exact]
    assert len(hits) == 120 and sum(hits) >= 0.9 * len(hits)


def test_copies_count_and_expand(spark):
    docs = [(f"m{i:02d}", "sku date" if i % 2 else "sku price region") for i in range(20)] + [("m99", "channel")]
    qs = [(1, "sku date"), (2, "channel region"), (3, "nothing alike")]
    d = spark.createDataFrame(docs, "id string, text string")
    q = spark.createDataFrame(qs, "id long, text string")
    want = _rows(RT.topk_sparse(*RT.tfidf(RT.prose_terms(d, "id", "text"), RT.prose_terms(q, "id", "text")), k=3))
    texts = d.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    w = RT.tfidf(RT.prose_terms(texts.select(F.col("text").alias("id"), "text"), "id", "text"),
                 RT.prose_terms(q, "id", "text"), texts.select(F.col("text").alias("id"), "n"))
    top = RT.expand_copies(RT.topk_sparse(*w, k=3), d.select(F.col("text").alias("doc_id"), "id"), 3)
    assert _rows(top) == want
    every = RT.with_all_queries(top, q.select(F.col("id").alias("query_id"))).collect()
    assert [r["doc_id"] for r in every if r["query_id"] == 3] == [None]
    assert RT.neighbour_ids(RT.with_all_queries(top, q.select(F.col("id").alias("query_id")))).filter(
        "query_id = 3").collect()[0]["similar_ids"] == []


def test_every_candidate_pair_finds_its_field(spark):
    """M6 on a chain where each round settles one pair."""
    from cdmspark.operators import propose as PR
    n = 9
    rows = [("u", f"c{i}", i, f"f{j}", f"{j:03d}", 0.9 - 0.01 * i - 0.005 * (j != i)) for i in range(n) for j in range(i + 1)
            if j in (i, i - 1)]
    rows += [("u", f"c{i}", i, f"f{i - 1}", f"{i - 1:03d}", 0.95 - 0.01 * i) for i in range(1, n)]
    s = spark.createDataFrame(rows, "upload_id string, column_name string, ordinal int, cdm_field string, field_id string, score double")
    got = {(r["column_name"], r["cdm_field"]) for r in PR.assign_mutual_best(s).collect()}
    used_c, used_f, want = set(), set(), set()
    for _, c, o, f, fid, sc in sorted(rows, key=lambda r: (-r[5], r[2], r[4])):
        if c not in used_c and f not in used_f:
            want.add((c, f)); used_c.add(c); used_f.add(f)  # noqa: E702
    assert got == want
    assert PR.assign_mutual_best(s.limit(0)).count() == 0
