"""The stored index against the plan over all texts, in one batch and in several."""

import random

import pytest

from cdmspark.operators import retrieve as RT
from cdmspark.operators import textindex as TX
from cdmspark.sources import sinks as SK
from cdmspark.streaming import jobs as ST


def _texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for k in range(n)]


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def _want(docs, queries, k=3):
    return _rows(RT.topk_sparse(*RT.tfidf(RT.prose_terms(docs, "id", "text"), RT.prose_terms(queries, "id", "text")), k=k))


def test_batches_of_an_index_equal_the_whole(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(TX, "BLOCK_DOCS", 5)
    docs = spark.createDataFrame(_texts(240, 1), "id long, text string")
    queries = spark.createDataFrame([(1000 + k, t + " unseen") for k, t in _texts(12, 2)], "id long, text string")
    terms, asked = RT.prose_terms(docs, "id", "text"), RT.prose_terms(queries, "id", "text")
    index = TX.TextIndex(spark, tmp_root)
    assert index.publish().search(asked).count() == 0
    index.add(terms.filter("id < 100"), 0)
    assert _rows(index.publish().search(asked)) == _want(docs.filter("id < 100"), queries)
    index.add(terms.filter("id between 60 and 170"), 1)
    index.add(terms.filter("id between 60 and 170"), 1)  # the batch runs again
    index.add(terms.filter("id > 90"), 2)
    found = index.publish()
    assert _rows(found.search(asked)) == _want(docs, queries)
    assert _rows(index.publish().search(asked, k=300)) == _want(docs, queries, 300)
    # blocks are really left out
    w = found.weights(asked)
    bounds = found.bounds(w)
    scores = {(r.query_id, r.doc_id): r.score for r in found.search(asked, 300).collect()}
    top = {}
    for (q, _), s in sorted(scores.items(), key=lambda x: -x[1]):
        top.setdefault(q, []).append(s)
    reached = [r for r in bounds.collect() if len(top.get(r.query_id, [])) >= 3 and r.bound < top[r.query_id][2]]
    assert reached
    for r in bounds.join(found.postings.select("doc_id", "batch", "block").distinct(), ["batch", "block"]).collect():
        assert scores.get((r.query_id, r.doc_id), 0) <= r.bound + 1e-9


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_root, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "id long, text string")
    index = TX.TextIndex(spark, tmp_root)
    index.add(RT.prose_terms(docs.filter("id = 1"), "id", "text"), 0)
    monkeypatch.setattr(TX, "append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.add(RT.prose_terms(docs, "id", "text"), 1)
    monkeypatch.undo()
    asked = RT.prose_terms(docs, "id", "text")
    assert {r.doc_id for r in index.publish().search(asked).collect()} == {1}
    index.add(RT.prose_terms(docs, "id", "text"), 1)
    assert {r.doc_id for r in index.publish().search(asked).collect()} == {1, 2}


def test_arriving_documents(spark, tmp_root):
    docs = spark.createDataFrame([(k, t) for k, t in _texts(60, 5)], "doc_id long, text string")
    index = TX.TextIndex(spark, f"{tmp_root}/index")
    for k in range(2):
        SK.append(docs.filter(f"doc_id % 2 = {k} or doc_id < 10"), f"{tmp_root}/in")
        ST.index_documents(spark, f"{tmp_root}/in", index, f"{tmp_root}/ck", docs.schema)
    asked = spark.createDataFrame([(9, "w0 w3 w7"), (8, "")], "id long, text string")
    whole = docs.withColumnRenamed("doc_id", "id")
    assert _rows(index.publish().search(RT.prose_terms(asked, "id", "text"))) == _want(whole, asked)
