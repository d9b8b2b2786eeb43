import random

import numpy as np

from cdmspark.llm.common import table
from cdmspark.llm.quality import co_train, fit, logistic, op9_quality, scores
from tests.conftest import SF_MID


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF_MID, "labels").collect()}
    rows = op9_quality(spark, SF_MID).collect()
    assert len(rows) == table(spark, SF_MID, "documents").count()
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) == bool(r.predicted) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_logistic_is_at_the_minimum():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 2))
    y = (x[:, 0] + rnd.normal(size=300) > 0).astype(float)
    w = logistic(x, y, 0.01)

    def loss(w):
        z = w[0] + x @ w[1:]
        return np.sum(np.log1p(np.exp(z)) - y * z) + 0.5 * 0.01 * 300 * (w[1:] ** 2).sum()

    assert all(loss(w) <= loss(w + d) for d in rnd.normal(scale=0.01, size=(50, 3)))


def test_views_teach_each_other():
    """With labels of few rows, the pool helps the view that sees little of them."""
    rnd = np.random.default_rng(2)
    y = rnd.integers(0, 2, 3000).astype(float)
    text = np.column_stack([y * 4 + rnd.normal(size=3000)])
    meta = np.column_stack([(2 * y - 1)[:, None] * 0.3 + rnd.normal(size=(3000, 12))])
    few = np.arange(40)
    model = co_train(text[few], meta[few], y[few], few % 4 == 0, text[40:], meta[40:])
    alone = co_train(text[few], meta[few], y[few], few % 4 == 0, text[:0], meta[:0])
    right = [np.mean((m.score(text[40:], meta[40:])[2] >= 0.5) == y[40:]) for m in (model, alone)]
    assert right[0] > right[1] and np.mean((model.score(text[40:], meta[40:])[0] >= 0.5) == y[40:]) > 0.95


def test_odd_rows_and_labels(spark):
    rnd = random.Random(4)
    good = [(i, " ".join(rnd.choice(["plain", "words", "of", "some", "text"]) + str(rnd.randrange(99)) for _ in range(40)), "en", "a", 9)
            for i in range(60)]
    bad = [(i + 60, "BUY!! " * 30, None, None, None) for i in range(60)]
    odd = [(None, None, None, None, None), (500, "", "en", "a", 0), (501, "w " * 300_000, "x", "y", 10 ** 9), (501, "BUY!! " * 30, "x", "y", 2)]
    docs = spark.createDataFrame([(*r, 0.0) for r in good + bad + odd],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (7, None), (900, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = docs.select("doc_id", scores(model).alias("s")).collect()
    assert len(got) == 124 and all(r.s.score is not None for r in got)
    assert all((r.s.score >= 0.5) == (r.doc_id < 60) for r in got if r.doc_id is not None and r.doc_id < 120)
    assert [r.s.score < 0.5 for r in got][-1]
    for few in (labels.limit(0), labels.filter("quality = 1")):
        p = {r.s.score for r in docs.select(scores(fit(docs, few)).alias("s")).collect()}
        assert len(p) == 1
    assert docs.limit(0).select(scores(model)).count() == 0


def test_all_unlabelled_rows_teach(spark):
    """Sums over Spark rows give the model of the same rows in memory, and every unlabelled row counts."""
    from cdmspark.llm import quality
    rnd = np.random.default_rng(3)
    y = rnd.integers(0, 2, 12_100).astype(float)
    text, meta = (y[:, None] * 4 + rnd.normal(size=(len(y), 2)) for _ in range(2))
    lab = np.arange(100)
    pool = spark.createDataFrame([(a, b) for a, b in zip(text[100:].tolist(), meta[100:].tolist())],
                                 "text array<double>, meta array<double>").repartition(5)
    model = quality.co_train_over(text[lab], meta[lab], y[lab], lab % 4 == 0, quality.sums_over(pool))
    want = co_train(text[lab], meta[lab], y[lab], lab % 4 == 0, text[100:], meta[100:])
    assert np.allclose(model.text.w, want.text.w, atol=1e-6) and np.allclose(model.both, want.both, atol=1e-6)
    assert quality.sums_over(pool)(lambda a, b: np.array([len(a), a.sum()]), 2)[0] == 12_000
    # a last row that the metadata view is sure of moves the text view
    odd = co_train(text[lab], meta[lab], y[lab], lab % 4 == 0, np.vstack([text[100:], [[40.0, -40.0]]]), np.vstack([meta[100:], [[4.0, 4.0]]]))
    assert np.abs(odd.text.w - want.text.w).max() > 1e-6
