"""Quality classifier by co-training: a text view and a page-metadata view label for each other.

The text view sees counts over the whole text (repetition, symbols, case, lines, lengths); the
metadata view sees language, source and stated length. Both are logistic regressions. Of the labelled
training rows (about ``TRAIN_ROWS``, chosen by a hash of doc_id) a fifth calibrates; the rest trains.
In each of ``ROUNDS`` rounds, each view labels all unlabelled rows, and where its calibrated probability
is ``SURE`` or more, the row becomes a training row of the other view (its first such label stays). The
unlabelled rows stay in Spark: a view is fitted from sums over them (moments, then gradient and Hessian
of each Newton step); together they weigh as much as its labelled rows at most. In the end each view is calibrated by a line on its log odds, a regression on both
calibrated log odds combines them, and every document is scored.

The fold of crc32(doc_id) mod 5 = 0 is held out: its labels are never learned from, and unlabelled rows
give texts and metadata only. What reaches the driver is a bounded table of labelled features and sums.

Defined results: null texts count as empty, null metadata as values of their own; every row is scored,
repeats included; without labels, or with one kind only, every score is the share of quality 1 (0.5
without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, store, table, whole_text

TRAIN_ROWS, ROUNDS, SURE, BUCKETS = 20_000, 3, 0.95, 32
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_LONE = [bytes([b]) for b in _SYMBOL]
_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}(?=\s|\Z)")


def text_features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    letters = max(1, n - len(words))
    lines = raw.split(b"\n")
    counts = Counter(words)
    often = max(counts.values(), default=0)
    return [
        sum(map(eq, words, words[1:])) / m,
        (len(counts) / m) * math.log(m + 1) / 7,
        often / m,
        (len(raw) - len(raw.translate(None, _UPPER))) / letters,
        (len(raw) - len(raw.translate(None, _SYMBOL))) / letters,
        (len(raw) - len(raw.translate(None, _DIGIT))) / letters,
        len(_RUN.findall(raw)) / m,
        sum(counts[w] for w in _LONE if w in counts) / m,
        len(raw.translate(None, b" \t\r\n")) / m / 10,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(words)) / 10,
        float(not words),
    ]


def meta_features(lang, source, n_chars) -> list[float]:
    out = [0.0] * (2 * BUCKETS + 3)
    for k, v in enumerate((lang, source)):
        out[k * BUCKETS + zlib.crc32(repr(None if v is None or v != v else str(v)).encode()) % BUCKETS] = 1.0
    known = n_chars is not None and n_chars == n_chars
    size = math.log1p(max(0.0, float(n_chars))) / 10 if known else 0.0
    out[-3:] = [size, size * size, float(not known)]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (intercept first) by Newton steps on ridge-penalised log loss."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-9, np.full(x.shape[1] - 1, ridge)] * len(x)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


class View:
    """One view: standardised features, weights, and a calibration of its log odds."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, held: np.ndarray, held_y: np.ndarray):
        self.mean, self.scale, self.w = mean, scale, w
        self.line = np.array([0.0, 1.0])
        if len(held_y) and held_y.min() != held_y.max():
            self.line = logistic(self.odds(held)[:, None], held_y, 1e-4)

    def _std(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of quality 1."""
        z = self.w[0] + self._std(x) @ self.w[1:]
        return np.clip(self.line[0] + self.line[1] * np.clip(z, -30, 30), -20, 20)


def _prob(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


class CoTrained:
    def __init__(self, text: View | None, meta: View | None, both: np.ndarray):
        self.text, self.meta, self.both = text, meta, both

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            p = np.full(len(text_x), _prob(self.both[0]))
            return p, p, p
        a, b = self.text.odds(text_x), self.meta.odds(meta_x)
        return _prob(np.clip(self.both[0] + self.both[1] * a + self.both[2] * b, -30, 30)), _prob(a), _prob(b)


def _given(history: list[list[View]], xs: list[np.ndarray]) -> list[np.ndarray]:
    """Per view the labels it got from the other view's rounds so far, -1 for none."""
    got = [np.full(len(x), -1) for x in xs]
    for views in history:
        for me in (0, 1):
            p, other = _prob(views[me].odds(xs[me])), got[1 - me]
            free = other < 0
            other[free & (p >= SURE)] = 1
            other[free & (1 - p >= SURE)] = 0
    return got


def _fit_views(own: list, held: list, over: Callable, history: list[list[View]]) -> list[View]:
    """Both views from their labelled rows ``own`` and all rows the other view is sure of, which together
    weigh as much as the labelled ones at most. ``over(f, n)`` sums the vectors f(text, meta) of length n
    over the unlabelled rows."""
    weight = [1.0, 1.0]

    def total(part: Callable) -> list[np.ndarray]:
        """Per view the sum of part(view, x, y) over labelled and sure rows."""
        first = [part(me, *own[me]) for me in (0, 1)]
        if not history:
            return first

        def chunk(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
            xs = [text, meta]
            return np.concatenate([part(me, xs[me][y >= 0], y[y >= 0]) for me, y in enumerate(_given(history, xs))])

        more = over(chunk, sum(map(len, first)))
        more = [more[:len(first[0])], more[len(first[0]):]]
        if part is moments:
            weight[:] = [min(1.0, a[0] / max(1.0, b[0])) for a, b in zip(first, more)]
        return [a + k * b for a, k, b in zip(first, weight, more)]

    origin = [x.mean(0) for x, _ in own]

    def moments(me: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.r_[len(x), (x - origin[me]).sum(0), ((x - origin[me]) ** 2).sum(0)]

    found = total(moments)
    n = [m[0] for m in found]
    off = [m[1:1 + len(o)] / m[0] for m, o in zip(found, origin)]
    std = [np.sqrt(np.maximum(0, m[1 + len(o):] / m[0] - d * d)) for m, o, d in zip(found, origin, off)]
    mean, scale = [o + d for o, d in zip(origin, off)], [np.where(s > 1e-9, s, 1.0) for s in std]
    w = [np.zeros(len(o) + 1) for o in origin]
    for _ in range(30):
        def slopes(me: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(x)), _standard(x, mean[me], scale[me])])
            p = 1 / (1 + np.exp(-np.clip(x @ w[me], -30, 30)))
            return np.r_[x.T @ (y - p), ((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel()]

        size = 0.0
        for me, sums in enumerate(total(slopes)):
            d = len(w[me])
            penalty = np.r_[1e-9, np.full(d - 1, 1e-3)] * n[me]
            step = np.linalg.solve(sums[d:].reshape(d, d) + np.diag(penalty), sums[:d] - penalty * w[me])
            w[me], size = w[me] + step, max(size, np.abs(step).max())
        if size < 1e-6:
            break
    return [View(mean[me], scale[me], w[me], *held[me]) for me in (0, 1)]


def co_train(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, held: np.ndarray, pool_text: np.ndarray,
             pool_meta: np.ndarray) -> CoTrained:
    """``co_train_over`` with the unlabelled rows in memory."""
    return co_train_over(text_x, meta_x, y, held, lambda f, n: f(pool_text, pool_meta))


def co_train_over(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, held: np.ndarray, over: Callable) -> CoTrained:
    """``held`` marks the labelled rows that calibrate; ``over`` as in ``_fit_views``."""
    if not len(y) or y.min() == y.max() or y[~held].min(initial=1) == y[~held].max(initial=0):
        share = min(1 - 1e-9, max(1e-9, float(y.mean()))) if len(y) else 0.5
        return CoTrained(None, None, np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    own, kept = [(x[~held], y[~held]) for x in (text_x, meta_x)], [(x[held], y[held]) for x in (text_x, meta_x)]
    history: list[list[View]] = []
    for _ in range(ROUNDS + 1):
        history.append(_fit_views(own, kept, over, list(history)))
    views = history[-1]
    odds = np.column_stack([v.odds(x) for v, (x, _) in zip(views, kept)])
    both = logistic(odds, y[held], 1e-3) if len(set(y[held].tolist())) > 1 else np.array([0.0, 1.0, 0.0])
    return CoTrained(views[0], views[1], both)


def sums_over(features: DataFrame) -> Callable:
    """``over`` of rows (text, meta) in Spark: a vector per task, added by place."""
    def over(f: Callable, n: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for b in batches:
                if b.num_rows:
                    total = total + f(*(np.asarray(c.flatten()).reshape(b.num_rows, -1) for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        places = features.select("text", "meta").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x"))
        got = places.groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(n)
        out[got["i"].to_numpy(int)] = got["x"].to_numpy(float)
        return out

    return over


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views of rows (text, lang, source, n_chars)."""
    text = np.array([text_features(t) for t in rows["text"]], float).reshape(len(rows), -1)
    meta = np.array([meta_features(*r) for r in zip(rows["lang"], rows["source"], rows["n_chars"])], float)
    return text, meta.reshape(len(rows), -1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(ids: DataFrame, rows: int, n: int) -> DataFrame:
    if n <= rows:
        return ids
    return ids.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < int((1 << 40) * rows / n))


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Learn from ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality)."""
    every = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int").alias("y")).filter(
        F.col("y").isin(0, 1)).groupBy("__id").agg(F.min("y").alias("y"))
    train = every.filter(~held_out(F.col("__id")))
    train = _sample(train, TRAIN_ROWS, train.count())
    keyed = docs.withColumn("__id", F.col("doc_id").cast("bigint"))

    @F.pandas_udf("text array<double>, meta array<double>")
    def measure(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        a, b = _matrix(pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars}))
        return pd.DataFrame({"text": list(a), "meta": list(b)})

    features = store(keyed.select("__id", measure(*_inputs()).alias("f")).select("__id", "f.*"), "quality")
    # ids and labels of a bounded sample are broadcast
    got = features.join(F.broadcast(train), "__id").select(
        "y", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(5)).alias("fold"), F.xxhash64("__id").alias("order"), "text", "meta").toPandas()
    got = got.sort_values(["order", "y"], kind="stable")
    text = np.array(got["text"].tolist(), float).reshape(len(got), -1 if len(got) else 1)
    meta = np.array(got["meta"].tolist(), float).reshape(len(got), -1 if len(got) else 1)
    loose = store(features.join(every, "__id", "left_anti").select("text", "meta"), "quality-pool")
    return co_train_over(text, meta, got["y"].to_numpy(float), got["fold"].to_numpy() == 0, sums_over(loose))


def _inputs() -> list[Column]:
    return [whole_text(), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double")]


def scores(model: CoTrained) -> Column:
    """struct(score, text_score, meta_score) of columns text, lang, source, n_chars."""
    @F.pandas_udf("score double, text_score double, meta_score double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in batches:
            a, b = _matrix(pd.DataFrame({"text": text, "lang": lang, "source": source, "n_chars": n_chars}))
            yield pd.DataFrame(dict(zip(("score", "text_score", "meta_score"), model.score(a, b))))

    return run(*_inputs())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(model).alias("s"))
    return scored.select("doc_id", "held_out", "s.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "keep", F.col("score") >= 0.5)
