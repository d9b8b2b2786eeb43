"""HTML main-text extraction: flat blocks, word count and link density of neighbours, a decision tree.

A page is cut into flat text blocks; each block has its own and its neighbours' word count and link
density, and where it stands (inside page furniture, inside an article element, a heading, a list
item). A decision tree (Gini, trained at run time on the small labelled table in ``html_labels``)
marks the blocks of the main text, which are joined in page order.

Defined results: a null or empty page, or one without main text, gives the empty text; truncated and
badly nested markup is read as far as it goes; equal rows give equal texts; other columns of the
input play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .html_blocks import blocks, features
from .html_labels import labelled_table

MAX_DEPTH, MIN_LEAF = 10, 1


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> tuple:
    """A tree of (feature, threshold, at most, above) with shares of label 1 as leaves: the split of
    least Gini impurity, the first feature and lowest threshold among equals."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if min(low.sum(), (~low).sum()) < MIN_LEAF:
                continue
            cost = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return (float(y.mean()),)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def share(tree: tuple, row: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def train() -> tuple:
    x, y = labelled_table()
    return grow(np.array(x), np.array(y, float))


def main_text(page: str, tree: tuple) -> str:
    bs = blocks(page)
    return "\n\n".join(b.text for b, row in zip(bs, features(bs)) if share(tree, row) >= 0.5)


def extract(page: Column, tree: tuple) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return run(F.coalesce(page.cast("string"), F.lit("")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    texts = pages.select("page_id", "url", extract(F.col("html"), train()).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
