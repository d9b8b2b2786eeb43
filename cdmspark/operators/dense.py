"""Dense neighbours: exact top-k and quantised top-k with an exact rerank (M2, M3).

Every query meets every document, as products of blocks. Queries are dealt to ``g`` groups and
documents to ``p`` pieces; a task gets one group and one piece and keeps the best rows of each query
there. What moves is every vector once per group or piece of the other side, never pairs: with blocks
of ``BLOCK`` vectors, N / BLOCK copies of the table. Small tables get smaller blocks, so that all cores
have some.

Quantised (M3): a vector becomes ``CODES`` bytes, the nearest of 256 centroids in each of as many equal
parts of its coordinates. Codebooks are trained on a bounded sample (``TRAIN_VECTORS``). Queries stay as
they are; a query's score with a code is the sum of its products with the code's centroids, computed
for blocks as one product with the decoded vectors. The best ``depth`` documents by that score are
ranked again by their exact score. The depth is measured: the exact neighbours of about
``SAMPLE_QUERIES`` queries over the whole corpus are looked up in those queries' quantised order, and
the least depth that holds ``RECALL_AIM`` of them is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from .retrieve import SCORE_DIGITS, rank_top

BLOCK, LEAST_BLOCK, CELLS, RESULTS = 1 << 16, 1 << 10, 1 << 22, 1 << 19
CODES, TRAIN_VECTORS, LLOYD_STEPS = 16, 20_000, 10
SAMPLE_QUERIES, RECALL_AIM = 512, 0.95
CODE_DIGITS = 5  # of a score by code, which is computed in single precision: equal codes must tie
_TOP = "query_id bigint, doc_id bigint, score double"


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors."""
    flat = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks]) if len(column) else np.empty(0)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def _best(score: np.ndarray, qi: np.ndarray, di: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score rounded to ``digits``) of the k best documents of every query; ties by id. The k-th
    best of the maxima of strips of columns is a score that k documents reach, so only scores near it or above
    are rounded and sorted; where strips are short or a score is no number, all are."""
    strip = min(256, len(di) // (4 * k))
    if strip < 8 or np.isnan(score.sum()):
        score = np.round(score, digits)
        low = np.partition(score, -k, axis=1)[:, -k] if len(di) > k else np.full(len(qi), -np.inf)
    else:
        whole = len(di) // strip * strip
        low = np.partition(score[:, :whole].reshape(len(qi), -1, strip).max(2), -k, axis=1)[:, -k] - 2 * 10.0 ** -digits
    r, c = np.nonzero(score >= low[:, None].astype(score.dtype))
    s = np.round(score[r, c], digits)
    r, c, s = r[keep := np.isfinite(s)], c[keep], s[keep]
    order = np.lexsort((di[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.empty(0, bool)
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return r[place < k], c[place < k], s[place < k]


def _sides(corpus: DataFrame, queries: DataFrame, k: int) -> tuple[int, int]:
    """Groups of queries and pieces of documents: blocks of at most ``BLOCK``, fewer vectors each while
    the cores would not all have two, and fewer queries where their ``k`` best would be beyond ``RESULTS``
    rows, as a task holds all it returns."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    side = math.ceil(math.sqrt(2 * cores))

    def parts(n: int, most: int) -> int:
        return max(1, math.ceil(n / min(most, max(LEAST_BLOCK, math.ceil(n / side)))))
    return parts(queries.count(), min(BLOCK, max(LEAST_BLOCK, RESULTS // max(1, k)))), parts(corpus.count(), BLOCK)


def _grid_top(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool, to_matrix, digits: int) -> DataFrame:
    """Per query and piece of the corpus the k best documents (query_id, doc_id, score). ``to_matrix`` turns
    the corpus' second column into rows to multiply the queries' unit vectors with."""
    groups, pieces = _sides(corpus, queries, k)
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    second = [c for c in corpus.columns if c != "id"][0]
    # names of their own on either side, as both may come from one table
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("query"), own.alias("g"),
                       F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("p"))
    d = corpus.select(F.col("id").alias("doc_id"), F.col(second).alias("doc"),
                      F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("dg"),
                      F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("dp"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            qi, di = np.asarray(left.column("query_id")), np.asarray(right.column("doc_id"))
            x, y = _matrix(left.column("query")), to_matrix(right.column("doc"))
            step = max(1, CELLS // len(di))
            at: dict[int, list[int]] = {}  # columns of each document that is a query too
            if exclude_self:
                for c in np.nonzero(np.isin(di, qi))[0]:
                    at.setdefault(di[c], []).append(c)
            for a in range(0, len(qi), step):
                score = x[a:a + step].astype(y.dtype) @ y.T
                if exclude_self:
                    own = [*zip(*((r, c) for r, q in enumerate(qi[a:a + step]) for c in at.get(q, ())))]
                    if own:
                        score[own[0], own[1]] = -np.inf
                r, c, s = _best(score, qi[a:a + step], di, k, digits)
                out.append((qi[a:a + step][r], di[c], s.astype(np.float64)))
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "doc_id", "score"), zip(*out))})

    return q.groupBy("g", "p").cogroup(d.groupBy("dg", "dp")).applyInArrow(run, _TOP)


def topk_dense(corpus: DataFrame, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """Exact top-k by cosine: (query_id, doc_id, score, rank). Inputs: (id bigint, vec array<float>)."""
    return rank_top(_grid_top(corpus.select("id", "vec"), queries.select("id", "vec"), k, exclude_self, _matrix, SCORE_DIGITS), k)


# --- M3: quantised vectors ------------------------------------------------------------------

class Codebooks:
    """``CODES`` books of up to 256 centroids, one per part of the coordinates (zeros fill the last part)."""

    def __init__(self, sample: np.ndarray, codes: int = CODES, steps: int = LLOYD_STEPS):
        self.parts = min(codes, sample.shape[1])
        self.width = math.ceil(sample.shape[1] / self.parts)
        self.dim = sample.shape[1]
        self.books = [self._train(x, steps) for x in self._split(sample)]

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        full = np.zeros((len(x), self.parts * self.width))
        full[:, :self.dim] = x
        return [full[:, j * self.width:(j + 1) * self.width] for j in range(self.parts)]

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)

    def _train(self, x: np.ndarray, steps: int) -> np.ndarray:
        distinct = np.unique(x, axis=0)
        n = min(256, len(distinct))
        c = distinct[np.linspace(0, len(distinct) - 1, n).astype(int)].copy()
        for _ in range(steps):
            near = self._nearest(x, c)
            total, count = np.zeros_like(c), np.bincount(near, minlength=n)[:, None]
            np.add.at(total, near, x)
            c = np.where(count > 0, total / np.maximum(count, 1), c)
        return c

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Bytes (rows, parts) of unit vectors."""
        return np.stack([self._nearest(p, c) for p, c in zip(self._split(x), self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        flat = np.concatenate([c[codes[:, j]] for j, c in enumerate(self.books)], 1)
        return flat[:, :self.dim].astype(np.float32)


def train_codebooks(vectors: DataFrame, n: int, rows: int = TRAIN_VECTORS) -> Codebooks | None:
    """Codebooks from a sample of about ``rows`` vectors, by a hash of the id; that bounded sample is what
    reaches the driver. None for an empty table."""
    share = min(1.0, rows / max(1, n))
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sample.select("id", "vec").toPandas().sort_values("id")
    if not len(got):
        return None
    return Codebooks(unit(np.array(got["vec"].tolist(), dtype=np.float64)))


class QuantisedIndex:
    """Codes of a corpus (id, vec), stored, with the depth its rerank needs for ``k`` neighbours."""

    def __init__(self, corpus: DataFrame, queries: DataFrame, k: int = 3, exclude_self: bool = False, aim: float = RECALL_AIM):
        self.corpus, self.k, self.exclude_self = corpus.select("id", "vec"), k, exclude_self
        self.n = corpus.count()
        self.books = train_codebooks(corpus, self.n)
        books = self.books

        def encode(batches):
            for b in batches:
                if b.num_rows:
                    codes = books.encode(_matrix(pa.chunked_array([b.column(1)])))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

        self.codes = materialize(self.corpus.mapInArrow(encode, "id bigint, code binary")) if books else None
        self.depth = self._measured(queries, aim) if books else 0

    def _candidates(self, queries: DataFrame, depth: int) -> DataFrame:
        books = self.books

        def decoded(column) -> np.ndarray:
            raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            return books.decode(raw.reshape(len(column), -1))

        return _grid_top(self.codes, queries.select("id", "vec"), depth, self.exclude_self, decoded, CODE_DIGITS)

    def _measured(self, queries: DataFrame, aim: float) -> int:
        """The least depth that holds ``aim`` of the exact neighbours of the sampled queries; the driver gets
        one row a depth."""
        share = min(1.0, SAMPLE_QUERIES / max(1, queries.count()))
        sample = materialize(queries.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))))
        exact = topk_dense(self.corpus, sample, self.k, self.exclude_self).select("query_id", "doc_id")
        wide = max(64, 16 * self.k)
        while True:
            order = rank_top(self._candidates(sample, min(wide, self.n)), min(wide, self.n)).select("query_id", "doc_id", "rank")
            found = {r["rank"]: r["n"] for r in exact.join(order, ["query_id", "doc_id"], "left").groupBy("rank").agg(
                F.count("*").alias("n")).collect()}
            need, held = aim * sum(found.values()), 0
            for depth in sorted(x for x in found if x is not None):
                held += found[depth]
                if held >= need:
                    return max(depth, self.k)
            if wide >= self.n:
                return max(self.n, self.k)
            wide *= 4

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best by exact score of the ``depth`` best by code."""
        if not self.books:
            return queries.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"),
                                           F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        near = rank_top(self._candidates(queries, self.depth), self.depth).select("query_id", "doc_id")
        both = (near.join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id")
                .join(self.corpus.select(F.col("id").alias("doc_id"), F.col("vec").alias("d")), "doc_id")
                .select("query_id", "doc_id", "q", "d"))

        def exact(batches):
            for b in batches:
                if b.num_rows:
                    x, y = (_matrix(pa.chunked_array([b.column(c)])) for c in (2, 3))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(1))], ["query_id", "doc_id", "score"])

        return rank_top(both.mapInArrow(exact, _TOP), self.k)

    def compared_share(self) -> float:
        """Bytes compared per query against those of the exact way: codes of all documents and whole vectors
        of ``depth``, to whole vectors of all (4 bytes a coordinate)."""
        if not self.books:
            return 0.0
        whole = 4 * self.books.dim
        return (self.n * self.books.parts + self.depth * whole) / (self.n * whole)


def approx_dense(corpus: DataFrame, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """Approximate top-k by cosine from quantised vectors: (query_id, doc_id, score, rank)."""
    return QuantisedIndex(corpus, queries, k, exclude_self).search(queries)
