"""A stored inverted index for exact text top-k, kept up to date batch by batch.

Stored below one folder, each batch in folders of its own, which readers see once the manifest names it:

* ``postings``: (term, doc_id, tf), the terms of a document side by side; readers deal the documents of a batch
  to blocks of about ``BLOCK_DOCS`` by a hash of their id, as many as the manifest says,
* ``terms``: (term, df), the batch's part of the document frequencies: frequencies of the whole index are
  sums of these parts,
* ``docs``: (doc_id), so that a document that comes again is left out.

Weights depend on all documents (idf = ln((N + 1) / (df + 1)) + 1), so they are not stored with the
postings. A search needs, for the batches it sees, the norm of every document and per term and block the
greatest tf / norm; ``publish`` computes both in one pass over the postings, without any text, moving each
posting once, to its block, and stores them for that state of the index; later searches of the state read them.

Search. The sum over a query's terms of weight * idf * greatest tf / norm bounds every score in a block.
The ``FIRST`` best blocks of each query are scored in full and give a k-th score; only blocks whose
bound reaches it are scored then. Blocks left out cannot hold a document of the top k, so the
result is exact. A query without k scored documents keeps all its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..session import freed_shuffles, settings
from ..sources.sinks import append, read_or_empty
from .retrieve import rank_top

BLOCK_DOCS, FIRST, SLACK = 64, 4, 1e-9
MANIFEST = "batch bigint, docs bigint, blocks bigint"
POSTINGS = "term string, doc_id bigint, tf bigint, batch bigint"
TERMS = "term string, df bigint, batch bigint"
DOCS = "doc_id bigint, batch bigint"
WEIGHTS = "batch bigint, block bigint, term string, doc_id bigint, most double"


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self) -> DataFrame:
        """Committed batches; a batch that was named twice counts once."""
        return read_or_empty(self.spark, f"{self.root}/manifest", MANIFEST).groupBy("batch").agg(
            F.max("docs").alias("docs"), F.max("blocks").alias("blocks"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/{name}", schema).join(
            F.broadcast(self.batches().select("batch")), "batch", "left_semi")

    def postings(self) -> DataFrame:
        """(term, doc_id, block, tf, batch) of the committed batches."""
        rows = read_or_empty(self.spark, f"{self.root}/postings", POSTINGS).join(
            F.broadcast(self.batches().select("batch", "blocks")), "batch")
        return rows.select("term", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), "tf", "batch")

    def add(self, counts: DataFrame, batch: int) -> int:
        """Index the documents of ``counts`` (id bigint, term, tf) that no other batch has; returns how many.
        A batch that is added again replaces itself. Documents without any term hold no posting."""
        known = self._read("docs", DOCS).filter(F.col("batch") != batch).select(F.col("doc_id").alias("id"))
        at = f"batch={batch}"
        counts.join(known, "id", "left_anti").select(
            "term", F.col("id").alias("doc_id"), F.col("tf").cast("bigint").alias("tf")).write.mode("overwrite").parquet(
            f"{self.root}/postings/{at}")
        new = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings/{at}")
        new.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{self.root}/terms/{at}")
        new.select("doc_id").distinct().write.mode("overwrite").parquet(f"{self.root}/docs/{at}")
        n = self.spark.read.parquet(f"{self.root}/docs/{at}").count()
        append(self.spark.createDataFrame([(batch, n, max(1, -(-n // BLOCK_DOCS)))], MANIFEST).coalesce(1), f"{self.root}/manifest")
        return n

    def state(self) -> str:
        """A name of what readers see now: the committed batches and their sizes."""
        r = self.batches().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("batch", "docs")).alias("x")).first()
        return f"{r['n']}-{(r['x'] or 0) & (2 ** 64 - 1):016x}"

    def publish(self) -> "Snapshot":
        """Norms and block maxima of the present state, computed if no search of it came before."""
        state = self.state()
        folder = f"{self.root}/states/{state}"
        n = self.batches().agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
        df = self._read("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df"))
        idf = df.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
        done = read_or_empty(self.spark, f"{self.root}/published", "state string").filter(F.col("state") == state)
        if done.isEmpty():
            idf.write.mode("overwrite").parquet(f"{folder}/idf")
            idf = self.spark.read.parquet(f"{folder}/idf")
            # every posting meets its idf once and moves once, to its block, where its document's norm and all of the
            # block's maxima are known and nothing else has to move
            weighed = self.postings().join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
            doc = Window.partitionBy("batch", "block", "doc_id")
            normed = weighed.select("term", "batch", "block", "doc_id", "tf", "w").repartition("batch", "block").withColumn(
                "norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc)))
            most = F.struct(F.lit("maxima").alias("kind"), F.col("term"), F.lit(None).cast("bigint").alias("doc_id"),
                            (F.col("tf") / F.col("norm")).alias("most"))
            norm = F.struct(F.lit("norms").alias("kind"), F.lit(None).cast("string").alias("term"), F.col("doc_id"),
                            F.col("norm").alias("most"))
            both = normed.select("batch", "block", F.inline(F.array(most, norm))).groupBy(
                "batch", "block", "kind", "term", "doc_id").agg(F.max("most").alias("most"))
            with settings(self.spark, spark__sql__maxConcurrentOutputFileWriters="2"), freed_shuffles(self.spark):
                both.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/weights")
            append(self.spark.createDataFrame([(state,)], "state string").coalesce(1), f"{self.root}/published")
        return Snapshot(self, folder, n)


class Snapshot:
    """One state of an index, ready for searches."""

    def __init__(self, index: TextIndex, folder: str, n: int):
        self.index, self.n, spark = index, n, index.spark
        self.idf = spark.read.parquet(f"{folder}/idf")
        norms, maxima = (read_or_empty(spark, f"{folder}/weights/kind={x}", WEIGHTS) for x in ("norms", "maxima"))
        self.norms, self.maxima = norms.select("doc_id", F.col("most").alias("norm")), maxima.drop("doc_id")
        self.postings = index.postings()

    def weights(self, counts: DataFrame) -> DataFrame:
        """(query_id, term, wq, idf) of queries (id, term, tf): unit length over all their terms; terms that the
        index lacks weigh in the length only."""
        unseen = F.log(F.lit(self.n) + 1) + 1
        w = counts.select(F.col("id").alias("query_id"), "term", "tf").join(self.idf, "term", "left").withColumn(
            "w", F.col("tf") * F.coalesce("idf", unseen))
        norm = w.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
        return w.filter(F.col("idf").isNotNull()).join(norm, "query_id").select(
            "query_id", "term", (F.col("w") / F.col("qn")).alias("wq"), "idf")

    def _scored(self, weights: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents in the given (query_id, batch, block)."""
        # what is wanted is stored, so that Spark knows its size; postings of no query's term do not move
        wanted = materialize(weights.join(blocks, "query_id"))
        asked = self.postings.join(weights.select("term").distinct(), "term", "left_semi")
        parts = wanted.join(asked, ["term", "batch", "block"]).groupBy("query_id", "doc_id").agg(
            F.sum(F.col("wq") * F.col("idf") * F.col("tf")).alias("s"))
        return parts.join(self.norms, "doc_id").select("query_id", "doc_id", (F.col("s") / F.col("norm")).alias("score"))

    def bounds(self, weights: DataFrame) -> DataFrame:
        """(query_id, batch, block, bound) of every block that shares a term with the query."""
        return weights.join(self.maxima, "term").groupBy("query_id", "batch", "block").agg(
            F.sum(F.col("wq") * F.col("idf") * F.col("most")).alias("bound"))

    def search(self, counts: DataFrame, k: int = 3) -> DataFrame:
        """Exact top-k by cosine: (query_id, doc_id, score, rank) for queries (id, term, tf)."""
        weights = materialize(self.weights(counts))
        place = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "batch", "block")
        bounds = materialize(self.bounds(weights).withColumn("place", F.row_number().over(place)))
        first = materialize(rank_top(self._scored(weights, bounds.filter(F.col("place") <= FIRST).select(
            "query_id", "batch", "block")), k))
        kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
        more = bounds.filter(F.col("place") > FIRST).join(kth, "query_id", "left").filter(
            F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "batch", "block")
        rest = self._scored(weights, more)
        return rank_top(first.select("query_id", "doc_id", "score").unionByName(rest), k)
