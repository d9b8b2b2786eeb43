"""Token counts by a digest cache: only texts that no stored count covers are encoded, once each.

A count belongs to (SHA-256 of the normalised text, version of the tokenizer). The version is the
SHA-256 of the vocabulary file, the library with its version and the settings of the call, so that
a changed file, library or setting never meets an older count. Normalised means: null as the empty
text, and bytes that are no UTF-8 replaced by U+FFFD; nothing that a tokenizer could count otherwise.

1. Documents become (doc_id, digest, n_bytes); texts stay where they are.
2. Distinct digests are matched against the cache; those it lacks are the misses.
3. One text a miss is encoded. Where misses are more than ``FEW`` of the distinct texts, copies are
   reduced to one text a task and digest, which then shuffle on the digest once, and the misses among
   them are encoded where they arrive. Where they are fewer, only documents with a missing digest are
   picked out first, by a join that Spark broadcasts while the misses' stored bytes are few.
4. Counts of the misses are appended to the cache as Parquet below ``version=...``. A reader takes one
   row a digest, so an append that was repeated, or that two jobs did at once, does no harm.
5. Documents are joined to the counts on the digest. Texts with many copies are narrow rows there, in
   a join that AQE splits.

Defined results: a null or empty text has 0 bytes and the library's count for the empty text; rows
repeat as they do in the input, null ids included; a text of any length is encoded whole; an empty
table gives an empty result and appends nothing. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, small_batches, store, table

LIMIT = 4096
CACHE_DDL = "digest binary, n_tokens bigint"
#: Share of the distinct texts up to which misses count as few; a share, so that any size behaves alike.
FEW = 0.1
#: Texts handed to the library at once, in characters; a longer text goes alone.
CHARS = 1 << 20

_LOADED: dict[str, object] = {}


@dataclass(frozen=True)
class TokenCounter:
    """A vocabulary file and the call that counts with it: without begin, end or other added special
    tokens, without truncation or padding; special strings inside texts as the library has them."""
    path: str

    @property
    def library(self) -> str:
        return "sentencepiece" if self.path.endswith(".model") else "tokenizers"

    def version(self) -> str:
        """Digest of what a count depends on."""
        from importlib.metadata import version
        h = hashlib.sha256(f"{self.library} {version(self.library)} bare\n".encode())
        with open(self.path, "rb") as f:
            for part in iter(lambda: f.read(1 << 20), b""):
                h.update(part)
        return h.hexdigest()

    def _model(self):
        if self.path not in _LOADED:
            if self.library == "sentencepiece":
                import sentencepiece
                _LOADED[self.path] = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                from tokenizers import Tokenizer
                t = Tokenizer.from_file(self.path)
                t.no_truncation()
                t.no_padding()
                _LOADED[self.path] = t
        return _LOADED[self.path]

    def counts(self, texts: list[str]) -> list[int]:
        m, out, at = self._model(), [], 0
        while at < len(texts):
            end, room = at + 1, CHARS - len(texts[at])
            while end < len(texts) and len(texts[end]) <= room:
                room -= len(texts[end])
                end += 1
            if self.library == "sentencepiece":
                out += map(len, m.encode(texts[at:end], num_threads=1))
            else:
                out += [len(e.ids) for e in m.encode_batch(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def column(self, text: Column) -> Column:
        @F.arrow_udf("bigint")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array(self.counts(texts.to_pylist()), pa.int64())

        return run(text)


def normalised(text: Column) -> Column:
    return F.make_valid_utf8(F.coalesce(text.cast("string"), F.lit("")))


class CountCache:
    """Stored counts of one tokenizer version in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/version={version}"

    def read(self) -> DataFrame:
        """(digest, n_tokens), one row a digest; empty before the first append."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], CACHE_DDL)
        return (self.spark.read.schema(CACHE_DDL).parquet(self.folder)
                .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))

    def append(self, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self.folder)


def _texts_to_encode(docs: DataFrame, misses: DataFrame, few: bool) -> DataFrame:
    """(digest, text) of one document a missing digest."""
    texts = docs.select(F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "text")
    if few:
        return texts.join(misses, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    one = texts.groupBy("digest").agg(F.first("text").alias("text"))
    return one.join(misses.hint("merge"), "digest", "left_semi")


def token_counts(docs: DataFrame, counter: TokenCounter, cache_root: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; texts the cache lacks are encoded and appended to it."""
    spark = docs.sparkSession
    small_batches(spark)
    cache = CountCache(spark, cache_root, counter.version())
    docs = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    keys = store(docs.select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"),
                             F.octet_length("text").cast("bigint").alias("n_bytes")), "keys")
    distinct = store(keys.select("digest").distinct(), "digests")
    misses = store(distinct.join(cache.read(), "digest", "left_anti"), "misses")
    n = misses.count()
    if n:
        texts = _texts_to_encode(docs, misses, n <= FEW * distinct.count())
        cache.append(texts.select("digest", counter.column(F.col("text")).alias("n_tokens")))
    return keys.join(store(cache.read(), "counts"), "digest").select("doc_id", "n_bytes", "n_tokens")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for every run, so that the query encodes each distinct text."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counter = TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    return (token_counts(docs, counter, new_folder(spark, "token-cache"))
            .withColumn("over_limit", F.col("n_tokens") > LIMIT))
