"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 reads one 64-bit hash per row and builds a blocked Bloom filter of the hashes that may
occur more than once: every hash sets ``BITS`` bits of one 64-bit word, and the filter keeps the
bits that at least two rows set. Pass 2 tests every row against the filter. Rows it misses occur
once for certain and pass straight through; only the others shuffle, on their SHA-256.

The filter has about ``BITS_PER_ROW`` bits a row and at most ``MAX_WORDS`` words (16 MB), which
bounds the broadcast. Past that size more single rows test positive and shuffle as well; the
result stays exact.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id
stays (null ids sort lowest), and of rows equal in text and doc_id exactly one. An empty table
gives an empty result. Other columns, whatever their names, travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, store, table, text_of, unpacked, whole_text

BITS = 3
BITS_PER_ROW = 16
MAX_WORDS = 1 << 20


def _words(rows: int) -> int:
    """Filter size in 64-bit words: a power of two for about ``BITS_PER_ROW`` bits a row."""
    need = max(1024, rows * BITS_PER_ROW // 64)
    return min(MAX_WORDS, 1 << (need - 1).bit_length())


def _bit(h: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(k)), F.lit(64)).cast("int")


def _mask(h: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(h, k)))
    return out


def repeat_filter(hashes: DataFrame, h: str, n_words: int) -> DataFrame:
    """Pass 1: (``__word``, ``__bits``), the bits that two or more rows set; at most ``n_words``
    rows. A row sets each of its bits once, however many of its bit numbers coincide."""
    hc = F.col(h)
    set_bits = hashes.select(
        F.pmod(hc, F.lit(n_words)).alias("__word"),
        F.explode(F.array_distinct(F.array(*[_bit(hc, k) for k in range(BITS)]))).alias("__bit"))
    twice = set_bits.groupBy("__word", "__bit").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("__word").agg(
        F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))


def mark_repeats(df: DataFrame, h: str, bloom: DataFrame, n_words: int) -> DataFrame:
    """Pass 2: ``__maybe`` is false for rows whose hash occurs once for certain."""
    bits = F.coalesce(F.col("__bits"), F.lit(0).cast("bigint"))
    return (df.withColumn("__word", F.pmod(F.col(h), F.lit(n_words)))
            .join(F.broadcast(bloom), "__word", "left")
            .withColumn("__maybe", bits.bitwiseAND(_mask(F.col(h))) == _mask(F.col(h)))
            .drop("__word", "__bits"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Texts are read once; what
    is stored, tested and shuffled are digests."""
    text = whole_text(text_col)
    dig = store(docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"),
        F.xxhash64(text).alias("__h"), F.monotonically_increasing_id().alias("__row")), "digests")
    n_words = _words(dig.count())
    marked = mark_repeats(dig, "__h", repeat_filter(dig, "__h", n_words), n_words)
    single = marked.filter(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.filter("__maybe")
    # stored, so that both sides of the join below shuffle and AQE may split a text that fills many rows
    groups = store(maybe.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "__row")).alias("__keep"), F.count("*").alias("group_size")), "groups")
    repeated = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("__keep.doc_id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("__keep.__row")).alias("kept"), "text_sha256")
    return single.unionByName(repeated)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped rows, all columns kept. Possibly repeated rows shuffle as one
    partial maximum per text and task, so a text that fills a third of the table costs one row a
    task."""
    h = store(docs.select(F.xxhash64(whole_text(text_col)).alias("__h")), "hashes")
    n_words = _words(h.count())
    text, row = text_of(text_col), F.col("row")
    marked = mark_repeats(packed(docs).withColumn("__h", F.xxhash64(text)), "__h", repeat_filter(h, "__h", n_words), n_words)
    single = marked.filter(~F.col("__maybe")).select("row")
    plain = [row[c].cast("string") for c in docs.columns]
    best = marked.filter("__maybe").groupBy(F.sha2(text, 256).alias("__sha")).agg(
        F.max_by("row", F.struct(row[id_col], F.xxhash64(*plain))).alias("row"))
    return unpacked(single.unionByName(best.select("row")), docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
