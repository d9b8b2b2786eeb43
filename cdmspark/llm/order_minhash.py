"""Order MinHash fingerprints, in DataFrame functions only.

Tokens are runs of non-white-space, cut after ``TOKEN_CHARS`` characters (so a text without
spaces has tokens as well). Every k-mer of ``K`` tokens is paired with its occurrence number in
the text, and the pair is hashed. The hash puts the pair into one of ``BINS`` bins (one
permutation in place of ``BINS`` of them); each bin selects its ``TUPLE`` smallest pairs, puts
them back into text order and hashes the tuple. A signature holds one 16-bit value per bin, zero
for an empty bin; swapping or moving k-mers changes tuples that a plain MinHash would keep.

Likeness is the share of bins with equal values among bins that either side fills; two texts
without tokens are alike at 1. Equal texts have equal fingerprints.

The occurrence number costs no shuffle: hashes are sorted inside the row with their positions,
and each run of equal hashes is numbered by ``sequence``.

Neighbours in doc_id order come from ranges: quantiles of doc_id name the ranges, the first row of
each range also goes to the range before it, and ``lead`` runs inside a range. The text shuffles
once.

Defined results: a null text counts as empty; null doc_ids come first; equal doc_ids are ordered
by text hash; after the last document comes the first (a lone document follows itself); an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_index
from .common import table, whole_text

K, BINS, TUPLE, TOKEN_CHARS = 3, 64, 2, 24
POS_BITS = 26
_POS = (1 << POS_BITS) - 1


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(sorted_keys: Column, same) -> Column:
    """Start indexes of the runs of a sorted array, and its length at the end."""
    n = F.size(sorted_keys)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(
        F.get(sorted_keys, i), F.get(sorted_keys, i - 1)))
    return F.concat(starts, F.array(n))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def _numbered(hashes: Column) -> Column:
    """Per k-mer: bin (6 bits), hash of (k-mer, occurrence number) (32 bits), position (26 bits)."""
    def key(x: Column) -> Column:
        return F.shiftright(x, POS_BITS)

    def number(srt: Column) -> Column:
        return _let(_runs(srt, lambda a, b: key(a) == key(b)), lambda r: F.zip_with(
            srt, F.flatten(F.transform(F.sequence(F.lit(0), F.size(r) - 2),
                                       lambda j: F.sequence(F.lit(0), F.get(r, j + 1) - F.get(r, j) - 1))),
            lambda x, occ: F.xxhash64(key(x), occ).bitwiseAND(F.lit(~_POS)).bitwiseOR(
                x.bitwiseAND(F.lit(_POS)))))

    packed = F.transform(hashes, lambda h, i: F.shiftleft(h, POS_BITS).bitwiseOR(
        i.cast("bigint").bitwiseAND(F.lit(_POS))))
    return _let(F.array_sort(packed), number)


def _tuples(keys: Column) -> Column:
    """Map of bin to the 16-bit hash of its smallest pairs in text order."""
    def entry(srt: Column, start: Column, end: Column) -> Column:
        few = F.slice(srt, start + 1, F.least(end - start, F.lit(TUPLE)))
        ordered = F.array_sort(F.transform(few, lambda x: F.struct(
            x.bitwiseAND(F.lit(_POS)).alias("p"), x.bitwiseAND(F.lit(~_POS)).alias("k"))))
        return F.struct(_bin(F.get(srt, start)).cast("int").alias("b"),
                        (F.pmod(F.xxhash64(F.transform(ordered, lambda y: y["k"])),
                                F.lit(65535)) + 1).cast("int").alias("v"))

    def per_bin(srt: Column) -> Column:
        return _let(_runs(srt, lambda a, b: _bin(a) == _bin(b)), lambda r: F.transform(
            F.sequence(F.lit(0), F.size(r) - 2),
            lambda j: entry(srt, F.get(r, j), F.get(r, j + 1))))

    return F.map_from_entries(_let(F.array_sort(keys), per_bin))


def signature(text: Column, k: int = K) -> Column:
    """``BINS`` values of four hex digits; ``0000`` marks an empty bin."""
    def hashes(t: Column) -> Column:
        n = F.size(t)
        return F.when(n < k, F.array(F.xxhash64(F.concat_ws(" ", t)))).otherwise(
            F.transform(F.sequence(F.lit(0), n - k),
                        lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)])))

    tokens = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]{1,%d}" % TOKEN_CHARS), F.lit(0))
    values = _let(tokens, lambda t: F.when(F.size(t) > 0, _tuples(_numbered(hashes(t)))))
    return _let(values, lambda m: F.when(m.isNull(), F.lit("0000" * BINS)).otherwise(F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.lpad(F.lower(F.hex(
            F.coalesce(F.element_at(m, b), F.lit(0)))), 4, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that either signature fills."""
    def at(s: Column, i: Column) -> Column:
        return F.substring(s, i * 4 + 1, F.lit(4))

    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.when(
        (at(a, i) == "0000") & (at(b, i) == "0000"), 0).when(at(a, i) == at(b, i), 3).otherwise(1))
    # 3 for an equal bin, 1 for a differing one: the sum s and the count n give equal = (s - n) / 2
    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.filter(bins, lambda x: x > 0), lambda f: (
        F.aggregate(f, F.lit(0), lambda s, x: s + x) - F.size(f)) / 2 / F.size(f)))


def in_ranges(rows: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """``rows`` with ``__range`` (``ranges`` ranges of the id, even by quantiles) and ``__tie``, and
    with a copy (``__copy``) of each range's first row at the end of the range before; the first
    range's first row goes to the last range. One row a range is broadcast."""
    at = F.col(id_col).cast("bigint")
    edges = rows.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], ranges * 20)
                     .alias("e")).first()["e"] or []
    dealt = (rows.withColumn("__range", range_index(at, sorted(set(edges))))
             .withColumn("__tie", F.xxhash64(text_col)).withColumn("__copy", F.lit(False)))
    firsts = dealt.groupBy("__range").agg(F.min(F.struct(at.alias("id"), "__tie")).alias("f"))
    everything = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        F.coalesce(F.lag("__range").over(Window.orderBy("__range")),
                   F.max("__range").over(everything)).alias("__to"),
        F.col("f.id").alias("__id"), F.col("f.__tie").alias("__first_tie"))
    heads = dealt.join(F.broadcast(firsts), (F.col("__tie") == F.col("__first_tie"))
                       & at.eqNullSafe(F.col("__id"))).dropDuplicates(["__to"])
    heads = heads.withColumn("__range", F.col("__to")).withColumn("__copy", F.lit(True))
    return dealt.unionByName(heads.select(*dealt.columns))


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_chars, fingerprint) of every document."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.length(text).alias("n_chars"),
                       signature(text).alias("fingerprint"))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``order_minhash`` of every document beside the next document's text and fingerprint."""
    rows = in_ranges(docs.select("doc_id", whole_text().alias("text")), "doc_id", "text", ranges)
    signed = rows.select("*", F.length("text").alias("n_chars"), signature(F.col("text")).alias("fingerprint"))
    w = Window.partitionBy("__range").orderBy("__copy", "doc_id", "__tie")
    return signed.select("*", F.lead("text").over(w).alias("next_text"), F.lead("fingerprint").over(w)
                         .alias("next_fingerprint")).filter(~F.col("__copy")).drop("__range", "__tie", "__copy")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = with_next(table(spark, sf_dir, "documents", "doc_id", "text"), ranges)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = pairs.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - half),
        F.substring("next_text", F.lit(1), half)).alias("edited"))
    signed = edited.withColumn("edited_fingerprint", signature(F.col("edited")))
    return signed.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
