"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints: lower-cased (A-Z) words, shingles of ``shingle`` words, XXH64 with seed 42; a bit is
set when over half of the shingle hashes, repeats included, set it. A text of fewer words has one
shingle, a text without words the fingerprint zero.

Links at ``max_bits`` or fewer differing bits: with an even radius, both fingerprints emit all
variants within half of it, and two linked ones meet in one variant. With an odd radius the 64
bits are cut into ``BLOCKS`` blocks, and each block in turn is left out: some block holds a
differing bit, so the rest differs in an even radius and the balls of half of that meet (196
variants for 3 bits). Only distinct fingerprints emit. They shuffle on the variant, each bucket
is verified at the full distance, and it emits the links of a spanning forest, fewer than its
members, never all pairs. A bucket of 3 bits holds at most 49 * 2^16 fingerprints (25 MB).

Components of the links name the groups; the smallest doc_id is a group's name.

Defined results: a null text counts as empty; empty texts form one group with anything within
reach of zero; null doc_ids never name a group that has another id, and a group of null ids alone
has a null name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, small_batches, store, table, text_of, unpacked, whole_text
from .components import components

SHINGLE, MAX_BITS, BLOCKS = 3, 3, 4
CHUNK = 1 << 18


def simhash(text: str, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash
    digest = xxhash.xxh64_digest
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends], ends[min(shingle, len(words)) - 1:]
    count = np.zeros(64, np.int64)
    for at in range(0, len(ends), CHUNK):
        raw = b"".join([digest(buf[a:b - 1], 42) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(ends)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return signed(text)


def _masks(max_bits: int) -> list[tuple[int, np.ndarray]]:
    """(bits left out, flips of the others) for each block; one entry without blocks if even."""
    half, width = max_bits // 2, 64 // BLOCKS
    blocks = [range(b * width, (b + 1) * width) for b in range(BLOCKS)] if max_bits % 2 else [range(0)]
    out = []
    for block in blocks:
        rest = [i for i in range(64) if i not in block]
        flips = [reduce(lambda m, i: m | 1 << i, c, 0) for k in range(half + 1) for c in combinations(rest, k)]
        out.append((sum(1 << i for i in block), np.array(flips, np.uint64)))
    return out


def _emit(max_bits: int):
    masks = _masks(max_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.asarray(b.column(0), np.int64).view(np.uint64)
            for fps in np.array_split(every, max(1, len(every) // 2000)):
                for n, (out, flips) in enumerate(masks):
                    # the number of the block left out fills its bits, so blocks rarely share a key
                    mark = np.uint64((n * (out // ((1 << 64 // BLOCKS) - 1))) if out else 0)
                    keys = ((fps[:, None] ^ flips[None, :]) & np.uint64(~out % (1 << 64))) | mark
                    yield pa.RecordBatch.from_pydict({
                        "key": keys.ravel().view(np.int64),
                        "fp": np.repeat(fps, len(flips)).view(np.int64)})

    return emit


def forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one bucket: each fingerprint is visited once and takes its
    unvisited neighbours along."""
    left, a, b = values, [], []
    todo: list = []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        u = todo.pop()
        near = np.bitwise_count(left ^ u) <= max_bits
        found = left[near]
        if len(found):
            left = left[~near]
            todo.extend(found)
            a.append(np.full(len(found), u, np.uint64))
            b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def _bucket_links(max_bits: int):
    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        start, size = edge[:-1], np.diff(edge)
        two = start[size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= max_bits
        got = [(a[near], b[near])]
        got += [forest(np.unique(fp[s:s + n]), max_bits) for s, n in zip(start[size > 2], size[size > 2])]
        return np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k, f):
            a, b = links(k, f)
            return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            key = np.concatenate([key, np.asarray(batch.column(0), np.int64)])
            fp = np.concatenate([fp, np.asarray(batch.column(1), np.int64).view(np.uint64)])
            if len(key):
                cut = np.searchsorted(key, key[-1], "left")  # the last bucket may go on
                if cut:
                    yield out(key[:cut], fp[:cut])
                    key, fp = key[cut:], fp[cut:]
        if len(key):
            yield out(key, fp)

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``fp``, distinct) within ``max_bits``."""
    variants = fps.select("fp").mapInArrow(_emit(max_bits), "key bigint, fp bigint")
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(
        _bucket_links(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id, text_hash, root) of every document; ``root``, a fingerprint, names
    the component even where ids repeat or are null."""
    text = whole_text(text_col)
    signed = store(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text, shingle).alias("fp"),
                               F.xxhash64(text).alias("text_hash")), "simhash")
    nodes = store(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(fingerprint_links(nodes, max_bits))
    known = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return signed.join(known.join(names, "root").select("fp", "component_id", "root"), "fp").select(
        "doc_id", "fp", "component_id", "text_hash", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id (of rows equal in doc_id,
    the one of the smallest text hash); all columns kept. Only rows that go, and rows that repeat
    id and text, are looked up; the rest pass."""
    near = store(near_duplicates(docs, id_col, text_col, shingle, max_bits), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    best = near.groupBy("root").agg(F.min(order).alias("best"))
    rows = near.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    fate = rows.join(best, "root").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
        .alias("__stays")).filter("not __stays or n > 1")
    hashed = packed(docs).withColumn("__h", F.xxhash64(text_of(text_col))).withColumn("__of", F.col("row")[id_col])
    met = hashed.join(fate, (F.col("__h") == F.col("__hash")) & F.col("__of").eqNullSafe(F.col("__id")), "left")
    once = met.filter("__stays is null").select("row")
    again = met.filter("__stays").dropDuplicates(["__of", "__h"]).select("row")
    return unpacked(once.unionByName(again), docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    near = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
