import hashlib
import re

import xxhash

from cdmspark.llm.order_minhash import (BINS, K, POS_BITS, TUPLE, op10_order_minhash, order_minhash,
                                        with_next)
from tests.conftest import SF_SMALL

TEXTS = ["", None, "one", "a b", "a b c d e f g " * 50, "x" * 100_000, "the cat sat on the mat",
         "the mat sat on the cat", "日本語 " * 300, " \t\n", "the cat sat on the mat"]


def xx(values):
    """Spark's xxhash64 of longs, strings and ints: each value hashed with the last hash as seed."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def long8(x):
    return (x & (2 ** 64 - 1)).to_bytes(8, "little")


def brute(text):
    toks = re.findall("[^\\x20\\x09-\\x0D]{1,24}", text or "")
    if not toks:
        return "0000" * BINS
    grams = [xx([" ".join(toks)])] if len(toks) < K else [xx(toks[i:i + K]) for i in range(len(toks) - K + 1)]
    seen, bins = {}, {}
    for pos, g in enumerate(grams):
        g = (g << POS_BITS) % 2 ** 64
        g = (g - 2 ** 64 if g >> 63 else g) >> POS_BITS
        occ = seen[g] = seen.get(g, -1) + 1
        pair = xx([long8(g), occ.to_bytes(4, "little")]) & ~(2 ** POS_BITS - 1)
        bins.setdefault((pair % 2 ** 64) >> 58, []).append((pair, pos))
    out = []
    for b in range(BINS):
        few = sorted((p, x) for x, p in sorted(bins.get(b, []))[:TUPLE])
        out.append("%04x" % (xx([long8(x) for _, x in few]) % 65535 + 1) if few else "0000")
    return "".join(out)


def test_signatures_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in order_minhash(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[6] == got[10] != got[7]


def test_next_of_ties_nulls_and_lone_rows(spark):
    rows = [(3, "c"), (1, "a"), (None, "n"), (2, "b"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for ranges in (1, 2, 50):
        got = {r.text: r.next_text for r in with_next(df, ranges).collect()}
        assert {k: got[k] for k in "nab"} == {"n": "a", "a": "b", "b": got["b"]} and len(got) == 5
        assert sorted(got.values()) == sorted(got)
    one = with_next(df.filter("doc_id = 1"), 4).collect()
    assert [(r.text, r.next_text) for r in one] == [("a", "a")]
    assert with_next(df.limit(0), 4).count() == 0


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in op10_order_minhash(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    near = 0
    for k, (i, t) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute(t) and r.edited_fingerprint == brute(edited)
        a, b = ([f[j:j + 4] for j in range(0, 4 * BINS, 4)] for f in (brute(t), brute(edited)))
        both = [(x, y) for x, y in zip(a, b) if (x, y) != ("0000", "0000")]
        want = sum(x == y for x, y in both) / len(both) if both else 1.0
        assert abs(r.near_edited - want) < 1e-12
        near += r.near_edited > r.near_next
    assert near / len(docs) > 0.9


def test_order_matters(spark):
    words = [f"w{i}" for i in range(300)]
    swapped = words[150:] + words[:150]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(swapped))], "doc_id long, text string")
    a, b = [r.fingerprint for r in order_minhash(df).orderBy("doc_id").collect()]
    same = sum(a[j:j + 4] == b[j:j + 4] for j in range(0, 4 * BINS, 4)) / BINS
    assert same < 0.85  # the k-mers are nearly all the same, their order is not
