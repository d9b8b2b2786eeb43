import random
import re

import numpy as np
import xxhash

from cdmspark.llm.components import components
from cdmspark.llm.simhash import (drop_near_duplicates, fingerprint_links, near_duplicates,
                                  op2_simhash)
from tests.conftest import SF_SMALL


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x20\\x09-\\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, radius=3):
    """{index: smallest index reachable} by comparing all pairs."""
    v = np.array(fps, np.uint64)
    name = list(range(len(v)))

    def find(x):
        while name[x] != x:
            name[x] = name[name[x]]
            x = name[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            name[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def test_links_of_planted_fingerprints(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base:
        for k in (1, 2, 3, 3, 3, 4, 5):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), k)))
        fps.add(f ^ (0b111 << 16 * rnd.randrange(4)))
    dense = rnd.getrandbits(64)  # one bucket with many members
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    fps = sorted(fps | {0, 1, 2 ** 64 - 1, 2 ** 63})
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    for radius in (0, 1, 2, 3, 4):
        links = fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
        at = {f: i for i, f in enumerate(signed)}
        name = list(range(len(fps)))

        def find(x):
            while name[x] != x:
                x = name[x]
            return x

        for r in links:
            assert bin((r.a ^ r.b) % 2 ** 64).count("1") <= radius
            a, b = find(at[r.a]), find(at[r.b])
            name[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == brute_components(fps, radius)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 900)] + [(3, 3), (-5, 900), (900, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and 100 not in got
    assert all(got[i] == -5 for i in [7, *range(500, 901)]) and -5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(4, "The quick brown fox"), (2, "the QUICK  brown\nfox"), (9, None), (7, ""), (8, "one"), (None, "one"),
        (11, "é É two"), (12, "w " * 100_000), (13, "w w w"), (2, "another text of the same id entirely"),
        (21, "repeated row"), (21, "repeated row"), (None, "null alone here it is"), (None, "null alone here it is")]


def test_nulls_ties_and_long_texts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    fps = [brute_fp(t) for _, t in ROWS]
    comp = brute_components(fps)
    want = sorted(((i, f - 2 ** 64 if f >> 63 else f, min((r[0] for r, d in zip(ROWS, comp) if d == c and
                  r[0] is not None), default=None)) for (i, _), f, c in zip(ROWS, fps, comp)), key=str)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == want
    kept = drop_near_duplicates(df.selectExpr("doc_id", "text", "1 as component_id", "'x' as fp"))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "component_id", "fp"]
    assert len(rows) == len(set(comp)) and rows.count((21, "repeated row")) == 1
    assert sum(t == "null alone here it is" for _, t in rows) == 1
    assert near_duplicates(df.limit(0)).count() == 0 == drop_near_duplicates(df.limit(0)).count()


def test_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    fps = [brute_fp(t) for _, t in docs]
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, SF_SMALL).collect()}
    assert got == {i: (f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, comp)}
