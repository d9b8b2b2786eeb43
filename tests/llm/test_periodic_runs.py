import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cdmspark.llm import periodic_runs as P
from tests.conftest import SF_SMALL


def brute(w):
    """Runs by comparing every word with the one q before it, for every q."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(12, 2 * q) and not any(
                    all(w[k] == w[k - d] for k in range(start + d, j)) for d in range(1, q)):
                out.append((start, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs))


def rewritten(key, w):
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def contract(key, text):
    w = [x.decode() for x in (text or "").encode().split()]
    w = rewritten(key, w)
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def random_words(rng):
    size, kinds, w = rng.choice([0, 11, 12, 40, 120]), rng.choice([1, 2, 3, 9]), []
    while len(w) < size:
        x = rng.random()
        if x < 0.4 and w:
            block = w[-rng.randint(1, 20):]
            w += (block * 5)[:rng.randint(1, 5 * len(block))]
        elif x < 0.6 and w:
            a = rng.randrange(len(w))
            w += w[a:a + rng.randint(1, 25)]
        else:
            w += [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 4))]
    return w


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(8)]
        for w, got in zip(texts, P.runs_of(texts)):
            assert got == brute(w)


def test_windows_hold_every_run_and_are_disjoint():
    import numpy as np
    rng = random.Random(6)
    for _ in range(100):
        texts = [random_words(rng) for _ in range(6)]
        ends = np.cumsum([len(t) for t in texts])
        spans = P.windows(np.array([hash(x) for t in texts for x in t], np.int64), ends)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for t, e in zip(texts, ends.tolist()):
            for s, n, _ in brute(t):
                assert any(a <= e - len(t) + s and e - len(t) + s + n <= b for a, b in spans)


def test_colours_are_latest_ends():
    """On every appended word the automaton names, per suffix that occurred before, its latest end."""
    rng = random.Random(7)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(30)]
        a = P.PrefixAutomaton()
        for i, c in enumerate(w):
            got = [x for x in a.append(c) if x[1]]
            want = {}
            for n in range(1, i + 1):
                for e in range(i - 1, n - 2, -1):
                    if w[e - n + 1:e + 1] == w[i - n + 1:i + 1]:
                        want[e] = max(want.get(e, 0), n)
                        break
            assert dict(got) == want and len(got) == len(want)


@pytest.mark.parametrize("words", [[b"a"] * 30_000, [b"a", b"b"] * 20_000, [b"x%d" % (k % 4999) for k in range(20_000)]])
def test_long_periodic_texts(words):
    (runs,) = P.runs_of([words])
    assert runs == [(0, len(words), len(set(words)))]
    assert P.collapse(words, runs) == b" ".join(words[:len(set(words))])


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert P.runs_of([b])[0] == brute(b)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a " * 11), (5, "a " * 12), (None, "a b c " * 9), (6, "é ü " * 6),
       (6, "é ü " * 6), (7, "a b " * 12), (8, "x\x00 " * 13), (9, ("lang " * 3 + "kurz ") * 20_000), (None, None)]


def test_odd_rows_and_foreign_columns(spark):
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in ODD], "doc_id long, text string, runs int, collapsed string")
    got = df.select("*", P.periodic_runs(F.col("text")).alias("a.b")).collect()
    assert len(got) == len(ODD)
    for r in got:
        w = (r["text"] or "").encode().split()
        runs = [tuple(x) for x in r["a.b"]["runs"]]
        assert r["a.b"]["n_words"] == len(w) and r["runs"] == 1
        if len(w) < 1000:
            assert runs == brute(w)
            assert r["a.b"]["collapsed"].encode() == collapsed([x.decode() for x in w], runs).encode()
        else:
            assert runs == [(0, len(w), 4)]
    assert df.limit(0).select(P.periodic_runs(F.col("text"))).count() == 0


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in P.op13_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r.text or "") < 6000]
    assert len(short) > 150 and any(got[r.doc_id][1] for r in short)
    for r in short:
        assert got[r.doc_id] == contract(r.doc_id, r.text)


def test_rewritten_tail(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(n))) for k in range(200) for n in (0, 1, 7, 60)] + [(None, "a b c d e f"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", P.with_periodic_tail(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("t")).collect()
    for r in got:
        assert r.t.split() == rewritten(r.doc_id, (r.text or "").split())
