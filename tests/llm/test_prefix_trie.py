import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cdmspark.llm import prefix_trie as T
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(convs):
    """The contract's rows from {conv_id: [(role, text), ...]}."""
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in ms if len(convs[c]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids.get(p, [])),
                    sum(q not in kids for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    turns, sizes = T.rebuilt_turns(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in T.prefix_trie(turns, sizes, **kw).collect()), key=str)


def random_rows(rng, convs, most, ids):
    rows = []
    for c in rng.sample(ids, convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["u", "a"]), "x" * rng.randint(0, 2)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,fold,bits", [(1, 4, 4096, 10), (2, 2, 2, 1), (3, 3, 1, 3), (4, 1, 2, 0)])
def test_against_brute_force(spark, seed, block, fold, bits):
    rng = random.Random(seed)
    rows = random_rows(rng, 60, 14, [*range(0, 40), *range(100, 140), *range(-30, 0), 10 ** 12])
    rows += [(c, t, "u", "same") for c in (20, 21, 22, 23, 120) for t in range(12) if not any(r[0] == c for r in rows)]
    assert run(spark, rows, block=block, fold=fold, chunk_bits=bits) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "a", "u"), (2, 5, "u", "é" * 50_000),
            (None, 0, "u", "lost"), (3, 1, "ab", "c"), (4, 1, "a", "bc"), (103, 0, "u", None), (100, 0, "u", ""), (100, 1, None, "t")]
    rows += [(7, t, "u", "t") for t in range(300)] + [(8, t, "u", "t") for t in range(299)]
    assert run(spark, rows) == brute(rebuilt(rows))
    assert run(spark, []) == []
    extra = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA + ", node int, `a.b` int, prefix string")
    turns, sizes = T.rebuilt_turns(extra)
    assert sorted((tuple(r) for r in T.prefix_trie(turns, sizes).collect()), key=str) == brute(rebuilt(rows))


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(5000, 8000) for t in range(7)]
    got = run(spark, rows)
    assert got == brute(rebuilt(rows))
    assert max(r[3] for r in got) == 3000


def test_turns_outside_diverging_blocks_are_not_grouped(spark):
    rows = [(c, t, "u", f"{t}" if t < 8 else f"{c} {t}") for c in (1000, 2000, 3000) for t in range(12)]
    turns, sizes = T.rebuilt_turns(spark.createDataFrame(rows, SCHEMA))
    blocks = T.block_rows(turns)
    per = {(r["k"]): r["n"] for r in blocks.groupBy("k").agg(F.count_distinct("prefix", "digest").alias("n")).collect()}
    assert per == {0: 1, 1: 1, 2: 3}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in T.op12_prefix_trie(spark, SF_SMALL).collect()), key=str)
    assert got == brute(rebuilt(rows))
