import itertools
import random

import pytest
from pyspark.sql import functions as F

from cdmspark.llm.mixing import flow, make_plan, mix, op7_mixing, source_targets, take_documents, words, whole_text
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck


def cheapest(supply, quota, copies):
    """Most words, then fewest words of later copies, by trying all flows."""
    arcs = [(p, s) for p in supply for s in p]
    best = None
    for amounts in itertools.product(*[range(min(quota[s], copies * supply[p]) + 1) for p, s in arcs]):
        used = {p: sum(a for (q, _), a in zip(arcs, amounts) if q == p) for p in supply}
        got = {s: sum(a for (_, t), a in zip(arcs, amounts) if t == s) for s in quota}
        if all(used[p] <= copies * supply[p] for p in supply) and all(got[s] <= quota[s] for s in quota):
            cost = sum(sum(j * min(supply[p], max(0, used[p] - (j - 1) * supply[p])) for j in range(1, copies + 1)) for p in supply)
            best = max(best or (0, -10 ** 9), (sum(amounts), -cost))
    return best


def test_flow_is_the_cheapest():
    rnd = random.Random(3)
    for _ in range(25):
        patterns = [("a",), ("a", "b"), ("b",)][:rnd.randrange(1, 4)]
        supply = {p: rnd.randrange(0, 4) for p in patterns}
        quota = {s: rnd.randrange(0, 5) for s in "ab"}
        sent = flow(supply, quota, 2)
        total = sum(sum(x.values()) for x in sent.values())
        cost = sum(sum(j * min(supply[p], max(0, sum(sent[p].values()) - (j - 1) * supply[p])) for j in (1, 2)) for p in supply)
        assert (total, -cost) == cheapest(supply, quota, 2)


def test_targets():
    t = source_targets({"a": 10, "b": 100, "c": 0}, {"a": 5, "b": 2, "c": 1}, 165.0, 2)
    assert t == {"a": 20.0, "c": 0.0, "b": 145.0}
    assert make_plan([], (5, 2, 1), 1.5, 2).sources == []


ROWS = [(1, "a b c", "x"), (2, "d", "x"), (3, None, "y"), (4, "", None), (5, "e f", None), (None, "g h i j", "y"), (7, "k", "x"),
        (8, " l  m\n", "y"), (9, "w " * 50_000, "x"), (9, "w " * 50_000, "x")]


def test_mix_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns(
        {"n_chars": F.length("text"), "taken": F.lit("t"), "size": F.lit(0)})
    sized = df.withColumns({"__n": words(whole_text()), "__s": F.array("source")})
    mixed, plan = mix(sized, "__s", "__n")
    got = mixed.collect()
    assert len(got) == len(ROWS)
    for s, n, target in plan.sources:
        mine = [r for r in got if r.source == s]
        assert sum(r["__n"] for r in mine) == n
        assert sum(r["__taken"] for r in mine) == int(target + 0.5)
        assert all(0 <= r["__taken"] <= 2 * r["__n"] for r in mine)
    corpus = take_documents(df)
    assert corpus.columns == df.columns
    rows = corpus.collect()
    assert sum(len(r.text.split()) for r in rows) == sum(r["__taken"] for r in got)
    texts = {t for _, t, _ in ROWS}
    assert all(r.text in texts or any(t and t.startswith(r.text) for t in texts) for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert take_documents(df.limit(0)).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a", "b"] if i % 3 else ["b"]) for i in range(60)] + [(99, 7, None), (98, 5, [])]
    df = spark.createDataFrame(rows, "doc_id long, n long, s array<string>")
    mixed, plan = mix(df, "s", "n", total=0.5)
    got = {r.doc_id: r["__taken"] for r in mixed.collect()}
    assert got[99] == got[98] == 0 and max(got.values()) == 10
    assert sum(got.values()) == sum(int(t + 0.5) for _, _, t in plan.sources)
    assert got == {r.doc_id: r["__taken"] for r in mix(df.repartition(7), "s", "n", total=0.5)[0].collect()}


def test_query(spark):
    rows = op7_mixing(spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(sum(r.taken for r in v) - t) <= 1 for (n, t), v in by.items() if sum(r["size"] for r in v) == n)


@pytest.mark.parametrize("name", ["op7_mixing", "op6_warc", "op3_exact_dedup"])
def test_against_sql(spark, name):
    assert compare(spark, name, SF_SMALL, duck(SF_SMALL), verbose=True)
