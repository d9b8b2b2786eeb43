import hashlib

import pytest

from cdmspark.llm.exact_dedup import drop_duplicates, duplicate_groups, op3_exact_dedup

from tests.conftest import SF_SMALL

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "x" * 200_000),
        (8, "x" * 200_000), (None, "b"), (9, "z"), (9, "z")] + [(100 + i, "hot") for i in range(300)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        out += [(i, keep, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest())
                for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_groups_against_brute_force(spark):
    got = [tuple(r) for r in duplicate_groups(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_rows_stay_whole_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS],
                               "doc_id long, text string, kept string, group_size int")
    got = drop_duplicates(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in brute(ROWS) if r[3])


@pytest.mark.parametrize("f", [duplicate_groups, drop_duplicates])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op3_exact_dedup(spark, SF_SMALL).collect()), key=str) == brute(rows)
