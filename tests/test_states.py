"""Mergeable profile states and partial totals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cdmspark.operators import conform as C
from cdmspark.operators import profile as P
from cdmspark.sources import sinks as SK
from tests.test_changes import _checked, row

HEADS = [("u", ["a", "b", "c", "d"]), ("v", ["a"])]


@pytest.fixture()
def upload(spark):
    rng = random.Random(4)
    rows = [("u", k, [str(rng.randrange(3)), rng.choice([None, "x", "NA"]), f"2024-01-{1 + k % 28:02d}", f"id{k}"]) for k in range(3000)]
    rows += [("v", k, [None]) for k in range(5)]
    return (spark.createDataFrame(rows, "upload_id string, row_ord long, vals array<string>"),
            spark.createDataFrame(HEADS, "upload_id string, names array<string>"))


def _exact(df):
    return sorted((r.upload_id, r.column_name, r.ordinal, r.dtype, r.cdm_type, tuple(r.sample_values), r.null_count) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_states_of_parts_merge_to_the_profile(spark, tmp_root, upload, parts):
    rows, heads = upload
    for k in range(parts):
        SK.append(P.profile_states(rows.filter(F.pmod(F.xxhash64("row_ord"), F.lit(parts)) == k)), tmp_root)
    got, want = P.profile_of_states(spark.read.parquet(tmp_root), heads), P.profile(rows, heads)
    assert got.columns == want.columns and _exact(got) == _exact(want)
    exact = {(r.upload_id, r.ordinal): r.unique_count for r in want.collect()}
    for r in got.collect():
        e = exact[r.upload_id, r.ordinal]
        assert abs(r.unique_count - e) <= 4 * P.DISTINCT_ERROR * e
    assert exact["u", 4] == 3000


def test_merging_is_associative(spark, upload):
    rows, heads = upload
    a, b, c = (P.profile_states(rows.filter(F.col("row_ord") % 3 == k)) for k in range(3))
    one = P.merge_states(P.merge_states(a.unionByName(b)).unionByName(c))
    other = P.merge_states(a.unionByName(P.merge_states(c.unionByName(b))))
    assert _exact(P.profile_of_states(one, heads)) == _exact(P.profile_of_states(other, heads))


def test_approximate_option(spark, upload):
    rows, heads = upload
    assert _exact(P.profile(rows, heads, approximate=True)) == _exact(P.profile(rows, heads))
    with pytest.raises(ValueError):
        P.profile(rows, heads, "compat", approximate=True)
    assert P.profile(rows.limit(0), heads, approximate=True).count() == 0


def test_totals_follow_loads_corrections_and_compaction(spark, tmp_root):
    def same():
        got = SK.read_totals(spark, tmp_root, "region")
        want = C.tenant_totals(SK.read_sales(spark, tmp_root), "region")
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        return {r.revenue for r in got.collect()}

    SK.load_sales(spark, _checked(spark, [("u1", row("a", "2.50")), ("u1", row("b", "x"))]), tmp_root)
    first = same()
    SK.load_sales(spark, _checked(spark, [("u2", row("c", "4"))]), tmp_root)
    assert same() != first
    SK.replace_sales(spark, _checked(spark, [("u1", row("a", "9"))]), tmp_root)
    now = same()
    SK.compact_sales(spark, tmp_root)
    assert same() == now == {13}
    assert {r.revenue for r in SK.read_totals(spark, tmp_root, as_of=1).collect()} == first
    assert dt.date(2024, 1, 1) in {r.month for r in SK.read_totals(spark, tmp_root, "month").collect()}
