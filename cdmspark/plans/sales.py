"""The sales path as plans: raw uploads -> conformed rows -> per-tenant totals."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.local import values_frame
from ..operators import conform as C
from ..session import ensure_checkpoint_dir
from ..sources import sinks, testdata

# A fixed load time keeps registered queries repeatable; a live load passes None (now).
AS_OF = _dt.datetime(2026, 1, 1)


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upload_plans(testdata.sales_headers(spark, sf_dir), testdata.gold_mappings(spark))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conform_checked(testdata.sales_rows(spark, sf_dir), plans(spark, sf_dir), AS_OF)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conform(testdata.sales_rows(spark, sf_dir), plans(spark, sf_dir), AS_OF)


def tenant_region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: conform every upload, then totals per tenant and region."""
    return C.tenant_totals(sales(spark, sf_dir), "region")


def load_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in = rows loaded + rows rejected per upload, while one layout awaits its approval."""
    heads = testdata.sales_headers(spark, sf_dir)
    waiting = testdata.layouts_frame(spark).filter(F.col("layout") == UNAPPROVED).select("layout_id")
    approved = testdata.gold_mappings(spark).join(F.broadcast(waiting), "layout_id", "left_anti")
    rows = testdata.sales_rows(spark, sf_dir)
    return C.load_accounting(rows, C.conform_checked(rows, C.upload_plans(heads, approved), AS_OF))


#: The layout that ``load_accounting`` leaves without a mapping.
UNAPPROVED = 4

#: Per layout: CDM field -> transformation, or None for a column that is not mapped. Layout 2 has an
#: unsupported text, layout 3 a field that two columns claim, layout 4 a date pattern that is none.
TRANSFORMED = {
    0: {"revenue": "x / 100", "discount": "x * 2.5", "units_sold": "x * 3", "product_name": "UPPER(x)",
        "channel": "lower( x )", "date": "TO_DATE(x, 'yyyy-MM-dd')", "net_revenue": None},
    1: {"revenue": "CAST(x AS DECIMAL(10,1))", "product_name": "TRIM(x)", "date": "CAST(x AS DATE)", "net_revenue": None},
    2: {"region": "reverse(x)"},
    3: {"rep_id": "region"},
    4: {"date": "TO_DATE(x, 'foo')"},
    5: {"revenue": "CAST(x AS BIGINT)"},
}


def transformed_mappings(spark: SparkSession) -> DataFrame:
    """The gold pairs with the transformations above (layout 3 sends rep_id's column to region)."""
    rows = []
    for i, rules in TRANSFORMED.items():
        for src, fld, _ in model.LAYOUTS[i][2]:
            if i == 3 and fld in rules:
                rows.append((i, src, rules[fld], None))
            elif fld not in rules:
                rows.append((i, src, fld, None))
            elif rules[fld] is not None:
                rows.append((i, src, fld, rules[fld]))
    pairs = values_frame(spark, rows, "layout int, source_column string, cdm_field string, transformation string")
    return pairs.join(F.broadcast(testdata.layouts_frame(spark).select("layout", "layout_id")), "layout").select(
        "layout_id", "source_column", "cdm_field", "transformation")


def conform_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of transformation over all rows; what cannot run is rejected."""
    plan = C.upload_plans(testdata.sales_headers(spark, sf_dir), transformed_mappings(spark))
    return C.conform(testdata.sales_rows(spark, sf_dir), plan, AS_OF)


def approved_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approve, then load: plans come from the latest approved mapping of each layout, with the
    reviewer's edits, and the rows go through the tenant-partitioned sink."""
    from . import workflow as WP
    from ..operators import workflow as W
    corpus = W.approved_corpus(WP.reviews(spark, sf_dir))
    plan = C.upload_plans(testdata.sales_headers(spark, sf_dir), C.mappings_of_corpus(corpus))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/approved-{uuid.uuid4().hex}"
    sinks.load_sales(spark, C.conform_checked(testdata.sales_rows(spark, sf_dir), plan, AS_OF), root)
    return sinks.read_sales(spark, root)
