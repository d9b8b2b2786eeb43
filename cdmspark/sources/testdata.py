"""The driver's tables in the roles of tenants' sales files.

Sales rows: lineitem joined to its order, customer, part, supplier, and the supplier's nation and
region. ``layout = l_orderkey % 6`` picks which tenant file layout a row belongs to, and the upload
is (layout, ship year). Every value is rendered as text, the way it would sit in a CSV cell.

Raw uploads are the same two frames the CSV reader yields:

* rows    (upload_id, row_ord, vals array<string>)  -- values by position, header excluded
* headers (upload_id, layout_id, customer_id, source_system, file_name, names array<string>)

Three rules plant bad rows on purpose: line 7 of a supplier ending in 0 writes ``n/a`` as revenue and
line 6 of such a supplier an empty SKU (missing required fields); line 5 of such a supplier in the files
of layout ``BAD_DATE_LAYOUT`` writes text after the date (a cast error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions.exprs import layout_id_of
from ..functions.local import values_frame
from ..functions.materialize import materialize_all, table_path
from ..session import settings
from .sinks import append
from .tables import table

N_LAYOUTS = len(model.LAYOUTS)
BAD_DATE_LAYOUT = 3


def layouts_frame(spark: SparkSession) -> DataFrame:
    """The six known layouts: (layout, layout_id, customer_id, source_system, names, fields)."""
    rows = [
        (i, tenant, system, model.layout_names(i), model.layout_fields(i))
        for i, (tenant, system, _) in enumerate(model.LAYOUTS)
    ]
    df = values_frame(
        spark, rows, "layout int, customer_id string, source_system string, names array<string>, "
                     "fields array<string>")
    return df.withColumn("layout_id", layout_id_of(F.col("names")))


def gold_mappings(spark: SparkSession) -> DataFrame:
    """The 77 approved (layout_id, source_column, cdm_field, transformation) pairs."""
    rows = [
        (i, src, fld, None)
        for i, (_, _, cols) in enumerate(model.LAYOUTS)
        for src, fld, _ in cols
    ]
    pairs = values_frame(spark, rows, "layout int, source_column string, cdm_field string, "
                                      "transformation string")
    return (pairs.join(F.broadcast(layouts_frame(spark).select("layout", "layout_id")), "layout")
            .select("layout_id", "source_column", "cdm_field", "transformation"))


def _canonical_values(j: DataFrame) -> dict[str, Column]:
    """Text value of each CDM field for one joined sales row."""
    rev = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = (rev * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,2)")
    qty = F.col("l_quantity").cast("bigint")
    cost = (qty * F.col("p_retailprice").cast("decimal(12,2)")).cast("decimal(18,2)")
    bad_supp = (F.col("l_suppkey") % 10) == 0
    day = F.col("l_shipdate").cast("date").cast("string")
    bad_date = (F.col("l_orderkey") % N_LAYOUTS == BAD_DATE_LAYOUT) & (F.col("l_linenumber") == 5) & bad_supp
    return {
        "date": F.when(bad_date, F.concat(day, F.lit(" or so"))).otherwise(day),
        "customer_id": F.concat(F.lit("ACC_"), F.col("o_custkey").cast("string")),
        "customer_name": F.col("c_name"),
        "product_sku": F.when((F.col("l_linenumber") == 6) & bad_supp, F.lit(""))
                        .otherwise(F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"))),
        "product_name": F.col("p_name"),
        "product_category": F.col("p_type"),
        "channel": F.col("o_orderpriority"),
        "region": F.col("r_name"),
        "units_sold": qty.cast("string"),
        "revenue": F.when((F.col("l_linenumber") == 7) & bad_supp, F.lit("n/a"))
                    .otherwise(rev.cast("string")),
        "discount": disc.cast("string"),
        "net_revenue": (rev - disc).cast("decimal(18,2)").cast("string"),
        "cost": cost.cast("string"),
        "margin": (rev - cost).cast("decimal(18,2)").cast("string"),
        "store_id": F.concat(F.lit("STORE_"), F.col("l_suppkey").cast("string")),
        "rep_id": F.concat(F.lit("REP_"), F.col("l_suppkey").cast("string")),
    }


ROW_ORDER_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def _upload_id(layout: Column, year: Column) -> Column:
    return F.concat(F.lit("U"), layout.cast("string"), F.lit("_"), year.cast("string"))


def _layout() -> Column:
    return (F.col("l_orderkey") % N_LAYOUTS).cast("int")


#: Columns of a line that its upload and cells are made from.
CELL_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]


def _sales_lines(spark: SparkSession, sf_dir: str, *lines: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Every line with the columns of its order, customer, part and region that its cells are made from.
    ``lines``: columns of the line (all by default). ``part`` (k, n): the k-th of n parts, by order."""
    def mine(df: DataFrame, key: str) -> DataFrame:
        k, n = part
        return df if n == 1 else df.filter(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)) == k)
    li = mine(table(spark, sf_dir, "lineitem", *(lines or ROW_ORDER_COLUMNS)), "l_orderkey")
    o = mine(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_retailprice")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    # nation and region have a fixed size (25 and 5 rows), so broadcasting them is bounded.
    n = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"))
    r = F.broadcast(table(spark, sf_dir, "region", "r_regionkey", "r_name"))
    # narrow sides first, so that the lines move once per large side, and each value is rendered once
    oc = o.join(c, F.col("o_custkey") == c.c_custkey)
    sr = s.join(n, F.col("s_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    j = (li.join(oc, li.l_orderkey == F.col("o_orderkey"))
         .join(p, li.l_partkey == p.p_partkey)
         .join(sr.select("s_suppkey", "r_name"), li.l_suppkey == F.col("s_suppkey")))
    return j.select(*li.columns, "o_custkey", "o_orderpriority", "c_name", "p_name", "p_type", "p_retailprice", "r_name")


def _cells(lines: DataFrame) -> DataFrame:
    """Every sales row with its upload, layout, the columns of its line and its text per CDM field (``cell_``)."""
    return lines.select(_upload_id(_layout(), F.year("l_shipdate")).alias("upload_id"),
                        *[c for c in lines.columns if c in ROW_ORDER_COLUMNS], _layout().alias("layout"),
                        *[c.alias(f"cell_{f}") for f, c in _canonical_values(lines).items()])


def _by_position(cells: DataFrame, order: list[str], stored: bool = False) -> DataFrame:
    """(upload_id, row_ord, vals) of rows with their cells by field; ``stored``: rendered from stored lines."""
    vals = None
    for i in range(N_LAYOUTS):
        arr = F.array(*[F.col(f"cell_{f}") for f in model.layout_fields(i)])
        vals = F.when(F.col("layout") == i, arr) if vals is None else vals.when(F.col("layout") == i, arr)
    # no filter is pushed below a column that is not repeatable: it would take a copy of every cell with it
    as_read = F.when(F.monotonically_increasing_id() >= 0, vals)
    return cells.select("upload_id", F.struct(*order).alias("row_ord"), (as_read if stored else vals).alias("vals"))


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of all sales uploads: (upload_id, row_ord, vals)."""
    return _by_position(_cells(_sales_lines(spark, sf_dir)), ROW_ORDER_COLUMNS)


def sales_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header row per upload, from a two-column scan of lineitem (no join, no row pass)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate")
    ups = (li.select((F.col("l_orderkey") % N_LAYOUTS).cast("int").alias("layout"),
                     F.year("l_shipdate").alias("year"))
           .distinct())
    lay = F.broadcast(layouts_frame(spark))
    return (ups.join(lay, "layout")
            .select(
                _upload_id(F.col("layout"), F.col("year")).alias("upload_id"),
                "layout_id", "customer_id", "source_system",
                F.concat(F.lower("customer_id"), F.lit("_"), F.lower("source_system"),
                         F.lit("_data_"), F.col("year").cast("string"), F.lit(".csv"))
                .alias("file_name"),
                "names"))


#: A join hashes its smaller side where no partition of it is larger than this, in place of sorting both.
HASHED_PARTITION = "64m"
#: Lines are joined in so many parts at most, of this many lines at least, one after the other.
MOST_PARTS, LINES_A_PART = 8, 1 << 20


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the lines are worked on in where a step would shuffle them all."""
    return min(MOST_PARTS, max(1, table(spark, sf_dir, "lineitem").count() // LINES_A_PART))


def _parts_of_lines(spark: SparkSession, sf_dir: str, *lines: str) -> list[DataFrame]:
    n = parts(spark, sf_dir)
    return [_sales_lines(spark, sf_dir, *lines, part=(k, n)) for k in range(n)]


def landed_lines(spark: SparkSession, sf_dir: str, *lines: str) -> DataFrame:
    """``_sales_lines``, stored."""
    with settings(spark, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED_PARTITION):
        return materialize_all(_parts_of_lines(spark, sf_dir, *lines))


def landed_rows(spark: SparkSession, sf_dir: str, *order: str) -> DataFrame:
    """The sales rows written once to the shared checkpoint folder, as uploaded files would be
    landed before any work on them; every later branch reads the files, not the 7-way join. The joined lines
    are stored and their cells rendered when read, as texts of numbers take several times the space; the join
    runs in parts, so that a part's shuffles are gone before the next. ``order``: the columns of ``row_ord``
    that the caller reads (all by default)."""
    kept = list(order or ROW_ORDER_COLUMNS)
    stored = [c for c in ROW_ORDER_COLUMNS if c in kept or c in CELL_COLUMNS]
    return _by_position(_cells(landed_lines(spark, sf_dir, *stored)), kept, stored=True)


def delivered_rows(spark: SparkSession, sf_dir: str, deliveries: int) -> list[DataFrame]:
    """The sales rows, landed in so many deliveries by a hash of the row's place: all of them, and then those of
    each delivery, which reads its own files."""
    path, place = table_path(spark), F.struct(*ROW_ORDER_COLUMNS)
    with settings(spark, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED_PARTITION):
        for lines in _parts_of_lines(spark, sf_dir):
            append(lines.withColumn("delivery", F.pmod(F.xxhash64(place), F.lit(deliveries)).cast("int")), path, ["delivery"])
    schema = T.StructType([*lines.schema.fields, T.StructField("delivery", T.IntegerType())])
    landed = spark.read.schema(schema).parquet(path)
    return [_by_position(_cells(landed.filter(mine).drop("delivery")), ROW_ORDER_COLUMNS, stored=True)
            for mine in (F.lit(True), *[F.col("delivery") == k for k in range(deliveries)])]
