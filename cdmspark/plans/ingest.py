"""Queries of the CSV source: records over splits and line ends, refused files."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import ensure_checkpoint_dir
from ..sources import csv_uploads as CU
from ..sources import testdata as TD
from ..sources.tables import table
from . import oracle_sales as OS
from .registry import register

#: Small splits, so that records and quoted cells lie across them at any table size.
SPLIT_BYTES = "65536"


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{what}-{uuid.uuid4().hex}"


@contextmanager
def _small_splits(spark: SparkSession):
    names = {"spark.sql.files.maxPartitionBytes": SPLIT_BYTES, "spark.sql.files.openCostInBytes": SPLIT_BYTES}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def write_conversations(spark: SparkSession, sf: str, root: str) -> None:
    """Conversations as CSV uploads of Spark's own writer, LF for even ids and CRLF for odd ones, whose
    texts hold line breaks, commas and quotes."""
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    for odd, end in enumerate(["\n", "\r\n"]):
        (rows.filter(F.col("conv_id") % 2 == odd)
         .write.option("header", True).option("lineSep", end).option("escape", '"').option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{root}/customer_id=C{odd}/source_system={'CRLF' if odd else 'LF'}"))


@register("csv_quoted_records", """
  SELECT conv_id, turn, role, source_system, length(t) AS n_chars, sha256(t) AS text_sha256
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, CASE WHEN conv_id % 2 = 0 THEN 'LF' ELSE 'CRLF' END AS source_system,
               CASE WHEN conv_id % 2 = 0 THEN coalesce(text, '')
                    ELSE replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) END AS t FROM conversations) x""")
def csv_quoted_records(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with line breaks in files of many splits, LF and CRLF (whose writer also ends the lines
    inside cells in CRLF); every record comes back whole and once."""
    root = _fresh(spark, "quoted")
    write_conversations(spark, sf, root)
    with _small_splits(spark):
        up = CU.scan_uploads(spark, root)
    cell = {n: F.get("vals", F.array_position("names", n).cast("int") - 1) for n in ("conv_id", "turn", "role", "text")}
    text = F.coalesce(cell["text"], F.lit(""))
    return up.rows.join(up.headers.select("upload_id", "names", "source_system"), "upload_id").select(
        cell["conv_id"].cast("bigint").alias("conv_id"), cell["turn"].cast("bigint").alias("turn"),
        F.coalesce(cell["role"], F.lit("")).alias("role"), "source_system",
        F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


#: What the files of an upload hold, by (layout + year) % 5.
REFUSAL_KINDS = [
    ("good", ["a,b", '1,"x"'], None),
    ("blank", ["\t", " "], "no columns to read: the file is empty"),
    ("endless", ["a,b", '1,"never', "2,3"], "a quoted cell never ends"),
    ("late", [" ", "\t", "a", "1"], None),
    ("text", ["a,b", "1,2"], "unsupported file type"),
]


def _refusal_sql() -> str:
    rows = ", ".join(f"({i}, {'NULL' if why is None else repr(why)}, '{sum(len(x) + 1 for x in lines)} B')"
                     for i, (_, lines, why) in enumerate(REFUSAL_KINDS))
    return f"""
  WITH kinds(kind, error_message, size_label) AS (VALUES {rows}),
  ups AS (SELECT DISTINCT layout, year(l_shipdate) AS year FROM ({OS.JOINED}) j)
  SELECT concat('U', layout, '_', year) AS upload, kinds.error_message, kinds.size_label
  FROM ups JOIN kinds ON kind = (layout + year) % {len(REFUSAL_KINDS)}
  UNION ALL SELECT 'none', 'no columns to read: the file is empty', '0 B'"""


@register("refused_uploads", _refusal_sql())
def refused_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S2: every file of the upload folder with the reason it is refused for, or none: blank files,
    an empty one, cells that never end, other file types; a header after blank lines is found."""
    root = _fresh(spark, "refused")
    kinds = F.create_map(*[x for i, (_, lines, _) in enumerate(REFUSAL_KINDS)
                           for x in (F.lit(i), F.array(*[F.lit(v) for v in lines]))])
    ups = TD.sales_headers(spark, sf).select("upload_id", (F.expr(
        "cast(substring(upload_id, 2, 1) as int) + cast(substring_index(upload_id, '_', -1) as int)")
        % len(REFUSAL_KINDS)).alias("kind"))
    lines = ups.select("upload_id", "kind", F.posexplode(F.element_at(kinds, F.col("kind"))).alias("i", "line"))
    text = [i for i, k in enumerate(REFUSAL_KINDS) if k[0] == "text"]
    out = lines.repartition("upload_id").sortWithinPartitions("upload_id", "i")
    out.filter(F.col("kind").isin(text)).select("upload_id", "line").write.partitionBy("upload_id").text(f"{root}/text")
    (out.filter(~F.col("kind").isin(text)).select("upload_id", "line").write.partitionBy("upload_id")
     .option("sep", "\u0001").option("quote", "\u0000").option("emptyValue", "").option("escapeQuotes", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/csv"))
    lines.select("line").limit(0).write.csv(f"{root}/csv/upload_id=none")
    up = CU.scan_uploads(spark, f"{root}/csv")
    other = CU.refused_files(spark, f"{root}/text")
    read = up.headers.select("file_path", "file_size", F.lit(None).cast("string").alias("error_message"))
    both = read.unionByName(up.refused.unionByName(other).select("file_path", "file_size", "error_message"))
    upload = F.regexp_extract("file_path", "/upload_id=([^/]+)/", 1)
    mine = both.filter(~F.element_at(F.split("file_path", "/"), -1).startswith("_"))
    return mine.select(upload.alias("upload"), "error_message", X.file_size_label(F.col("file_size")).alias("size_label"))
