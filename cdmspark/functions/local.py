"""Small fixed tables as in-plan literals (a local relation with known size, no Python RDD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def values_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of ``rows`` built from literals; for tens of rows of fixed values only."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], st)
    structs = []
    for r in rows:
        cols = []
        for v, f in zip(r, st.fields):
            lit = F.lit(v) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v])
            if isinstance(v, (list, tuple)) and not v:
                lit = F.array()
            cols.append(lit.cast(f.dataType).alias(f.name))
        structs.append(F.struct(*cols))
    return spark.range(1).select(F.inline(F.array(*structs)))
