"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, SentencePiece ids.

Every stage works on all rows its predecessor kept, is written as Parquet to the shared folder and
read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdmspark.llm import exact_dedup, mixing, pieces, simhash, toxicity
from cdmspark.llm.common import small_batches, store, table, whole_text

#: No SQL: scores are learned, fingerprints and segmentations have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; one without any hit stays, whatever the labels."""
    small_batches(spark)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return docs.filter(~toxicity.rejected(whole_text(), model))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row of the smallest doc_id stays."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's copies of documents; a cut copy has the leading words."""
    return mixing.take_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy's text, with the check that they decode to it."""
    small_batches(spark)
    encoded = pieces.encoded(whole_text(), pieces.public_model())
    return docs.select("doc_id", "lang", "source", encoded.alias("e")).select("doc_id", "lang", "source", "e.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
