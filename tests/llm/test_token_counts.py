import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cdmspark.llm import token_counts as C
from cdmspark.llm.common import new_folder
from tests.conftest import SF_SMALL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(1, "some words"), (2, None), (3, ""), (4, " "), (5, "some words"), (None, "some words"), (None, "no id"), (None, "no id"),
        (6, "twice"), (6, "twice"), (6, "another"), (7, "x\x00y <s> </s> <unk> ▁ <|endoftext|>"), (8, "é" * 300_000), (9, "long words " * 40_000)] + [
        (100 + k, "hot text") for k in range(400)]
SCHEMA = "doc_id long, text string"


def library(path, texts):
    if path == PIECES:
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]


def brute(path, rows):
    texts = [t or "" for _, t in rows]
    return sorted(((i, len(t.encode()), n) for (i, _), t, n in zip(rows, texts, library(path, texts))), key=str)


def run(df, counter, root):
    return sorted((tuple(r) for r in C.token_counts(df, counter, root).collect()), key=str)


@pytest.mark.parametrize("path", [PIECES, WORDS])
def test_odd_rows(spark, path):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in ROWS], SCHEMA + ", digest int, n_tokens string, `a.b` int")
    root, counter = new_folder(spark, "counts"), C.TokenCounter(path)
    assert run(df, counter, root) == brute(path, ROWS)
    cached = C.CountCache(spark, root, counter.version()).read()
    assert cached.count() == len({t or "" for _, t in ROWS})


def test_only_missing_texts_are_encoded(spark):
    root, counter = new_folder(spark, "counts"), C.TokenCounter(PIECES)
    first, more = [(1, "a b c"), (2, "d e")], [(1, "a b c"), (3, "d e"), (4, "f g h i"), (5, "f g h i"), (6, "j")]
    cache = C.CountCache(spark, root, counter.version())
    assert run(spark.createDataFrame(first, SCHEMA), counter, root) == brute(PIECES, first)
    # a false count shows that stored ones are taken
    cache.append(spark.createDataFrame([(hashlib.sha256(b"a b c").digest(), -5)], C.CACHE_DDL))
    before = spark.read.parquet(cache.folder).count()
    got = run(spark.createDataFrame(more, SCHEMA), counter, root)
    want = {t: n for t, n in zip([t for _, t in more], library(PIECES, [t for _, t in more]))} | {"a b c": -5}
    assert got == sorted(((i, len(t), want[t]) for i, t in more), key=str)
    assert spark.read.parquet(cache.folder).count() == before + 2
    files = spark.read.parquet(cache.folder).inputFiles()
    run(spark.createDataFrame(more, SCHEMA), counter, root)
    assert spark.read.parquet(cache.folder).inputFiles() == files


def test_repeated_appends_change_nothing(spark):
    root, counter = new_folder(spark, "counts"), C.TokenCounter(PIECES)
    cache = C.CountCache(spark, root, counter.version())
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = run(df, counter, root)
    cache.append(spark.createDataFrame(cache.read().collect(), C.CACHE_DDL))
    assert run(df, counter, root) == want


def test_versions_are_apart(spark):
    assert C.TokenCounter(PIECES).version() != C.TokenCounter(WORDS).version()
    root, df = new_folder(spark, "counts"), spark.createDataFrame(ROWS[:9], SCHEMA)
    for path in (PIECES, WORDS):
        assert run(df, C.TokenCounter(path), root) == brute(path, ROWS[:9])


@pytest.mark.parametrize("wanted", [2, 30])
def test_few_and_many_misses(spark, wanted):
    """Few misses are picked out of the documents, many found among all distinct texts."""
    rows = [(k, f"text {k}") for k in range(40)] + [(k, "same") for k in range(3)] * 2
    root, counter = new_folder(spark, "counts"), C.TokenCounter(PIECES)
    known = rows[wanted:40]
    run(spark.createDataFrame(known, SCHEMA), counter, root)
    assert run(spark.createDataFrame(rows, SCHEMA), counter, root) == brute(PIECES, rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert run(df, C.TokenCounter(PIECES), new_folder(spark, "counts")) == []


def test_invalid_bytes_count_as_replacement_characters(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(x'61ff62' as string)").alias("text"))
    text = "a�b"
    assert run(df, C.TokenCounter(PIECES), new_folder(spark, "counts")) == [(1, len(text.encode()), library(PIECES, [text])[0])]


def test_query_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in C.op11_token_counts(spark, SF_SMALL).collect()), key=str)
    assert got == sorted(((i, n, k, k > 4096) for i, n, k in brute(PIECES, rows)), key=str)
