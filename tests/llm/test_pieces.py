import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cdmspark.llm.pieces import decode, encode, model, op4_sentencepiece, public_model
from tests.conftest import SF_SMALL

SP = sentencepiece.SentencePieceProcessor(model_file=public_model())
M = model(public_model())
NORMAL = {SP.id_to_piece(i): (i, SP.get_score(i)) for i in range(SP.get_piece_size())
          if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i) or SP.is_unused(i))}
WORST = min(s for _, s in NORMAL.values()) - 10


def brute(text):
    """Best segmentation of the whole text at once, one cell at a time."""
    if not text:
        return []
    s = ["▁"] + ["▁" if c == " " else "\0mark" if c == "▁" else c for c in text]
    best = [(0.0, 0, ())]
    for e in range(1, len(s) + 1):
        cand = []
        for n in range(min(16, e), 0, -1):
            got = NORMAL.get("".join(s[e - n:e]))
            if got:
                cand.append((best[e - n][0] + got[1], n, (got[0],)))
            elif n == 1:
                raw = ("▁" if s[e - 1] == "\0mark" else s[e - 1]).encode()
                cand.append((best[e - 1][0] + WORST, 1, tuple(SP.piece_to_id(f"<0x{b:02X}>") for b in raw)))
        best.append(max(cand, key=lambda c: (c[0], c[1])))
    out, e = [], len(s)
    while e:
        out.append(best[e][2])
        e -= best[e][1]
    return [i for ids in reversed(out) for i in ids]


TEXTS = ["", "a", " ", "   ", "Hello  world", " lead", "trail ", "a\n\nb \n c", "é▁x ▁", "日本語 テキスト \U0001F600", "tab\there\r\n",
         "supercalifragilisticexpialidocious antidisestablishmentarianism", "x" * 3000, "aaaa bbbb " * 50, "\x00\x01 zero", "İ ß ſ é"]


@pytest.mark.parametrize("text", TEXTS)
def test_against_brute_force(text):
    ids = np.frombuffer(M.encode([text])[0], "<i4").tolist()
    assert ids == brute(text)
    assert M.decode(ids) == text
    assert SP.decode(ids) == text.replace("\0", "\0")


def test_batches_and_cache_agree():
    alone = [M.encode([t])[0] for t in TEXTS]
    M.known.clear()
    assert M.encode(TEXTS + TEXTS) == alone + alone


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    got = df.select("doc_id", "text", encode(F.col("text"), public_model()).alias("n")).select(
        "*", decode(F.col("n"), public_model()).alias("back")).collect()
    assert all(r.back == (r.text or "") and r.n == brute(r.text) for r in got) and len(got) == len(TEXTS) + 1
    assert df.limit(0).select(encode(F.col("text"), public_model())).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = op4_sentencepiece(spark, SF_SMALL).collect()
    assert len(got) == len(docs) and all(r.decoded for r in got)
    for r in got[:60]:
        ids = brute(docs[r.doc_id])
        assert r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
