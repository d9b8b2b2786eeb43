import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cdmspark.llm.common import new_folder
from cdmspark.llm.token_files import (FrameWriter, WordEncoder, op8_token_files, open_folder, read_documents,
                                      read_frame, read_token_files, seek_table, write_token_files)
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(5, "Hello  World's 42 <|endoftext|>x"), (1, None), (2, ""), (9, "a b　c é\n\t\x0b\x0cD"),
        (7, "word " * 30_000), (None, "null id"), (9, "tie"), (-3, "日本語 Ünï \x1c sep"), (11, "q" * 5000)]


def brute(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_against_brute_force(spark):
    folder = new_folder(spark, "tokens")
    rows = [r for r in ROWS if r != (9, "tie")]
    m = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, 2)
    assert [tuple(r) for r in read_token_files(m, folder).orderBy("start").collect()] == brute(rows)


def test_ties_and_wanted_documents(spark):
    folder = new_folder(spark, "tokens")
    m = write_token_files(spark.createDataFrame(ROWS, "doc_id long, text string"), folder, PATH, 2)
    rows = read_token_files(m, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -3, 1, 2, 5, 7, 9, 9, 11]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    got = read_documents(m, folder, spark.createDataFrame([(2,), (7,), (99,)], "doc_id long")).collect()
    tok = Tokenizer.from_file(PATH)
    assert {r.doc_id: r.ids for r in got} == {2: [2], 7: tok.encode(ROWS[4][1], add_special_tokens=False).ids + [2]}


def test_empty_table(spark):
    folder = new_folder(spark, "tokens")
    m = write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, PATH, 2)
    assert read_token_files(m, folder).count() == 0


@pytest.mark.parametrize("text", [
    "Foo. foo, FOO!! foo's. don't' 'tis x'S. 'LL. É. e\u0301. E\u0301! <|ENDOFTEXT|>. <|endoftext|>. a<|endoftext|>B.",
    "İstanbul. ΣΑΣ. ΣΑΣ ß. Straße!? \u212a. 12.5% a1. a_b_ __a__ -- #x# \u00a0a. x\u2003y. (Foo). [Bar]; ab\x1cCD.",
])
def test_words_apart_give_the_ids_of_the_text(text):
    tok = Tokenizer.from_file(PATH)
    want = np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert WordEncoder(PATH).encode([text, text]) == [want, want]


def test_format_and_damage(tmp_path):
    import zstandard
    system, path = open_folder(str(tmp_path))
    w = FrameWriter(system.open_output_stream(f"{path}/x.zst", compression=None))
    w.frame(b"abc" * 100)
    w.frame(b"second")
    size = w.close()
    raw = (tmp_path / "x.zst").read_bytes()
    assert size == len(raw)
    # any zstandard reader skips the seek table and sees the frames one after another
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"abc" * 100 + b"second"
    with system.open_input_file(f"{path}/x.zst") as f:
        first, second = seek_table(f, size)
        assert read_frame(f, second) == b"second"
        with pytest.raises(Exception):
            read_frame(f, (*first[:3], first[3] ^ 1))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert [tuple(r) for r in op8_token_files(spark, SF_SMALL).orderBy("start").collect()] == brute(rows)
