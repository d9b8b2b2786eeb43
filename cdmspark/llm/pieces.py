"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text gets the dummy prefix, spaces become the mark U+2581, and the segmentation of the highest sum
of piece scores wins (among equals, the longest last piece). No piece of the vocabularies in use
holds a mark after another character or a line end, which is checked when a model is loaded, so the
best segmentation of a text is that of its words one by one. The distinct words of a batch advance
together by length: hashes of all substrings that end at one place probe the sorted piece hashes,
and the maxima store backpointers. Ids of words are kept per worker in a bounded table.

Characters outside the vocabulary become byte pieces; so does a U+2581 in the text itself, which
keeps decoding exact. Decoding joins the pieces' bytes, turns marks to spaces and takes the dummy
prefix off.

The library's own encoder merges pairs by rank for models of kind BPE; this operator takes their
ranks as scores and maximises the sum, so its ids can differ from the library's while its decoding
gives the same text. The library is used to read the model file only.

Defined results: a null or empty text has no pieces; rows repeat as they do in the input; a word of
any length is one row of its own batch; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, whole_text

MARK, OWN_MARK = 0x2581, 0x110000
WORDS_KEPT, CHARS, CELLS = 200_000, 1 << 21, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

_MODELS: dict[str, "PieceModel"] = {}


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of the rows of code points, one column more than ``codes``."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
    return out


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = {i: int(pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (i in byte or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.byte_id = {b: i for i, b in byte.items()}
        self.bytes = [b"" if i not in byte else bytes([byte[i]]) for i in range(n)]
        for i in normal:
            self.bytes[i] = pieces[i].replace("▁", " ").encode("utf-8")
        self.longest = max(len(pieces[i]) for i in normal)
        key = np.array([_hashes(np.array([[ord(c) for c in pieces[i]]], np.uint64))[0, -1] for i in normal], np.uint64)
        score = np.array([sp.get_score(i) for i in normal])
        if len(np.unique(key)) != len(key):
            raise ValueError("two pieces share a hash")
        order = np.argsort(key)
        self.keys, self.ids, self.scores = key[order], np.array(normal, np.int32)[order], score[order]
        self.miss = float(score.min()) - 10.0
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.repeat(BASE, self.longest)])
        # where no piece crosses, a text falls into words
        crossing = any(re.search("[^▁]▁", pieces[i]) for i in normal)
        line_ends = any("\n" in pieces[i] for i in normal)
        self.cut = re.compile("[\\s\\S]+" if crossing else " *[^ ]+| +" if line_ends else " *[^ \\n]+|\\n| +")
        self.known: dict[str, bytes] = {}

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of words of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
        codes = np.where(codes == MARK, OWN_MARK, np.where(codes == 32, MARK, codes)).astype(np.uint64)
        w, n = codes.shape
        h = _hashes(codes)
        best = np.zeros((w, n + 1))
        back = np.zeros((w, n + 1), np.int32)
        piece = np.full((w, n + 1), -1, np.int32)
        rows = np.arange(w)
        for end in range(1, n + 1):
            lens = np.arange(min(self.longest, end), 0, -1)  # longest first, which argmax prefers
            sub = h[:, end, None] - h[:, end - lens] * self.power[lens]
            at = np.searchsorted(self.keys, sub.ravel()).reshape(sub.shape)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == sub
            total = best[:, end - lens] + np.where(hit, self.scores[at], -np.inf)
            total[:, -1] = np.where(hit[:, -1], total[:, -1], best[:, end - 1] + self.miss)
            pick = total.argmax(1)
            best[:, end] = total[rows, pick]
            back[:, end] = lens[pick]
            piece[:, end] = np.where(hit[rows, pick], self.ids[at[rows, pick]], -1)
        steps, at = [], np.full(w, n)
        while at.any():
            steps.append(np.where(at > 0, piece[rows, at], -2))
            at = at - np.where(at > 0, back[rows, at], 0)
        grid = np.array(steps[::-1]).T
        keep = grid != -2
        size = keep.sum(1)
        flat = grid[keep].astype("<i4")
        ends = np.cumsum(size)
        if (flat == -1).any():
            return [self._bytes_for(word, flat[e - k:e].tolist()) for word, e, k in zip(words, ends, size)]
        raw = flat.tobytes()
        return [raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), size.tolist())]

    def _bytes_for(self, word: str, ids: list[int]) -> bytes:
        """The word's ids with its uncovered characters as bytes."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.bytes[i].decode("utf-8"))
            else:
                out += [self.byte_id.get(b, self.unknown) for b in word[at].encode("utf-8")]
                at += 1
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text; about ``CHARS`` characters are split at a time."""
        out: list[bytes] = []
        group: list[str] = []
        room = CHARS
        for t in texts:
            group.append(t)
            room -= len(t)
            if room <= 0:
                out += self._encode(group)
                group, room = [], CHARS
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [self.cut.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, by_length = self.known, {}
        for word in {x for words in split for x in words if x not in known}:
            by_length.setdefault(len(word), []).append(word)
        for n, words in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest)))
            for a in range(0, len(words), step):
                part = words[a:a + step]
                known.update(zip(part, self._segment(part)))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(text: Column, path: str) -> Column:
    """The ids of a text as array<int>."""
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(x, "<i4") for x in model(path).encode(list(texts))], dtype=object)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """The text of an array<int> of ids; null for null."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([None if x is None else model(path).decode(x) for x in rows], dtype=object)

    return run(ids)


def encoded(text: Column, path: str, with_ids: bool = True) -> Column:
    """Per text a struct: ids (if wanted), n_pieces, the unsigned crc32 of the little-endian int32
    ids, and whether the ids decode to the text."""
    kind = "n_pieces bigint, ids_crc32 bigint, decoded boolean"

    @F.pandas_udf(f"ids array<int>, {kind}" if with_ids else kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            m, texts = model(path), list(texts)
            ids = m.encode(texts)
            out = {"ids": [np.frombuffer(x, "<i4") for x in ids]} if with_ids else {}
            yield pd.DataFrame(out | {
                "n_pieces": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids],
                "decoded": [m.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(ids, texts)]})

    return run(F.coalesce(text.cast("string"), F.lit("")))


def public_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", encoded(whole_text(), public_model(), with_ids=False).alias("r")).select("doc_id", "r.*")
