"""Token ids as binary files of independent zstandard frames, in the zstd seekable format.

A file holds the documents of one doc_id range: data frames of whole documents (ids as
little-endian unsigned 32-bit integers, about ``FRAME_IDS`` ids, at least one document), then one
directory frame (per document: int64 doc_id, uint32 number of ids, uint8 flags, bit 0 for a null
doc_id), then the seek table: a skippable frame with compressed size, decompressed size and the
low 32 bits of XXH64 of every frame's content. A reader fetches the tail, the directory and then
only the frames with documents it wants.

Files are written through ``pyarrow.fs`` below the shared folder, under a name of their own for
each attempt; the manifest that Spark commits lists the attempts that count, so a task that runs
twice leaves at most an unlisted file. A task that cannot read a listed file fails loudly.

Tokens: white space (space, \\t, \\n, \\v, \\f, \\r) always separates words for this vocabulary,
so every distinct word goes through the tokenizers library once per worker and its ids are kept
in a table of ``WORDS_KEPT`` entries, emptied when full.

Defined results: a null or empty text has only the end id; null doc_ids come first; equal
doc_ids are ordered by text; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, small_batches, store, table, whole_text

FRAME_IDS, TASK_BYTES, MAX_TASKS = 1 << 16, 16 << 20, 100_000
WORDS_KEPT = 1_000_000
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1  # zstd seekable format
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")

_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of a text by the tokenizers library, each distinct word encoded once.

    The vocabulary lower-cases, and a letter followed by punctuation always ends a token, so a word's
    closing punctuation and its lower-cased rest are encoded (and kept) apart. A word that may hold
    a special token's text is left whole. Words of plain Latin letters are already as the normaliser
    and the pre-tokenizer would leave them and go straight to the library's BPE model, in its
    byte alphabet; all others take the whole way."""

    TAIL = re.compile(rb"(.*[A-Za-z])([!-/:-@\[-`{-~]+)", re.DOTALL)
    PLAIN = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.latin = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.parts: dict[bytes, bytes] = {}
        encoder = self

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = self[word] = encoder.word(word)
                return ids

        self.words = Words()

    def part(self, part: bytes) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            text = part.decode("utf-8")
            if self.PLAIN.fullmatch(text):
                if not text.isascii():
                    text = text.translate(self.latin)
                found = [t.id for t in self.model.tokenize(text)]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = self.parts[part] = array("I", found).tobytes()
        return ids

    def word(self, word: bytes) -> bytes:
        if b"<|" in word:
            return self.part(word)
        m = self.TAIL.fullmatch(word)
        return self.part(m[1].lower()) + self.part(m[2]) if m else self.part(word.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        for known in (self.words, self.parts):
            if len(known) > WORDS_KEPT:
                known.clear()
        known = self.words.__getitem__
        return [b"".join(map(known, t.encode("utf-8", "replace").split())) for t in texts]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def open_folder(uri: str):
    """(file system, path) of a folder named by a path or URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class FrameWriter:
    """One file in the zstd seekable format."""

    def __init__(self, out):
        import zstandard
        self.out, self.zstd, self.seek, self.at = out, zstandard.ZstdCompressor(level=3), [], 0

    def frame(self, content: bytes) -> None:
        import xxhash
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.at += len(packed)
        self.seek.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> int:
        body = b"".join(ENTRY.pack(*e) for e in self.seek)
        body += FOOTER.pack(len(self.seek), 0x80, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body
        self.out.write(tail)
        self.out.close()
        return self.at + len(tail)


def read_range(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    got = f.read(size)
    if len(got) != size:
        raise OSError("token file is cut short")
    return got


def seek_table(f, file_size: int) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, decompressed size, checksum) of each frame."""
    n, flags, magic = FOOTER.unpack(read_range(f, file_size - FOOTER.size, FOOTER.size))
    if magic != SEEKABLE_MAGIC or not flags & 0x80:
        raise OSError("not a seekable zstandard file with checksums")
    raw = read_range(f, file_size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)
    out, at = [], 0
    for c, d, x in ENTRY.iter_unpack(raw):
        out.append((at, c, d, x))
        at += c
    return out


def read_frame(f, entry: tuple[int, int, int, int]) -> bytes:
    """One frame's content, its checksum verified."""
    import xxhash
    import zstandard
    at, csize, dsize, check = entry
    content = zstandard.ZstdDecompressor().decompress(read_range(f, at, csize), max_output_size=dsize)
    if len(content) != dsize or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
        raise OSError("checksum of a token frame differs")
    return content


def _write_files(folder: str, tokenizer: str, end_id: int):
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, frame, room, ids_total, directory = None, [], FRAME_IDS * 4, 0, []
        enc, first, null_first = encoder(tokenizer), None, False
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                system, path = open_folder(folder)
                system.create_dir(path, recursive=True)
                name = f"{uuid.uuid4().hex}.ids.zst"
                writer = FrameWriter(system.open_output_stream(f"{path}/{name}", compression=None))
                first = b.column(0)[0].as_py()
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for doc_id, ids in zip(doc_ids[at:at + 256], enc.encode(texts[at:at + 256])):
                    ids += end
                    directory.append(struct.pack("<qIB", doc_id or 0, len(ids) // 4, doc_id is None))
                    ids_total += len(ids) // 4
                    frame.append(ids)
                    room -= len(ids)
                    if room <= 0:
                        writer.frame(b"".join(frame))
                        frame, room = [], FRAME_IDS * 4
        if writer is None:
            return
        if frame:
            writer.frame(b"".join(frame))
        writer.frame(b"".join(directory))
        size = writer.close()
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "size": [size], "first_doc": pa.array([first], pa.int64()),
             "n_docs": [len(directory)], "n_ids": [ids_total]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending doc_id order, one file per range; returns the committed
    manifest (part, file, size, first_doc, n_docs, n_ids). ``part`` orders the files."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text")
    files = ranged.mapInArrow(_write_files(folder, tokenizer, end_id),
                              "file string, size bigint, first_doc bigint, n_docs bigint, n_ids bigint")
    return store(files.withColumn("part", F.spark_partition_id()), "manifest")


def _plan_frames(folder: str):
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for b in batches:
            for row in b.to_pylist():
                with system.open_input_file(f"{path}/{row['file']}") as f:
                    *data, last = seek_table(f, row["size"])
                    docs = np.frombuffer(read_frame(f, last), [("id", "<i8"), ("n", "<u4"), ("null", "u1")])
                ends = np.cumsum(docs["n"], dtype=np.int64)
                edge = np.cumsum([d // 4 for _, _, d, _ in data], dtype=np.int64)
                stop = np.searchsorted(ends, edge, "right")
                start = np.concatenate([[0], stop[:-1]]).astype(int)
                for e, i, j, total in zip(data, start, stop, edge):
                    part = docs[i:j]
                    yield pa.RecordBatch.from_pydict({
                        "file": [row["file"]], "offset": [e[0]], "csize": [e[1]], "dsize": [e[2]],
                        "checksum": [e[3]], "start": [int(row["start"] + total - e[2] // 4)],
                        "ids": [[None if z else int(x) for x, z in zip(part["id"], part["null"])]],
                        "counts": [part["n"].astype(np.int64).tolist()]},
                        schema=FRAME_SCHEMA)

    return plan


FRAME_SCHEMA = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("csize", pa.int64()), ("dsize", pa.int64()),
    ("checksum", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64()))])


def _read_frames(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for b in batches:
            for r in b.to_pylist():
                with system.open_input_file(f"{path}/{r['file']}") as f:
                    ids = memoryview(read_frame(f, (r["offset"], r["csize"], r["dsize"], r["checksum"])))
                at, crc, starts = 0, [], []
                for n in r["counts"]:
                    crc.append(zlib.crc32(ids[at:at + 4 * n]))
                    starts.append(r["start"] + at // 4)
                    at += 4 * n
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(r["ids"], pa.int64()), "start": starts,
                     "n_tokens": r["counts"], "ids_crc32": crc})

    return read


def frames(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per data frame from the seek tables and directories. The running start over files
    takes one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))
    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # counts of their own: the rows are small, what a task reads for them is not
    planned = starts.repartition(max(1, min(files, MAX_TASKS)), "file").mapInArrow(
        _plan_frames(folder), "file string, offset bigint, csize bigint, dsize bigint, checksum bigint, "
        "start bigint, ids array<bigint>, counts array<bigint>")
    return planned.repartition(max(1, min(size // TASK_BYTES, MAX_TASKS)), "file", "offset")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return frames(manifest, folder).mapInArrow(
        _read_frames(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(manifest: DataFrame, folder: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted documents only: frames without one are never read."""
    wanted = doc_ids.select(F.col("doc_id").cast("bigint").alias("want")).distinct()
    listed = frames(manifest, folder)
    at = listed.select("file", "offset", F.explode("ids").alias("want")).join(wanted, "want")
    needed = listed.join(at.groupBy("file", "offset").agg(F.collect_set("want").alias("wants")),
                         ["file", "offset"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for b in batches:
            for r in b.to_pylist():
                with system.open_input_file(f"{path}/{r['file']}") as f:
                    ids = np.frombuffer(read_frame(f, (r["offset"], r["csize"], r["dsize"], r["checksum"])), "<u4")
                ends = np.cumsum(r["counts"])
                hit = [(d, ids[e - n:e].astype(np.int64)) for d, n, e in zip(r["ids"], r["counts"], ends)
                       if d in set(r["wants"])]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [d for d, _ in hit], "ids": [x.tolist() for _, x in hit]},
                    schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return needed.mapInArrow(read, "doc_id bigint, ids array<bigint>")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), folder,
                                 public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, folder)
