"""WARC archives: written with an index, read back by coalesced byte ranges of the selected records.

Every input row becomes one record in its own gzip member. Of rows with equal payloads of at least
``MIN_REVISIT`` bytes, the one with the largest page_id holds the payload (response) and the others
refer to it (revisit, identical-payload-digest). The index (file, offset, length, url, digest,
page_id, record_type) is what Spark commits: a task that runs twice leaves a file that no index row
names. Reading groups the selected index rows by file and slot of ``SLOT`` bytes, sorts each group
and joins reads whose gap is at most ``GAP``.

Files are written through ``pyarrow.fs`` below the shared folder.

Defined results: a null html is the empty payload; rows equal in page_id and payload are responses
alike; null page_ids sort below all others; a missing url is written as the record's own name; an
empty table gives an empty result. Very long payloads pass one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, small_batches, store, table
from .token_files import open_folder, read_range

MIN_REVISIT, SLOT, GAP, FILE_BYTES = 1000, 4 << 20, 64 << 10, 1 << 30
TASK_BYTES, MAX_TASKS = 16 << 20, 100_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.strip("<>").rsplit(":", 1)[1]
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace")) if url else \
        _name(page_id).strip("<>").encode()
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            b"WARC-Record-ID: " + _name(page_id).encode(), b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + target,
            b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1))]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + _name(refers_to).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse(member: bytes) -> dict:
    """Fields of one record; a response's payload is measured, a revisit's are its headers'."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise OSError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise OSError("a WARC payload differs from its digest")
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stated,
            "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None}


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit). Only digests are grouped; pages meet the
    table of repeated digests, which Spark broadcasts when it is small and else joins."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = rows.join(store(repeated, "repeated"), "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return met.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("last")).alias("refers_to"),
                      revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``decide`` as archives; returns the committed index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        system, path = open_folder(folder)
        for b in batches:
            index: dict[str, list] = {k: [] for k in ("file", "offset", "length", "url", "digest", "page_id", "record_type")}
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to, revisit = (c[i].as_py() for c in b.columns)
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    system.create_dir(path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, payload, digest, refers_to, revisit)
                out.write(member)
                for k, v in zip(index, (name, at, len(member), url, digest, page_id, "revisit" if revisit else "response")):
                    index[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(index, schema=pa.schema([
                ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return store(records.mapInArrow(write, INDEX), "warc-index")


def coalesced(spans: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) spans joined to reads (start, size, spans)."""
    reads: list = []
    for at, n in sorted(spans):
        if reads and at - (reads[-1][0] + reads[-1][1]) <= GAP:
            start, size, inside = reads[-1]
            reads[-1] = (start, max(size, at + n - start), inside + [(at, n)])
        else:
            reads.append((at, n, [(at, n)]))
    return reads


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the selected index rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for b in batches:
            for row in b.to_pylist():
                out = []
                with system.open_input_file(f"{path}/{row['file']}") as f:
                    for start, size, spans in coalesced([(s["offset"], s["length"]) for s in row["spans"]]):
                        raw = memoryview(read_range(f, start, size))
                        out += [parse(raw[at - start:at - start + n]) for at, n in spans]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64())]))

    slots = selected.groupBy("file", F.floor(F.col("offset") / SLOT).alias("slot")).agg(
        F.collect_list(F.struct("offset", "length")).alias("spans"))
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # a count of its own: the rows are small, what a task reads for them is not
    slots = slots.repartition(max(1, min(size // TASK_BYTES, MAX_TASKS)), "file", "slot")
    return slots.select("file", "spans").mapInArrow(
        read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    folder = new_folder(spark, "warc")
    index = write_archives(decide(table(spark, sf_dir, "pages", "page_id", "url", "html")), folder)
    read = store(read_records(index, folder), "warc-read")
    # a revisit's payload is that of the response it names; as a page_id can repeat, of its own digest
    key = ["refers_to", "payload_digest"]
    held = read.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("__n"))
    wanted = read.filter("record_type = 'revisit'")
    asked = wanted.groupBy(key).agg(F.lit(True).alias("asked"))
    held = store(held.join(asked, key, "left_semi").dropDuplicates(key), "warc-held")
    found = wanted.join(held, key, "left").select(
        "page_id", F.col("__n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return read.filter("record_type = 'response'").unionByName(found)


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT *, payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html) AS again,
             max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM g
"""
