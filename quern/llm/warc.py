"""WARC archives compressed record by record with a shared Zstandard dictionary.

Writer: a dictionary is trained on a bounded sample of the records as they are
archived, headers included, and embedded in a skippable frame at the head of
every archive file (of the sample itself where it is too small to train on);
each record is a frame of its own that refers to it, so a reader can start at any
record.  Equal payloads of at least ``min_revisit`` bytes are stored once, as the
response with the largest id; the others become revisit records.

Archives are bounded files in a folder all executors share.  A task writes each
file under a name of its own and the manifest lists the files of the attempts
that succeeded, so a lost executor or a repeated task leaves at most files that
nobody reads.

Defined results: a null payload is empty; a null url is written as an empty
target; a record is named by id and digest, so that only rows equal in both share
a name; a null id is written as an empty one, comes back as null and is always a
response; rows that repeat an id are written one by one, and if theirs is the
largest id of a payload all of them are responses; payloads of any length are one
record; an empty table writes
no file and reads back empty; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

#: Magic number of the skippable frame that carries a dictionary.
DICT_MAGIC = 0x184D2A5D
MIN_REVISIT = 1000
SAMPLE_ROWS = 1000
SAMPLE_RECORD = 128 << 10  # larger payloads are not trained on; the trainer looks at no more of one
SAMPLE_BYTES = 16 << 20
DICT_BYTES = 112_640
FILE_BYTES = 64 << 20
MAX_IN_FILE = 1 << 20
BUFFER = 1 << 20
SLICE = 1 << 12
DATE = "2000-01-01T00:00:00Z"


def _open(path: str, mode: str):
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    where, name = fs.FileSystem.from_uri(path)
    if mode == "rb":
        return where.open_input_stream(name, compression=None)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    return where.open_output_stream(name, compression=None)


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary trained on records; too few or too short ones serve as a raw dictionary instead."""
    import zstandard

    if not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def record_of(row: dict) -> bytes:
    """One WARC/1.1 record; the payload of a revisit is left out."""
    revisit = row["revisit"]
    body = b"" if revisit else (row["payload"] or b"")
    number = lambda x: "" if x is None else str(x)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{number(row['id'])}:{row['digest']}>"),
        ("WARC-Target-URI", (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("Payload-Length", str(row["size"])),
    ]
    if revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{number(row['refers_to'])}:{row['digest']}>"),
        ]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def write_archives(rows: DataFrame, dictionary: bytes, folder: str) -> DataFrame:
    """Write rows (id, url, payload, digest, size, revisit, refers_to); the manifest (path, records, bytes)."""
    names = ("id", "url", "payload", "digest", "size", "revisit", "refers_to")

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, path, n, size = None, "", 0, 0
        done = []
        for b in batches:
            for values in zip(*(b.column(k) for k in range(len(names)))):
                row = dict(zip(names, (v.as_py() for v in values)))
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = _open(path, "wb")
                    out.write(skippable(dictionary))
                frame = packer.compress(record_of(row))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= FILE_BYTES or n >= MAX_IN_FILE:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            p, m, s = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(m, pa.int64()), pa.array(s, pa.int64())], names=["path", "records", "bytes"])

    return rows.select(*names).mapInArrow(run, "path string, records long, bytes long")


def _frames(stream):
    """Records of an archive, one frame at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = stream.read(size)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data, at = b"", 0
    while True:
        if at == len(data):
            data, at = stream.read(BUFFER), 0
            if not data:
                return
        parts, one = [], opener.decompressobj()
        while True:
            # A frame is fed in slices, so that what is left over after it stays small.
            piece = data[at : at + SLICE]
            parts.append(one.decompress(piece))
            at += len(piece)
            if one.eof:
                at -= len(one.unused_data)
                break
            if at == len(data):
                data, at = stream.read(BUFFER), 0
                if not data:
                    raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives at ``path``, in whole."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path, "rb") as stream:
                    rows, held = [], 0
                    for data in _frames(stream):
                        f, body = parse_record(data)
                        rows.append((f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Type"], f["WARC-Payload-Digest"], int(f["Payload-Length"]), f.get("WARC-Refers-To"), body))
                        held += len(body)
                        if held >= 8 << 20 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    files = manifest.select("path").repartition(F.col("path"))
    return files.mapInArrow(run, "record_id string, url string, record_type string, digest string, payload_bytes long, refers string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "url", "record_type", "digest", "payload_bytes", "refers", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _sampled(rows: DataFrame) -> list[bytes]:
    """Whole records to train on: at most ``SAMPLE_ROWS`` and ``SAMPLE_BYTES``, those with the smallest hash of digest and id.

    The hashes are chosen first: only they are gathered from every task.
    """
    hashed = rows.where((F.col("size") > 0) & (F.col("size") <= SAMPLE_RECORD) & ~F.col("revisit")).withColumn("h", F.xxhash64("digest", "id"))
    total, top = 0, None
    for r in hashed.select("h", "size").orderBy("h").limit(SAMPLE_ROWS).collect():
        total += r["size"]
        if total > SAMPLE_BYTES:
            break
        top = r["h"]
    if top is None:
        return []
    chosen = hashed.where(F.col("h") <= F.lit(top)).limit(SAMPLE_ROWS)
    return sorted(record_of(r.asDict()) for r in chosen.collect())


def archive(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> DataFrame:
    """Write all rows as WARC records into ``folder``; returns the manifest of the archives."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    large = rows.where(F.col("size") >= min_revisit).select("id", "digest")
    # Pre-aggregated: one row per payload that occurs again.  Only ids and digests meet here.
    again = large.groupBy("digest").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = large.distinct().join(again, "digest").where("id <> kept").withColumnRenamed("digest", "same")
    keyed = rows.join(
        marked.select(F.col("id").alias("other"), "same", "kept"), (F.col("id") == F.col("other")) & (F.col("digest") == F.col("same")), "left"
    )  # by id: however common a payload is, its rows are dealt out evenly
    revisit = F.col("kept").isNotNull()
    out = keyed.select(
        "id", "url", "payload", "digest", "size", revisit.alias("revisit"), F.col("kept").alias("refers_to"),
    )
    dictionary = build_dictionary(_sampled(out))
    return stash(write_archives(out, dictionary, folder), "manifest")


def op1_warc_writer(spark, sf_dir):
    """Archive all pages and read every record back."""
    records = read_archives(archive(table(spark, sf_dir, "pages")))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_extract("digest", "^sha1:(.*)$", 1)).alias("payload_digest"),
        "record_type",
        F.when(~response, number("refers")).alias("refers_to"),
    )


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) body from pages),
d as (select page_id, octet_length(body)::bigint n, sha1(body) s from p),
k as (select *, max(page_id) over (partition by s) kept from d)
select page_id, n payload_bytes, s payload_digest,
  case when n >= 1000 and page_id <> kept then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id <> kept then kept end refers_to
from k
"""
