"""WARC archives: record writing with an index, and reads of byte ranges by that index."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm import exchange

INDEX = "file string, offset long, length long, url string, digest string, record_id long, record_type string"
RECORD = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: A read covers at most this span of a file, and gaps up to GAP between its records.
SPAN, GAP = 16 << 20, 64 << 10
_DATE = "2024-01-01T00:00:00Z"
_BATCH = "application/http; msgtype=response"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder in the shared folder, a URI."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def _urn(record_id: int | None) -> str:
    return f"<urn:record:{'none' if record_id is None else record_id}>"


def record(record_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response record, or without a payload the revisit of another record."""
    kind = "response" if payload is not None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(record_id)), ("WARC-Date", _DATE)]
    if url is not None:  # control characters cannot stand in a header
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url) if re.search(r"[\x00-\x1f\x7f]", url) else url))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", _BATCH), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The columns of RECORD from one whole record. Size and digest are those of the payload itself
    and have to equal what its headers say; a revisit has only the headers."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, body = block.split(b"\r\n\r\n", 1)
    number = lambda k: None if fields[k].endswith(":none>") else int(fields[k].rpartition(":")[2][:-1])
    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not that of its headers")
    return {
        "record_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if "WARC-Refers-To" in fields else None,
        "payload_bytes": len(body) if fields["WARC-Type"] == "response" else size,
        "payload_digest": hashlib.sha1(body).hexdigest() if fields["WARC-Type"] == "response" else digest,
        "payload": body if fields["WARC-Type"] == "response" else None,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One file for each task attempt; only the index of the attempt that counts names its file."""
    fs, top = _open(folder)
    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
    out, at = None, 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(f"{top}/{name}", compression=None)
            revisit = r["refers_to"] is not None
            plain = record(r["record_id"], r["url"], None if revisit else r["payload"], r["size"], r["digest"], r["refers_to"])
            packed = zlib.compress(plain, level=1, wbits=31)  # a gzip member for each record
            out.write(packed)
            rows.append((name, at, len(packed), r["url"], r["digest"], r["record_id"], "revisit" if revisit else "response"))
            at += len(packed)
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record for each row of pages into gzip WARC files below `folder`; return the index.

    Of payloads (UTF-8 of the HTML, null: empty) of at least `least` bytes that are equal (SHA-1
    and length), the row with the largest id holds the payload, the others refer to it; rows
    that repeat that id hold it too. Rows with a null id hold their payload. Copies are found by
    partial aggregation and a join, so any number of them is spread over tasks. The index is a
    table beside the files: file, offset, length, url, digest, record_id, record_type.
    """
    base = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    copies = base.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("record_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = base.join(copies, ["digest", "size"], "left").withColumn("refers_to", F.when(F.col("head") != F.col("record_id"), F.col("head")))
    rows = joined.select("record_id", "url", "payload", "size", "digest", "refers_to")
    rows.mapInArrow(lambda it: _write(it, f"{folder}/warc"), INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def _ranges(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) in groups that one read each covers."""
    group: list[tuple[int, int]] = []
    for offset, length in places:
        if group and (offset > sum(group[-1]) + GAP or offset + length > group[0][0] + SPAN):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, top = _open(folder)
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])
    for batch in batches:
        places: dict[str, list[tuple[int, int]]] = {}
        for name, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), strict=True):
            places.setdefault(name, []).append((offset, length))
        for name, some in places.items():
            with fs.open_input_file(f"{top}/{name}") as file:
                for group in _ranges(sorted(some)):
                    first, last = group[0][0], sum(group[-1])
                    raw = io.BytesIO(file.read_at(last - first, first)).getbuffer()
                    rows = [parse(zlib.decompress(raw[o - first : o - first + n], wbits=31)) for o, n in group]
                    yield pa.RecordBatch.from_pylist(rows if payloads else [r | {"payload": None} for r in rows], schema)


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index (all or some) name, without reading the rest.

    Rows of the same stretch of a file meet in one partition, sorted by offset, and neighbours are
    joined into one read; there are as many partitions as stretches, or as Spark has for shuffles
    if those are more. Returns record_id, url, record_type, refers_to, payload_bytes and
    payload_digest (of the full payload, hexadecimal; computed from the bytes read, for a revisit
    those that its record gives), payload (null for a revisit, and for all without `payloads`).
    """
    places = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / SPAN))
    n = max(exchange.partitions(index), places.select("file", "stretch").distinct().count())
    return places.repartition(n, "file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(lambda it: _read(it, f"{folder}/warc", payloads), RECORD)


def archive_round_trip(pages: DataFrame, least: int = 1000, payloads: bool = True) -> DataFrame:
    """Write all pages into archives in the shared folder and read every record back."""
    folder = exchange.shared_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder, least), folder, payloads)
