"""WARC archives with an index written first, and coalesced byte-range reads of the records selected from it.

Tasks write gzip-member-per-record archives into a shared folder and return, for every record, its file, offset, length,
URL and payload digest.  That index is a table: selecting records is a DataFrame filter.  Reads sort the selection by file
and offset, join neighbouring ranges into one read, and cut the records out of it.

An archive is named after its partition and a random suffix, and the index holds only what finished tasks return; a
task that is run again leaves an unreferenced file at worst.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlake import storage

from .common import Scratch, table

REVISIT_BYTES = 100  #: equal payloads of at least so many bytes are stored once
FILE_BYTES = 64_000_000  #: an archive is closed beyond this size
GAP_BYTES, READ_BYTES = 64_000, 8_000_000  #: ranges closer than the gap are read together, up to this size
DATE = "2000-01-01T00:00:00Z"  #: of all records, so that reruns write equal bytes

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_decisions(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every page.

    Of pages with equal payloads of at least REVISIT_BYTES, that of the smallest page_id is the response.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    named = pages.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest")
    firsts = named.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = named.join(firsts, "payload_digest").where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    out = pages.join(revisits, ["page_id", "payload_digest"], "left")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of the payload it stands for, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:x-page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder as Spark names it, and the path in it; a path without a scheme is refused, as it could
    mean another place here than where Spark reads it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} names no file system; give it as storage.qualified does")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def _write(folder: str) -> Callable:
    def run(batches):
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        stream, name, at, rows = None, "", 0, []

        def finished():
            stream.close()
            return pa.RecordBatch.from_pylist(rows, schema)

        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in INDEX.split(", ")])
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, payload, size, digest, kind, refers_to = (batch.column(c)[i].as_py() for c in range(7))
                if stream is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    stream, at, rows = files.open_output_stream(f"{root}/{name}", compression=None), 0, []
                member = _member(record(page_id, url, payload, size, digest, kind, refers_to))
                stream.write(member)
                rows.append({"page_id": page_id, "url": url, "file": name, "offset": at, "length": len(member), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers_to})
                at += len(member)
                if at >= FILE_BYTES:
                    yield finished()
                    stream = None
        if stream is not None:
            yield finished()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' archives into ``folder`` when evaluated; the result is their index (see INDEX)."""
    folder = storage.qualified(pages.sparkSession, folder)
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return with_decisions(pages).select(*columns).mapInArrow(_write(folder), INDEX)


def parse(data: bytes) -> dict:
    """One record's member: its page, kind and payload; the digest of a response is computed from its payload."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda urn: None if urn.endswith(":None>") else int(urn[len("<urn:x-page:") : -1])
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"] or response and len(payload) != size:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if response else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if response else number(fields["WARC-Refers-To"]),
    }


def coalesced(spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as fewer reads: file, start, end, and the records inside it."""
    file, start, end, inside = "", 0, 0, []
    for name, offset, length in spans:
        if inside and (name != file or offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield file, start, end, inside
            inside = []
        if not inside:
            file, start = name, offset
        inside.append((offset, length))
        end = offset + length
    if inside:
        yield file, start, end, inside


def _read(folder: str, with_payload: bool) -> Callable:
    def run(batches):
        files, root = open_folder(folder)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ") if with_payload or not c.startswith("payload ")])
        opened, stream = "", None
        for batch in batches:
            spans = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for file, start, end, inside in coalesced(spans):
                if file != opened:
                    if stream is not None:
                        stream.close()
                    opened, stream = file, files.open_input_file(f"{root}/{file}")
                data = stream.read_at(end - start, start)
                found = [parse(data[offset - start : offset - start + length]) for offset, length in inside]
                if not with_payload:
                    for x in found:
                        del x["payload"]
                yield pa.RecordBatch.from_pylist(found, schema)
        if stream is not None:
            stream.close()

    return run


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the index rows given (any selection of an index), read by coalesced ranges.

    Revisits come without payload but with the size and digest of the payload they stand for.
    """
    folder = storage.qualified(index.sparkSession, folder)
    spans = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    schema = RECORD if with_payload else ", ".join(c for c in RECORD.split(", ") if not c.startswith("payload "))
    return spans.mapInArrow(_read(folder, with_payload), schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, as read back from its archives.

    Null html is the empty payload; payloads under REVISIT_BYTES and rows of a null page_id are always responses, and
    repeats of a response's row are responses as well.  An empty table writes nothing and gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    index = scratch.save(write_archives(pages, folder), "index")
    return read_records(index, folder, with_payload=False).drop("url")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest,
       CASE WHEN strlen(t) >= {REVISIT_BYTES} AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(t) >= {REVISIT_BYTES} AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS t FROM pages) WINDOW w AS (PARTITION BY t)
"""
