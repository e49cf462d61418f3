"""WARC records in ZIP packages: written by tasks, read back by range without extraction.

A package holds one stored member of WARC records, each compressed for itself, and one stored
member that indexes them.  A record whose payload equals that of a record elsewhere is a revisit
and carries no payload.  Packages are files in the shared folder; a task that runs again writes
other files, and only those that a finished task has named are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zip_archive
from .common import HOT_ROWS, id_map, marked, salted_join, shared_folder, table, written

RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.jsonl"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Payload bytes after which a package is closed, and bytes that one range read covers at least.
PACKAGE_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: Shared payloads up to so many (some 100 bytes each) are broadcast; for more, only pages that may share one move.
BROADCAST_PAYLOADS = 100_000


def _header(value: str) -> str:
    """A header value: control signs, blanks and all beyond ASCII as percent escapes of UTF-8."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in value.encode())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, size: int, sha1: str) -> bytes:
    """One WARC record; ``size`` and ``sha1`` (hex) are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v != "<urn:x-page:>" else None
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    kind, size = fields["warc-type"], len(payload)
    if kind == "response":
        own = hashlib.sha1(payload).hexdigest()
        if own != digest:
            raise ValueError("a payload does not have the digest of its record")
    else:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page(fields.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload (null html: empty), size, sha1 and refers_to (null for responses) to pages.

    Of equal payloads of at least ``least_bytes`` the record with the largest page_id is the
    response and the others refer to it.  A payload that very many pages share is spread over tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    given = pages.select("page_id", "url", payload.alias("payload"))
    given = given.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    given = given.withColumn("same", F.concat_ws(":", "sha1", "size"))
    groups = given.where(F.col("size") >= least_bytes).groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original"))
    groups = written(groups.where("n > 1 and original is not null"), "payloads")
    side = groups.drop("n")
    if groups.count() <= BROADCAST_PAYLOADS:
        joined = given.join(F.broadcast(side), "same", "left")
    else:
        ids = F.col("same").alias("id")
        given = marked(given, id_map(groups.select(ids)), "same", "shared")
        hot = id_map(groups.where(F.col("n") >= HOT_ROWS).select(ids))
        joined = salted_join(given.where("shared"), side, "same", F.monotonically_increasing_id(), hot, "left")
        apart = given.where("not shared").withColumn("original", F.lit(None).cast(side.schema["original"].dataType))
        joined = joined.unionByName(apart)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("original")), F.col("original"))
    return joined.select("page_id", "url", "payload", "size", "sha1", refers.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, zip64: bool = True) -> DataFrame:
    """Writes (page_id, url, payload, size, sha1, refers_to) to packages in ``folder``: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        body, index, held = bytearray(), [], 0

        def close() -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                out.write(zip_archive.write_stored([(RECORDS, bytes(body)), (INDEX, "".join(index).encode())], zip64))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["size"], row["sha1"])) + packer.flush()
                index.append(json.dumps({"offset": len(body), "length": len(data), "page": row["page_id"]}) + "\n")
                body += data
                held += len(row["payload"])
                if held >= PACKAGE_BYTES:
                    yield close()
                    body, index, held = bytearray(), [], 0
        if index:
            yield close()

    return pages.mapInArrow(run, "path string, records long")


def read_packages(packages: DataFrame, payload: bool = True) -> DataFrame:
    """The records of packages (path): what ``parse`` gives, by range reads through the index."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payload
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def records(path: str) -> Iterator[dict]:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_file(place) as file:
            read = lambda at, n: file.read_at(n, at)
            members = zip_archive.directory(read, file.size())
            begin = zip_archive.data_offset(read, members[RECORDS])
            entries = [json.loads(x) for x in read(zip_archive.data_offset(read, members[INDEX]), members[INDEX].size).splitlines()]
            k = 0
            while k < len(entries):  # neighbours are read together
                first, stop = entries[k]["offset"], k
                while stop < len(entries) and (stop == k or entries[stop]["offset"] + entries[stop]["length"] - first <= READ_BYTES):
                    stop += 1
                data = read(begin + first, entries[stop - 1]["offset"] + entries[stop - 1]["length"] - first)
                for e in entries[k:stop]:
                    yield parse(zlib.decompress(data[e["offset"] - first : e["offset"] - first + e["length"]], 31))
                k = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in records(path):
                    rows.append(row)
                    held += len(row["payload"] or b"") if payload else 1
                    if held >= (READ_BYTES if payload else 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payload
    return packages.select("path").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Writes pages (page_id, url, html) to packages and reads them back, one row per page.

    Null html is an empty payload; a null url has no header and comes back null; other columns do
    not matter.  Rows of one page_id are records each; a null page_id comes back null and never is
    what others refer to.  Payloads of any length are kept whole.  No pages give no package.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    packages = written(write_packages(with_revisits(pages), folder), "packages")
    tasks = max(1, min(packages.count(), 4 * spark.sparkContext.defaultParallelism))
    return read_packages(packages.repartition(tasks), payload)


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive(table(spark, sf_dir, "pages"), payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
