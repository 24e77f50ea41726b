"""WARC archives by way of a chunked record table.

Payloads are cut into chunk rows (record, chunk number, bytes) by DataFrame functions, so that the Python side never holds
a whole record: the writer streams chunk rows into gzip members, the reader streams members back into chunk rows that
carry the running SHA-1 and size. Archives go to the folder that driver and executors share; a task's archive counts only
if its name is in the manifest, which is written by Spark's own commit, so a lost executor leaves no half archive behind.
Equal payloads (by SHA-1 and size) are stored once: the record with the largest id is the response, others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.common import join_checked, new_path, open_path, stored

CHUNK = 256 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def records(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, most_broadcast: int = 200_000) -> DataFrame:
    """Pages as records: page_id, url, payload, size, sha1 (hex), refers_to (null: a response).

    Null html is an empty payload. Rows that repeat the largest page_id of their payload are all responses; a null
    page_id revisits the largest one there is. Other columns are not carried.
    """
    payload: Column = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"))
    base = base.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    same = base.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    same, _ = stored(spark, same.where("n > 1 AND kept IS NOT NULL").drop("n"), "payloads")
    out = join_checked(spark, base, same, ["sha1", "size"], "left", most_broadcast)
    return out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))).drop("kept")


def chunks(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows to write: a response has its payload's chunks in order, one at least; a revisit has one empty chunk."""
    last = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)) - 1).otherwise(0)
    rows = recs.withColumn("last", last.cast("int")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last"))))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "refers_to", "size", "sha1", "chunk_no", "last", data.alias("data"))


def head(page_id: int | None, url: str | None, refers_to: int | None, size: int, sha1: str) -> bytes:
    """A record's WARC header and the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32(sha1)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """Write chunk rows as one gzip archive per task; the manifest (archive, records, bytes) and the archives' folder."""
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = member = None
        n = 0
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for page_id, url, refers_to, size, sha1, no, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, root = open_path(folder)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                if no == 0:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(head(page_id, url, refers_to, size, sha1)))
                out.write(member.compress(data))
                if no == last:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    return stored(spark, rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")[0], folder


class Stream:
    """Bytes of a file of gzip members, decompressed as they are asked for."""

    def __init__(self, raw, block: int = 64 << 10):
        self.raw, self.block, self.buffer, self.member = raw, block, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        if self.member.eof:
            rest = self.member.unused_data
            self.member = zlib.decompressobj(31)
        else:
            rest = self.member.unconsumed_tail
        rest = rest or self.raw.read(self.block)
        if not rest:
            return False
        self.buffer += self.member.decompress(rest, 4 * self.block)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to the mark, which is taken too; None at the end."""
        at = 0
        while (end := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse(raw, chunk: int = CHUNK) -> Iterator[tuple]:
    """(page_id, type, refers_to, chunk_no, data, bytes so far, digest so far, last) for each chunk of each record."""
    stream = Stream(raw)
    page = re.compile(r"<urn:page:(-?\d*)>")
    while (top := stream.until(b"\r\n\r\n")) is not None:
        warc = fields(top.lstrip(b"\r\n"))
        number = lambda key: int(x) if (x := page.fullmatch(warc.get(key, "<urn:page:>"))[1]) else None
        http = stream.until(b"\r\n\r\n")
        left, no, total, digest = int(warc["content-length"]) - len(http) - 4, 0, 0, hashlib.sha1()
        told = warc["warc-payload-digest"].removeprefix("sha1:")
        who = (number("warc-record-id"), warc["warc-type"], number("warc-refers-to"))
        if who[1] == "revisit":
            yield *who, 0, b"", int(fields(http)["content-length"]), told, True
        else:
            while True:
                data = stream.take(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError(f"the archive ends within record {who[0]}")
                left -= len(data)
                total += len(data)
                digest.update(data)
                now = base64.b32encode(digest.digest()).decode()
                yield *who, no, data, total, now, left == 0
                if not left:
                    break
                no += 1
            if now != told:
                raise ValueError(f"record {who[0]}: payload digest {now}, header {told}")
        stream.take(4)


def read(manifest: DataFrame, folder: str, data: bool = True, only_last: bool = False) -> DataFrame:
    """The chunk rows of the manifest's archives: page_id, record_type, refers_to, chunk_no, payload_bytes and
    payload_digest so far, last, and the bytes if asked. only_last leaves one row a record, with the totals."""
    names = ["page_id", "record_type", "refers_to", "chunk_no", "data", "payload_bytes", "payload_digest", "last"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_path(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    rows, size = [], 0
                    for row in parse(raw):
                        if only_last and not row[7]:
                            continue
                        rows.append(row if data else (*row[:4], b"", *row[5:]))
                        size += len(rows[-1][4])
                        if len(rows) >= 5000 or size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(n).mapInArrow(run, "page_id long, record_type string, refers_to long, chunk_no int, data binary, payload_bytes long, payload_digest string, last boolean")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The columns of op9: what the archives of all pages say when read back."""
    manifest, folder = write(spark, chunks(records(spark, pages)))
    return read(manifest, folder, data=False, only_last=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS kept FROM p),
q AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT)) AS five FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(five, lambda v: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1))), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM q
"""
