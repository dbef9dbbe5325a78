"""WARC archives of pages: revisits of equal payloads, written and read back (operator 13).

An archive is a file of gzip members, one record each, so that a record can be
read by its offset.  Tasks build the archives as images and Spark's text
writer puts them down, one image a file, on any file system that Spark
reaches; the NUL byte it adds behind an image is padding to gzip readers.

A response carries a whole payload behind its HTTP header.  A revisit carries
the HTTP header alone - its Content-Length is that of the whole payload - and
refers to the response with the same payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, write_through
from .capture_index import merge_runs
from .common import text_of

#: Bytes of an archive, and the smallest payload that a revisit can stand for.
ARCHIVE_BYTES = 8 << 20
MIN_REVISIT = 100
#: The time of capture of pages that have none.
CAPTURED = "2024-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def _plain(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit if ``refers_to`` names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(image: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive; NUL bytes between members are padding."""
    at, view = 0, memoryview(image)
    while at < len(image):
        if image[at] == 0:
            at += 1
            continue
        z = zlib.decompressobj(31)
        raw = z.decompress(view[at:])
        if not z.eof:
            raise ValueError(f"the archive ends inside a record (offset {at})")
        length = len(image) - at - len(z.unused_data)
        yield at, length, raw
        at += length


def _page(value: str) -> int | None:
    n = value.strip("<>").removeprefix(ID)
    return int(n) if n else None


def parse(raw: bytes) -> dict:
    """Fields of a record; the payload of a response is held against its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
    refers = h.get("WARC-Refers-To")
    return {"page_id": _page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "date": h["WARC-Date"], "payload_digest": digest,
            "record_type": h["WARC-Type"], "refers_to": _page(refers) if refers else None, "payload_bytes": size, "payload": payload}


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, scheme and www left out, then port, path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}".lower() + (f"?{parts.query.lower()}" if parts.query else "")


def with_links(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): the response that each repeated payload of ``least`` bytes refers to.

    Only digests and ids are grouped.  Payloads that occur once need no link,
    so the stored table that is joined holds the repeated ones alone; small, it
    is broadcast by its size, otherwise joined by shuffle.
    """
    html = text_of(pages["html"]).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"),
                        F.sha2(html, 256).alias("digest"))
    first = write_through(rows.filter(F.octet_length("html") >= least).groupBy("digest")
                          .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n"),
                          "warc-repeated")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT, size: int = ARCHIVE_BYTES, date: str = CAPTURED) -> None:
    """Write a record for every row of ``pages(page_id, url, html)`` to archives of about ``size`` bytes under ``path``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, digest, refers = (b.column(c)[i].as_py() for c in range(5))
                parts.append(member(record(page_id, url, html, digest, refers, date)))
                total += len(parts[-1])
                if total >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["image"])
                    parts, total = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["image"])

    images = with_links(pages, least).mapInArrow(task, "image binary")
    images.select(F.col("image").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


RUN = [("run", pa.string()), ("pos", pa.int64()), ("url_key", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
       ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
       ("offset", pa.int64()), ("length", pa.int64())]
RUN_SCHEMA = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in RUN)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive, a locally sorted run per file: by URL key, date and page id.

    Every record is decompressed and parsed, every response's payload checked.
    """
    def key(x: dict) -> tuple:
        return x["url_key"].encode("utf-8", "surrogatepass"), x["date"], x["page_id"] is None, x["page_id"] or 0, x["offset"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                run, rows = b.column(0)[i].as_py(), []
                for offset, length, raw in members(b.column(1)[i].as_py()):
                    x = parse(raw)
                    del x["payload"]
                    rows.append(x | {"run": run, "offset": offset, "length": length, "url_key": url_key(x["url"])})
                rows.sort(key=key)
                for pos, x in enumerate(rows):
                    x["pos"] = pos
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in RUN], [n for n, _ in RUN])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(task, RUN_SCHEMA)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives of ``pages``, read them back and merge their captures into one ordered index.

    Of records with equal payloads of MIN_REVISIT bytes or more the rows with
    the smallest page_id are responses, all others revisit it; smaller ones are
    all responses.  Null html is empty, a null url gives a record without one.
    A null page_id counts as larger than any other and comes back null; if all
    of a payload's are null, all are responses.  Rows that repeat page_id and
    payload are records of their own and of one type.  An empty table gives no
    archive and no row.  Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return merge_runs(write_through(capture_runs(spark, path), "warc-runs"))


SQL = f"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m"""
