"""WARC archives: one gzip member per record, written and read by tasks in the shared folder.

The writer turns a page into a ``response`` record, or into a ``revisit``
record where an equal payload of at least ``min_revisit_bytes`` bytes belongs
to a smaller page_id.  The reader goes through an archive from start to end:
it inflates piece by piece, frames records by Content-Length and verifies the
block and payload digests.

Defined cases: null html is the empty payload; a null page_id is kept as null
and sorts after all others (it refers to the smallest page_id of its payload);
rows with equal page_id and payload are all responses if theirs is the smallest
page_id; other columns are not looked at; an empty table gives no archive and
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .registry import query

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(uri: str):
    """Filesystem and path of a URI of any store pyarrow knows."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None):
    value = None if urn is None else urn[len("<urn:page:"):-1]
    return None if value in (None, "null") else int(value)


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP header, which states the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
            f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + END + block + END) + pack.flush()


def _fields(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return dict(x.split(": ", 1) for x in lines)


def members(stream, chunk: int = CHUNK):
    """Inflated pieces of each gzip member of a stream, as one iterator per member; a cut-off member raises."""
    waiting = b""

    def pieces(unpack):
        nonlocal waiting
        while not unpack.eof:
            data = waiting or stream.read(chunk)
            waiting = b""
            if not data:
                raise ValueError("archive ends inside a member")
            yield unpack.decompress(data)
        waiting = unpack.unused_data

    while True:
        waiting = waiting or stream.read(chunk)
        if not waiting:
            return
        yield pieces(zlib.decompressobj(31))


def records(stream):
    """``(fields, payload, payload length)`` of each record in order; a wrong length or digest raises."""
    for member in members(stream):
        buf = bytearray()
        for piece in member:
            buf += piece
            if (at := buf.find(END)) >= 0:
                break
        else:
            raise ValueError("record without header")
        fields = _fields(bytes(buf[:at]))
        del buf[:at + 4]
        for piece in member:
            buf += piece
        size = int(fields["Content-Length"])
        if len(buf) != size + 4 or bytes(buf[size:]) != END:
            raise ValueError(f"{fields['WARC-Record-ID']}: block of {len(buf) - 4} bytes, {size} stated")
        block = bytes(buf[:size])
        if "sha1:" + digest32(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']}: block digest")
        http, _, payload = block.partition(END)
        stated = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        if fields["WARC-Type"] == "response" and (len(payload) != stated or "sha1:" + digest32(payload) != fields["WARC-Payload-Digest"]):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload digest")
        yield fields, payload, stated


def with_originals(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages with ``original``, the smallest page_id of an equal payload; null where the page is that one or its payload is short.

    The smallest id per digest is a pre-aggregated minimum.
    """
    own = pages.select("page_id", "url", F.expr("coalesce(html, '')").alias("html")).withColumn("digest_", F.sha1("html"))
    firsts = (own.where(f"octet_length(html) >= {min_revisit_bytes}").groupBy("digest_")
              .agg(F.min("page_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1 AND first_ IS NOT NULL").drop("n_"))
    return (own.join(firsts, "digest_", "left")
            .selectExpr("page_id", "url", "html", "IF(first_ <=> page_id, NULL, first_) AS original"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html, original)`` as archives under ``folder``; returns the lazy manifest ``(path, n_records)``.

    A task names its files uniquely and lists them when they are closed, so files
    of lost or repeated attempts are never read.
    """
    def write(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, original in zip(batch.page_id, batch.url, batch.html, batch.original):
                if out is None:
                    path = f"{base}/pages-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                revisit = not pd.isna(original)
                data = record(None if pd.isna(page_id) else int(page_id), url, html.encode(), int(original) if revisit else None, revisit)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_records": [n]})

    # object columns keep large ids exact beside nulls
    plain = pages.selectExpr("CAST(page_id AS STRING) AS page_id", "url", "html", "CAST(original AS STRING) AS original")
    return plain.mapInPandas(write, "path string, n_records long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, html (null in revisits)."""
    def read(batches):
        for batch in batches:
            for path in batch.path:
                fs, place = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for fields, payload, stated in records(stream):
                        revisit = fields["WARC-Type"] == "revisit"
                        rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
                                     stated, fields["WARC-Payload-Digest"].removeprefix("sha1:"), None if revisit else payload.decode()))
                        held += len(payload)
                        if held >= 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, then read every archive of the manifest back, one archive per task."""
    scratch = Scratch(pages.sparkSession)
    manifest = scratch.keep(write_archives(with_originals(pages, min_revisit_bytes), scratch.path("warc")))
    return read_archives(manifest.repartition(max(1, manifest.count())))


_HEX = "(instr('0123456789abcdef', h[{}]) - 1)"
_B32 = " || ".join(
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(((" + _HEX.format(5 * i // 4 + 1) + " * 16 + "
    + (_HEX.format(5 * i // 4 + 2) if 5 * i // 4 + 2 <= 40 else "0") + f") >> {3 - 5 * i % 4}) & 31 AS INT) + 1]" for i in range(32))

SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q"""


@query("op5_warc", SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the archives and back."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
