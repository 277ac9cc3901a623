"""WARC archives: writing records to whole-file gzip streams, and normalising such files to one gzip member a record.

An archive is a row with its bytes, so tables of archives live wherever Spark writes. The normaliser inflates a
monolithic stream once, cuts it at its records, writes each as a member of its own and lists every member's offset,
length and key headers in a sidecar index; any record can then be read by its byte range alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import beside, listed, materialise, small_batches, text_batches

#: Bytes of records after which a new archive begins; a longer record makes a longer one.
ARCHIVE_BYTES = 4_000_000
#: Payloads under this many bytes are stored each time.
LEAST_REVISIT = 100
LEVEL = 4
_GZIP, _BLOCK = 31, 16384
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """(headers with lower-case names, record start, block start, record stop) of each record of an inflated archive.

    Raises ValueError at anything that isn't a record, with its place. Line ends between records may be more or fewer than two.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        if data[at : at + 5] != b"WARC/" or (stop := data.find(b"\r\n\r\n", at)) < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, str] = {}
        name = ""
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in " \t" and name:  # a folded line
                headers[name] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"no Content-Length at byte {at}") from None
        block = stop + 4
        if block + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        end = block + size
        yield headers, at, block, end + 4 if data[end : end + 4] == b"\r\n\r\n" else end
        at = end


def deflate(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without a time, so that equal data give equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
    return c.compress(data) + c.flush()


def inflate(data: bytes) -> bytes:
    """All members of a gzip file, one after another. Raises ValueError if the last is cut off."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        d = zlib.decompressobj(_GZIP)
        try:
            while at < len(view) and not d.eof:  # in blocks, so that what follows a member isn't copied whole
                block = view[at : at + _BLOCK]
                out.append(d.decompress(block))
                at += len(block)
        except zlib.error as e:
            raise ValueError(f"not gzip: {e}") from None
        if not d.eof:
            raise ValueError("gzip stream is cut off")
        at -= len(d.unused_data)
        while at < len(view) and not view[at]:
            at += 1
    return b"".join(out)


def normalise(data: bytes) -> tuple[bytes, list[dict]]:
    """(file of one member a record, index). Index entries: offset, length, record_id, warc_type, target_uri and payload_digest."""
    plain, out, index, at = inflate(data), [], [], 0
    for headers, start, _, stop in records(plain):
        member = deflate(plain[start:stop])
        index.append(
            {"offset": at, "length": len(member), "record_id": headers.get("warc-record-id"), "warc_type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "payload_digest": headers.get("warc-payload-digest")}
        )
        out.append(member)
        at += len(member)
    return b"".join(out), index


_INDEX = "array<struct<offset: bigint, length: bigint, record_id: string, warc_type: string, target_uri: string, payload_digest: string>>"
_INDEX_ARROW = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("record_id", "warc_type", "target_uri", "payload_digest")]]))


def _archives(batches):
    """Typed pages to archives, each one gzip stream."""
    c, held = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP), 0
    parts: list[bytes] = []
    for batch in text_batches(batches, "html"):
        for page, url, html, digest, first in zip(*[batch.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "first_page")], strict=True):
            payload = (html or "").encode()
            revisit = first is not None and page != first
            headers = {
                "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": "1970-01-01T00:00:00Z",
                "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Length": str(len(payload)), "Content-Type": "application/http;msgtype=response",
            }
            if url is not None:
                headers["WARC-Target-URI"] = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
            if revisit:
                headers |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
            made = record(headers, _HTTP + (b"" if revisit else payload))
            parts.append(c.compress(made))
            held += len(made)
            if held >= ARCHIVE_BYTES:
                parts.append(c.flush())
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["data"])
                c, held, parts = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP), 0, []
    if held:
        parts.append(c.flush())
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["data"])


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Archives (data: one gzip stream of many records) of pages (page_id, url, html).

    Of pages with equal payloads of at least ``least`` bytes the one of the smallest page_id is a response and the others
    are revisits of it without the payload; all others are responses. Null html is an empty payload. Rows that repeat the
    smallest page_id are responses too; a null page_id is never the smallest, and a response where no other id is there.
    Other columns are ignored. No pages give no archives.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    own = own.withColumn("digest", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))
    first = own.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
    return own.join(first.filter("n > 1").drop("n"), "digest", "left").select("page_id", "url", "html", "digest", "first_page").mapInArrow(_archives, "data binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rows with data (gzip of WARC records) to rows with data (one member a record), index, and error.

    A null, damaged or cut-off archive gives null data and says why in error; none is dropped. Other columns stay, but
    those named like one of the three in any case. An empty table gives no rows.
    """
    rest = beside(archives, "data", "index", "error")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column("data")[i]
                try:
                    data, index = normalise(bytes(value.as_buffer() or b"")) if value.is_valid else (None, None)
                    error = None if value.is_valid else "no data"
                except ValueError as e:
                    data, index, error = None, None, str(e)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(i, 1) for f in rest], pa.array([data], pa.binary()), pa.array([index], _INDEX_ARROW), pa.array([error], pa.string())], names=[*[f.name for f in rest], "data", "index", "error"])

    return archives.select(*[f.name for f in rest], "data").mapInArrow(run, f"{listed(rest)}data binary, index {_INDEX}, error string")


def _page_number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def read_pages(archives: DataFrame) -> DataFrame:
    """Pages of normalised archives, each record read by its offset and length: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, member_offset and member_length. Sizes and digests of responses are those of the payload read."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, index = batch.column("data")[i].as_buffer(), batch.column("index")[i].as_py() or ()
                rows = []
                for entry in index:
                    member = inflate(bytes(data[entry["offset"] : entry["offset"] + entry["length"]]))
                    headers, _, block, _ = next(records(member))
                    body = member[block : block + int(headers["content-length"])]
                    payload = body.partition(b"\r\n\r\n")[2]
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    rows.append((_page_number(entry["record_id"]), headers.get("warc-target-uri"), int(headers["warc-payload-length"]) if revisit else len(payload), digest, headers["warc-type"], _page_number(headers.get("warc-refers-to")) if revisit else None, entry["offset"], entry["length"]))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "member_offset", "member_length"])

    return archives.filter("data IS NOT NULL").select("data", "index").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, member_offset long, member_length long")


def op5_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    """Query: all pages written to monolithic archives, normalised to a member a record, and read back by the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = materialise(write_archives(pages), "archives", pages.rdd.getNumPartitions())
    read = read_pages(materialise(normalise_archives(archives), "members"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first_page FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first_page <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_page <> p.page_id THEN first_page END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
