"""Content-addressed WARC archive: payloads once by SHA-256, record headers apart, records rebuilt by a join.

An archive is two Parquet tables: payloads (sha256, parts, z: deflated bytes), one row for each distinct payload, and headers
(sha256, part, header: the exact header block of a record). A record is its header block, its payload where it is a response,
and two line ends. A payload of many records is handed to as many tasks as it has parts, of PART records each, when read. The join of both tables gives every record back; each payload is hashed again when read, and a mismatch with
the digest it is stored under, or with the header's, or a missing payload fails the read.

Null html is an empty payload; a null url gives no target line; line breaks in a url are percent-escaped; a page with a null
id is a response under a name of its own and is referred to by none; pages that repeat the largest id are responses alike;
repeated rows are records of their own; payloads of any length travel whole, one row each; an empty table gives empty
archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.common import new_path, spread_join, table

DATE = "2020-01-01T00:00:00Z"
#: Records that a task joins with one payload, on average.
PART = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PACKED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("n", pa.int64()), ("sha256", pa.binary()), ("sha1", pa.string()), ("z", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pack(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html in batch.column(2):
                raw = (html.as_py() or "").encode("utf-8")
                out.append((len(raw), hashlib.sha256(raw).digest(), base32_sha1(raw), zlib.compress(raw, 3) if with_payload else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array(c, f.type) for c, f in zip(cols, list(_PACKED)[2:], strict=True))], schema=_PACKED)

    return run


def _packed(pages: DataFrame, with_payload: bool) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_pack(with_payload), "page_id bigint, url string, n bigint, sha256 binary, sha1 string, z binary")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def header_block(page_id: Column, url: Column, n: Column, sha1: Column, top: Column, date: str = DATE) -> Column:
    """The header of a page's record, a revisit where a larger id has the same payload."""
    end = F.lit("\r\n")
    revisit = page_id < top
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), safe, end)).otherwise("")
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(top), end, F.lit(f"WARC-Profile: {PROFILE}"), end)).otherwise("")
    text = F.concat(
        F.lit("WARC/1.1"), end,
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), end,
        F.lit("WARC-Record-ID: "), F.coalesce(_urn(page_id), F.lit("<urn:page:none>")), end,
        F.lit(f"WARC-Date: {date}"), end,
        target, refers,
        F.lit("WARC-Payload-Digest: sha1:"), sha1, end,
        F.lit("Content-Type: text/html; charset=utf-8"), end,
        F.lit("Content-Length: "), F.when(revisit, "0").otherwise(n.cast("string")), end, end,
    )
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes the two tables under path. Payloads meet by digest after each task has kept one of each."""
    keyed = _packed(pages, True)
    parts = F.ceil(F.count("*") / PART).cast("int").alias("parts")
    keyed.groupBy("sha256").agg(parts, F.min("z").alias("z")).write.option("compression", "none").parquet(f"{path}/payloads")
    slim = _packed(pages, False).drop("z")
    lone = F.when(F.count("*") == 1, F.max("page_id")).alias("lone")
    tops = slim.groupBy("sha256").agg(F.max("page_id").alias("top"), parts, lone)
    rows = spread_join(slim, tops, "sha256", "page_id", lone="lone")
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int").alias("part")
    rows.select("sha256", part, header_block(F.col("page_id"), F.col("url"), F.col("n"), F.col("sha1"), F.coalesce("top", "page_id")).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def fields(header: bytes) -> dict[str, str]:
    """The named fields of a header block."""
    lines = header.decode("utf-8").split("\r\n")
    return {"version": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, records = [], []
        for header, digest, z in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            f = fields(header)
            if z is None:
                raise ValueError(f"the payload of {f['warc-record-id']} is missing")
            payload = zlib.decompress(z)
            if hashlib.sha256(payload).digest() != digest or f["warc-payload-digest"] != "sha1:" + base32_sha1(payload):
                raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
            payloads.append(payload)
            records.append(header + (payload if f["warc-type"] == "response" else b"") + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary()), pa.array(records, pa.binary())], ["header", "payload", "record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload and record (the exact bytes) of every record of an archive."""
    headers = spark.read.schema("sha256 binary, part int, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 binary, parts int, z binary").parquet(f"{path}/payloads")
    dealt = payloads.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return headers.join(dealt, ["sha256", "part"], "left").select("header", "sha256", "z").mapInArrow(_rebuild, "header binary, payload binary, record binary")


def parse_records(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and content of each record of a plain or gzip-compressed WARC file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at) + 4
        header = raw[at:stop]
        n = int(fields(header)["content-length"])
        yield header, raw[stop : stop + n]
        at = stop + n + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, header and content of the records of .warc and .warc.gz files; one file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(parse_records(raw))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["path", "header", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, header binary, content binary")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path)
    header = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(header, rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: field(name, "<urn:page:(-?[0-9]+)>")
    return records.select(
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("bigint").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.nullif(number("WARC-Refers-To"), F.lit("")).cast("bigint").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM h
"""
