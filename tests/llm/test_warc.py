import base64
import gzip
import hashlib

import pytest

from ledgerwell.llm import warc

SCHEMA = "page_id bigint, url string, html string"
PAGES = [(1, "http://a/\r\nWARC-Type: revisit", "<p>é"), (2, None, "<p>é"), (5, "u", "<p>é"), (3, "u", None), (4, "u", ""), (6, "u", "x" * 200000), (None, "u", "<p>é"), (7, "u", "once"), (7, "u", "once")]


def test_round_trip(spark, save):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_warc_archive(spark, save(PAGES, "pages", SCHEMA)).collect())
    want = []
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        top = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        later = page_id is not None and page_id < top
        want.append((str(page_id), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", top if later else None))
    assert got == sorted(want)


def test_payloads_once_and_exact_records(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    warc.write_archive(pages, f"file://{tmp_path}/arc")
    assert spark.read.parquet(f"{tmp_path}/arc/payloads").count() == len({h or "" for _, _, h in PAGES})
    records = warc.read_archive(spark, f"file://{tmp_path}/arc").collect()
    raw = b"".join(bytes(r.record) for r in records)
    parsed = list(warc.parse_records(raw))
    assert len(parsed) == len(PAGES) and sorted(h for h, _ in parsed) == sorted(bytes(r.header) for r in records)
    for header, content in parsed:
        f = warc.fields(header)
        if f["warc-type"] == "response":
            assert f["warc-payload-digest"] == "sha1:" + warc.base32_sha1(content)
        else:
            assert content == b"" and f["warc-refers-to"] == "<urn:page:5>" or f["warc-refers-to"] in ("<urn:page:4>",)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw))
    assert warc.read_files(spark, f"{tmp_path}/a.warc.gz").count() == len(PAGES)


def test_a_changed_payload_fails(spark, tmp_path):
    import zlib

    warc.write_archive(spark.createDataFrame(PAGES[:1], SCHEMA), f"file://{tmp_path}/arc")
    bad = spark.read.parquet(f"{tmp_path}/arc/payloads").collect()[0]
    spark.createDataFrame([(bad.sha256, bytearray(zlib.compress(b"other")))], "sha256 binary, z binary").write.mode("overwrite").parquet(f"{tmp_path}/arc/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"file://{tmp_path}/arc").collect()


def test_empty_table(spark, save):
    assert warc.op2_warc_archive(spark, save([], "pages", SCHEMA)).count() == 0


def test_payloads_of_many_records(spark, tmp_path, monkeypatch):
    """Records of one payload are dealt over parts; a payload that is gone fails the read."""
    monkeypatch.setattr(warc, "PART", 7)
    pages = [(k, f"u{k}", "same" if k % 3 else f"<p>{k}") for k in range(200)] + [(None, None, None), (None, "x", "same")]
    path = f"file://{tmp_path}/arc"
    warc.write_archive(spark.createDataFrame(pages, SCHEMA), path)
    stored = {bytes(r.sha256): r.parts for r in spark.read.parquet(f"{path}/payloads").collect()}
    assert len(stored) == 67 + 2 and max(stored.values()) == 20
    records = warc.read_archive(spark, path).collect()
    assert len(records) == len(pages) and sum(bytes(r.payload) == b"same" for r in records) == 134
    assert sum(b"WARC-Type: response" in bytes(r.header) and bytes(r.payload) == b"same" for r in records) == 2
    spark.read.parquet(f"{path}/payloads").limit(0).write.mode("overwrite").parquet(f"{path}/none")
    with pytest.raises(Exception, match="missing"):
        spark.read.parquet(f"{path}/headers").write.parquet(f"file://{tmp_path}/other/headers")
        spark.read.parquet(f"{path}/none").write.parquet(f"file://{tmp_path}/other/payloads")
        warc.read_archive(spark, f"file://{tmp_path}/other").collect()
