"""Archives bounded by bytes, read as streams, and sketches recomputed from their texts."""

import glob
import gzip

import pyarrow as pa
import pytest

from vantagrid.llm import warc
from vantagrid.llm.common import scratch

PAGES = "page_id long, url string, html string"


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    """Many small pages, some larger than a row, one larger than a file, in one task: files stay within their bound but for that one."""
    monkeypatch.setattr(warc, "ROW_BYTES", 20_000)
    monkeypatch.setattr(warc, "ROWS_PER_FILE", 3)
    rows = [(i, f"http://a/{i}", f"page {i} " * 50) for i in range(300)] + [(1000 + i, "u", f"é{i} " * 9000) for i in range(5)] + [(2000, "u", "long " * 40_000), (2001, None, ""), (2002, "v", None)]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    sizes = []
    for name in glob.glob(f"{path}/*.gz"):
        with gzip.open(name) as f:
            sizes.append(len(f.read()))
    # A row is below 20,000 bytes or a single capture, of which all but one are below 46,000.
    assert len(sizes) > 5 and sorted(sizes)[-2] < 3 * 46_000 and max(sizes) < 200_000 + 2 * 46_000 + 2000
    found = {r["page_id"]: r for r in warc.captures(spark, path).collect()}
    assert {i: found[i]["payload_bytes"] for i, _, _ in rows} == {i: len((h or "").encode()) for i, _, h in rows} and len(found) == len(rows)
    assert all(found[i]["payload_digest"] == warc.payload_digest((h or "").encode()) for i, _, h in rows)
    whole = {r["record_id"]: r["payload"] for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    assert sorted(map(bytes, whole.values())) == sorted({(h or "").encode() for _, _, h in rows})


def _record(block: bytes) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: resource\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)


def test_records_are_cut_by_their_length():
    blocks = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\nx", b"a" * 100_000]
    plain = b"".join(map(_record, blocks))
    members = b"".join(gzip.compress(_record(b)) for b in blocks)
    for archive in (plain, gzip.compress(plain), members):
        assert [b for _, b in warc._archive_records(pa.py_buffer(archive))] == blocks
    assert list(warc._archive_records(pa.py_buffer(b""))) == []
    for archive in (plain[:-10], gzip.compress(plain[:-10])):
        with pytest.raises(EOFError):
            list(warc._archive_records(pa.py_buffer(archive)))
