import base64
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.common import fresh_path, open_file, write_file
from sparkloom.llm.warc import candidates, exits, op10_boundary_chain, read_archives, record, write_archives

SF = "/root/testdata/sf0.001"


def plain(rows, least=0):
    """(page_id, html) -> results, by loops."""
    first = {}
    for page_id, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        owner = first.get(html or "")
        revisit = len(data) >= least and owner is not None and page_id != owner
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r)[:5] for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_op10_equals_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert results(op10_boundary_chain(spark, SF)) == plain(rows)


def liar(k):
    """A payload that holds whole records of its own."""
    return "<p>\r\n\r\n" + b"".join(record(9000 + k, "http://x/", b"inner %d" % k, None, False)).decode() + "WARC/1.1\r\nContent-Length: 17\r\n\r\n" * 3


def test_magic_in_payloads_and_tiny_splits(spark):
    rows = [(k, f"http://h/{k}", liar(k) + "y" * (37 * k % 900)) for k in range(60)] + [(100, None, "z" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = fresh_path(spark, "t")
    archives = write_archives(pages, folder, archive_bytes=9000)
    assert archives.count() > 3
    for split in (512, 5000, 1 << 20):
        assert results(read_archives(archives, split)) == plain([(a, c) for a, _, c in rows])


def test_nulls_repeats_copies_and_least(spark):
    rows = [(5, None), (3, ""), (7, "same"), (2, "same"), (2, "same"), (None, "same"), (None, "alone"), (8, "long" * 50), (9, "long" * 50), (4, "é🙂\r\n\r\n")]
    pages = spark.createDataFrame([(a, "http://h/\r\nEvil: 1", b, "x", 1) for a, b in rows], "page_id long, url string, html string, digest string, copies int")
    for least in (0, 10):
        archives = write_archives(pages, fresh_path(spark, "t"), least)
        assert results(read_archives(archives, 100)) == plain(rows, least)
    got = read_archives(archives).select("url").distinct().collect()
    assert [r.url for r in got] == ["http://h/Evil: 1"]


def test_no_pages(spark):
    archives = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), fresh_path(spark, "t"))
    assert archives.collect() == [] and read_archives(archives).collect() == []


def test_damage_is_found(spark):
    pages = spark.createDataFrame([(k, None, f"page {k} " * 20) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = fresh_path(spark, "t")
    path, size = write_archives(pages, folder).first()
    with open_file(path) as f:
        data = f.read()
    write_file(path, [data.replace(b"page 3", b"page 4")])
    changed = spark.createDataFrame([(path, size)], "path string, size long")
    with pytest.raises(Exception, match="differs from its digest"):
        read_archives(changed).collect()


def test_chains_leave_their_split():
    data = b"".join(b"".join(record(k, None, b"x" * k, None, False)) for k in range(10))
    offset, after = candidates(data, 0, len(data))
    assert len(offset) == 10 and set(exits(offset, after, len(data)).tolist()) == {len(data)}
    assert defaultdict(int, zip(offset.tolist(), exits(offset, after, int(offset[5])).tolist()))[0] == offset[5]
    assert F is not None
