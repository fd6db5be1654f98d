"""WARC archives with revisit records, and a parallel reader that trusts no magic by itself.

Writing. One archive per task and ARCHIVE_BYTES, uncompressed, beginning with a warcinfo record. Of the pages whose
payloads are equal (and have at least `least` bytes) the one with the smallest page_id becomes a response record, the
others revisit it by its record id; their block holds the HTTP head alone.

Reading. An archive is cut into splits that tasks scan by themselves. Every place where a record could begin (the
version line) is a candidate; its header names the length of its block and so the offset of its successor. Payloads may
hold such places too, so a task only follows its candidates' successors to where the chain leaves its split, and emits
candidate -> exit. Pointer jumping over these pairs, doubling the jump each round, finds what is reachable from offset
0 of each archive: one entry point per split and none inside a payload. Last, tasks walk their splits from the true
entry points, parse records and check each payload digest against the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, open_file, sized_broadcast, staged, table, write_file

VERSION = b"WARC/1.1\r\n"
ARCHIVE_BYTES, SPLIT_BYTES = 64 << 20, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _head(kind: str, record_id: str, length: int, fields: list[tuple[str, str]], content: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Type", content), ("Content-Length", str(length))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def _name(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> list[bytes]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", re.sub(r"[\r\n]", "", url))] if url else []
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Refers-To", f"<{_name(first)}>"), ("WARC-Profile", PROFILE)]
        payload = b""
    return [_head("revisit" if revisit else "response", _name(page_id), len(http) + len(payload), fields, "application/http;msgtype=response"), http, payload, b"\r\n\r\n"]


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages(page_id, url, html, ...) -> archives (path, size) in folder, written by the time this returns.

    Null html counts as empty. Payloads shorter than `least` bytes are always responses. Rows that repeat the smallest page_id of
    their payload are responses too. A null page_id counts as the largest; if all of a payload's are null, all are
    responses. Other columns are ignored; an empty table gives no archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    known = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    known = staged(known.where("copies > 1").select("digest", "first"), "warc-copies")
    joined = rows.join(sized_broadcast(known), "digest", "left").drop("digest")

    def write(stream):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        todo = ((i, u, p, f) for b in stream for i, u, p, f in zip(*(c.to_pylist() for c in b.columns)))
        current = next(todo, None)
        while current is not None:
            size = 0

            def blocks():
                nonlocal current, size
                info = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
                for part in (_head("warcinfo", f"urn:archive:{task}-{number}", len(info), [], "application/warc-fields"), info, b"\r\n\r\n"):
                    size += len(part)
                    yield part
                while current is not None and size < archive_bytes:
                    page_id, url, payload, first = current
                    for part in record(page_id, url, payload, first, first is not None and page_id != first):
                        size += len(part)
                        yield part
                    current = next(todo, None)

            path = f"{folder}/pages-{task:06d}-{number:04d}.warc"
            write_file(path, blocks())
            yield pa.record_batch({"path": [path], "size": pa.array([size], pa.int64())})
            number += 1

    return staged(joined.select("page_id", "url", "payload", "first").mapInArrow(write, "path string, size long"), "warc-archives")


def _successor(data: bytes, at: int) -> tuple[int, int] | None:
    """(end of the header, offset of the next record) of a candidate at `at` in data; None if no header is there.

    Raises IndexError if data ends before the header does.
    """
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise IndexError
    found = re.search(rb"\r\nContent-Length: *(\d{1,18}) *(?:\r\n|\Z)", data[at:end], re.I)
    if not found:
        return None
    return end + 4, end + 8 + int(found[1])


def _span(file, start: int, stop: int, more: int = 1 << 16) -> bytes:
    """Bytes from start to stop, and enough behind for a header that begins before stop."""
    return file.read_at(min(stop + more, file.size()) - start, start)


def candidates(data: bytes, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the candidates in [start, stop) of a file, data being its bytes from start, and their successors."""
    offset, after, at = [], [], data.find(VERSION)
    while 0 <= at < stop - start:
        try:
            ends = _successor(data, at)
        except IndexError:
            ends = None
        if ends:
            offset.append(start + at)
            after.append(start + ends[1])
        at = data.find(VERSION, at + 1)
    return np.array(offset, np.int64), np.array(after, np.int64)


def exits(offset: np.ndarray, after: np.ndarray, stop: int) -> np.ndarray:
    """Where each candidate's chain leaves the split; -1 if it runs into a place that is no candidate."""
    known = dict(zip(offset.tolist(), range(len(offset))))
    out = after.copy()
    for k in range(len(offset) - 1, -1, -1):  # successors lie behind, so they are known already
        if after[k] < stop:
            j = known.get(int(after[k]))
            out[k] = -1 if j is None else out[j]
    return out


def _scan(stream):
    for batch in stream:
        for path, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3))):
            with open_file(path) as file:
                more = 1 << 16
                data = _span(file, start, stop, more)
                while data.find(b"\r\n\r\n", stop - start) < 0 and start + len(data) < file.size():  # a header longer than that
                    more *= 16
                    data = _span(file, start, stop, more)
            offset, after = candidates(data, start, stop)
            yield pa.record_batch({"path": pa.array([path] * len(offset), pa.string()), "at": offset, "to": exits(offset, after, stop)})


def _walk(stream):
    for batch in stream:
        for path, at, stop in zip(*(batch.column(k).to_pylist() for k in range(3))):
            out = []
            with open_file(path) as file:
                data, base, size = b"", at, file.size()
                while at < stop:
                    ends = None
                    want = SPLIT_BYTES
                    while ends is None:  # the whole record must be in data
                        try:
                            ends = _successor(data, at - base) if len(data) > at - base else None
                            if ends and base + ends[1] > base + len(data):
                                want, ends = max(want, base + ends[1] - at), None
                        except IndexError:
                            ends = None
                        if ends is None:
                            if base == at and len(data) >= size - base:
                                raise ValueError(f"{path}: a record is cut off at {at}")
                            want = want if base != at or not data else max(2 * len(data), want)
                            data, base = file.read_at(min(want, size - at), at), at
                    lo, hi = at - base, ends[0]
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[lo : hi - 4].decode("utf-8", "replace").split("\r\n")[1:])}
                    block = data[hi : ends[1] - 4]
                    at = base + ends[1]
                    if fields.get("warc-type") in ("response", "revisit"):
                        out.append((*_page(fields, block), path, base + lo))
                        if len(out) >= 1024:
                            yield _parsed(out)
                            out = []
            if out:
                yield _parsed(out)


def _page(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?:^|\r\n)Content-Length: *(\d+)", http, re.I)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    name = lambda x: int(x) if (x := x.strip("<>").removeprefix("urn:page:")) else None
    page_id = name(fields["warc-record-id"])
    if fields["warc-type"] == "response":
        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"page {page_id}: the payload differs from its digest")
        return page_id, length, digest, "response", None, fields.get("warc-target-uri")
    return page_id, length, digest, "revisit", name(fields["warc-refers-to"]), fields.get("warc-target-uri")


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, at long"


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _PAGES.split(", ")]
    return pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """archives(path, size) -> a row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, archive, at (its offset). Raises if a reachable record is cut off or its payload differs from its digest.

    A record without a page's number has a null page_id, one without a URI a null url. Empty payloads are payloads like others; records that
    repeat give a row each, and a payload of any length may reach over several splits. An archive of size 0 has no records; an empty
    table gives none. An archive that is listed twice is read once. Other columns are ignored.
    """
    spark = archives.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.where("size > 0").select("path", "size", starts.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("stop"))
    splits = staged(splits, "warc-splits")
    tasks = max(spark.sparkContext.defaultParallelism, min(2000, splits.count()))
    jumps = staged(splits.repartition(tasks).mapInArrow(_scan, "path string, at long, to long"), "warc-jumps")
    longest = archives.agg(F.max("size")).first()[0] or 0
    reached = archives.where("size > 0").select("path", F.lit(0).cast("long").alias("at"))
    rounds, first = max(1, int(np.ceil(np.log2(max(2, longest / split_bytes + 1))))), True
    for _ in range(rounds):
        if not first:
            further = jumps.alias("b").select("path", F.col("at").alias("to"), F.col("to").alias("next"))
            jumps = staged(jumps.join(further, ["path", "to"]).select("path", "at", F.col("next").alias("to")), "warc-jumps")
        onward = jumps.join(reached, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = staged(reached.union(onward).distinct(), "warc-reached")
        first = False
    entry = reached.withColumn("start", F.floor(F.col("at") / split_bytes) * split_bytes)
    entry = entry.join(splits, ["path", "start"]).groupBy("path", "stop").agg(F.min("at").alias("at"))
    return entry.select("path", "at", "stop").repartition(tasks).mapInArrow(_walk, _PAGES)


def op10_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


