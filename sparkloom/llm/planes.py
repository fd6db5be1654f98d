"""Token-id shards in shuffled planes.

A shard is one file: MAGIC, chunks, index, length of the index (8 bytes, little-endian), MAGIC. A chunk holds up to
CHUNK_IDS ids as little-endian unsigned 32-bit integers, transposed into 4 byte planes or 32 bit planes, each compressed
with zstandard; high planes, nearly constant, shrink to a few bytes. The index is an Arrow IPC stream compressed with
zstandard, of two batches: documents (doc_id, n_tokens) in order, and chunks (offset, n_ids, crc32 of the ids, lengths of the
planes), so that a reader can seek to any chunk. Shards are numbered in ascending order of doc_id and hold disjoint
ranges; a manifest (JSON) lists them with the ids before each.

A writer holds one chunk; a reader one chunk. Files are written under another name and renamed, so that a task that is run
again after an executor is lost replaces its file by the same bytes.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, open_file, table, write_file
from .encoding import library_encoder, separated
from .shingles import slices

MAGIC = b"PLN1"
CHUNK_IDS = 1 << 16
LEVEL = 1

_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_CHUNKS = pa.schema([("offset", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("planes", pa.list_(pa.int64()))])


def shuffle(raw: bytes, bits: bool = False) -> list[bytes]:
    """Planes of little-endian 32-bit integers, least significant first."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(32)]
    return [rows[:, k].tobytes() for k in range(4)]


def unshuffle(planes: list[bytes], n: int) -> bytes:
    if len(planes) == 32:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        return np.packbits(rows, axis=1, bitorder="little").tobytes()
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).tobytes()


def shard_bytes(documents: Iterator[tuple[int | None, bytes]], total: list[int], bits: bool = False) -> Iterator[bytes]:
    """A shard of (doc_id, ids) in order, piece by piece. total gets the number of documents and of ids."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL)
    yield MAGIC
    at, held, size, index, chunks = len(MAGIC), [], 0, [], []

    def chunk(raw: bytes) -> bytes:
        nonlocal at
        planes = [packer.compress(p) for p in shuffle(raw, bits)]
        out = b"".join(planes)
        chunks.append((at, len(raw) // 4, zlib.crc32(raw), [len(p) for p in planes]))
        at += len(out)
        return out

    for doc_id, ids in documents:
        index.append((doc_id, len(ids) // 4))
        held.append(ids)
        size += len(ids)
        if size >= 4 * CHUNK_IDS:
            raw = b"".join(held)
            whole = size - size % (4 * CHUNK_IDS)
            for lo in range(0, whole, 4 * CHUNK_IDS):
                yield chunk(raw[lo : lo + 4 * CHUNK_IDS])
            held, size = [raw[whole:]], size - whole
    if size:
        yield chunk(b"".join(held))
    sink = io.BytesIO()
    for rows, schema in ((index, _DOCUMENTS), (chunks, _CHUNKS)):
        cols = list(zip(*rows)) or [[] for _ in schema]
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema))
    packed = packer.compress(sink.getvalue())
    yield packed + len(packed).to_bytes(8, "little") + MAGIC
    total[:] = [len(index), sum(n for _, n in index)]


class Shard:
    """A shard file opened for reading."""

    def __init__(self, uri: str):
        import zstandard

        self.file = open_file(uri)
        end = self.file.size()
        tail = self.file.read_at(12, end - 12)
        if tail[8:] != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is not a whole shard")
        size = int.from_bytes(tail[:8], "little")
        self.unpacker = zstandard.ZstdDecompressor()
        source = io.BytesIO(self.unpacker.decompress(self.file.read_at(size, end - 12 - size)))
        self.documents, self.chunks = (pa.ipc.open_stream(source).read_all() for _ in range(2))

    def chunk(self, k: int) -> bytes:
        offset, n, crc, sizes = (self.chunks.column(c)[k].as_py() for c in range(4))
        raw = self.file.read_at(sum(sizes), offset)
        ends = np.cumsum([0, *sizes]).tolist()
        width = n if len(sizes) == 4 else (n + 7) // 8
        ids = unshuffle([self.unpacker.decompress(raw[a:b], max_output_size=width) for a, b in zip(ends, ends[1:])], n)
        if zlib.crc32(ids) != crc:
            raise ValueError("a chunk's ids differ from those written")
        return ids

    def __iter__(self) -> Iterator[tuple[int | None, list[bytes]]]:
        """(doc_id, its ids in one or more byte strings)."""
        held, at, k = b"", 0, 0
        for doc_id, n in zip(self.documents.column(0).to_pylist(), self.documents.column(1).to_pylist()):
            want, parts = 4 * n, []
            while want:
                if at == len(held):
                    held, at, k = self.chunk(k), 0, k + 1
                part = held[at : at + want]
                parts.append(part)
                at += len(part)
                want -= len(part)
            yield doc_id, parts


def write_shards(docs: DataFrame, folder: str, encode: Callable[[], Callable[[list], list[bytes]]], end_id: int | None, bits: bool = False) -> list[dict]:
    """Write docs(doc_id, text, ...) as shards in ascending doc_id order and return the manifest's entries.

    encode() gives, in a worker, a function from texts to little-endian ids; end_id is appended to each document. Null
    text counts as empty; rows without a doc_id come first; rows that repeat a doc_id each count, in the order of their
    texts' hashes. Other columns are ignored. An empty table gives no shard. The manifest has one entry per partition.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(stream):
        from pyspark import TaskContext

        coder = encode()

        def documents():
            for batch in stream:
                ids = batch.column(0).to_pylist()
                for lo, hi, texts in slices(batch.column(1)):
                    for doc_id, raw in zip(ids[lo:hi], coder(texts)):
                        yield doc_id, raw + end

        rows = documents()
        first = next(rows, None)
        if first is None:
            return

        def chained():
            yield first
            yield from rows

        shard, total = TaskContext.get().partitionId(), [0, 0]
        path = f"{folder}/shard-{shard:08d}.planes"
        write_file(path, shard_bytes(chained(), total, bits))
        yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array(total[:1], pa.int64()), "n_tokens": pa.array(total[1:], pa.int64())})

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    entries = sorted(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long").collect(), key=lambda r: r.shard)
    out, start = [], 0
    for r in entries:
        out.append({"path": r.path, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start})
        start += r.n_tokens
    write_file(f"{folder}/manifest.json", [json.dumps(out).encode()])
    return out


def read_manifest(folder: str) -> list[dict]:
    with open_file(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_shards(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of the shards in folder; with ids=True also `ids` binary."""
    entries = [(e["path"], e["start"]) for e in read_manifest(folder)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def read(stream):
        for batch in stream:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for doc_id, parts in Shard(path):
                    crc = n = 0
                    for part in parts:
                        crc = zlib.crc32(part, crc)
                        n += len(part) // 4
                    out.append((doc_id, start, n, crc) + ((b"".join(parts),) if ids else ()))
                    start += n
                    if len(out) >= (64 if ids else 4096):
                        yield _batch(out, ids)
                        out = []
                if out:
                    yield _batch(out, ids)

    files = spark.createDataFrame(entries, "path string, start long")
    return (files.repartition(max(1, len(entries))) if entries else files).mapInArrow(read, schema)


def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    return pa.record_batch({n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))})


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, folder = P.path("word_bpe_49k.json"), fresh_path(spark, "planes")
    write_shards(table(spark, sf_dir, "documents"), folder, lambda: library_encoder(path, separated), 1)
    return read_shards(spark, folder)
