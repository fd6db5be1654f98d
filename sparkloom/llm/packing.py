"""Packing by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into full pieces and a remainder. Only the histogram of piece lengths (at most
`capacity` numbers) reaches the driver, where lengths are placed longest first: each goes to the open packs that are
filled least and still have room, a whole count at a time, splitting a packing pattern's count when the two differ. The
patterns (a bounded table: their number depends on the histogram's width, not on the documents) then go back to the
pieces by rank: the r-th piece of a length takes the r-th place of that length over all patterns.

A piece's rank is its number within its task and length, plus the count of that length in earlier tasks, so ranks need
neither a global sort nor a shuffle of pieces by length, which a frequent length would skew. Pieces are staged once
before ranking, so that all counts speak of the same tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized_broadcast, staged, table
from .encoding import library_encoder, spaced
from .shingles import slices

CAPACITY = 1024


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pack in order, number of such packs)]; lengths from 1 to capacity."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not packs[most]:
                most -= 1
            if most < length:
                packs[capacity - length].append(((length,), left))
                most = max(most, capacity - length)
                break
            lengths, count = packs[most].pop()
            used = min(count, left)
            if count > used:
                packs[most].append((lengths, count - used))
            packs[most - length].append((lengths + (length,), used))
            left -= used
    return [p for room in sorted(packs) for p in packs[room]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first ranks, first sequences, offsets) of its runs of places; a run is a slot of a pattern."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            runs[length].append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in runs.items()}


def _cut(encode: Callable[[], Callable[[list], list[bytes]]], end_id: int | None, capacity: int, with_ids: bool):
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(stream):
        from pyspark import TaskContext

        coder, task = encode(), TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        for batch in stream:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in slices(batch.column(1)):
                out = []
                for doc_id, raw in zip(ids[lo:hi], coder(texts)):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        piece = raw[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        out.append((task, doc_id, start, length, zlib.crc32(piece), n, ranks[length]) + ((piece,) if with_ids else ()))
                        ranks[length] += 1
                if out:
                    names = ["task", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids"]
                    yield pa.record_batch({n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))})

    return cut


def _placed(where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def place(stream):
        for batch in stream:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, start, at = where[n]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = start[run] + rank[own] - first[run]
                offset[own] = at[run]
            kept = [n for n in batch.schema.names if n not in ("task", "rank")]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, encode: Callable[[], Callable[[list], list[bytes]]], end_id: int | None = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens (ids, if asked for),
    sequence_id, offset.

    encode() gives, in a worker, a function from texts to little-endian ids; end_id is appended to each document. Null text counts as empty: with an end id
    it makes a piece of one id, without one no piece. Repeated rows and null doc_ids are packed like others. A very long text is cut
    into as many pieces as it needs. Pieces of one length tie: which takes which place goes by tasks and the order in them. Other columns are
    ignored. An empty table gives an empty result.
    """
    schema = "task long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long" + ", ids binary" * with_ids
    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(encode, end_id, capacity, with_ids), schema), "pack-pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "pack-base")
    ranked = pieces.join(sized_broadcast(base), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    out = [f for f in pieces.schema.names if f not in ("task", "rank")]
    return ranked.select("rank", *out).mapInArrow(_placed(where), ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in out) + ", sequence_id long, offset long")


def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of docs under the 50k byte-level vocabulary, id 0 after each document, sequences of 1024; see pack for nulls, long texts, ties,
    repeated rows, other columns and empty tables."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    return pack(docs, lambda: library_encoder(path, spaced))
