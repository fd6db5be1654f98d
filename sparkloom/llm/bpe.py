"""Byte-level BPE with a hierarchical-bitmap rank queue, and its decoder.

Merging a pre-token keeps its parts in a doubly linked list. Every adjacent pair that the vocabulary can merge is put in
the bucket of its rank; a bitmap over ranks in 256-bit words, under a bitmap of the words in use, tells which buckets hold
positions, and two find-first-set steps name the smallest rank. That bucket's positions are taken from left to right; an entry
whose pair has changed meanwhile is stale and skipped. A pre-token of n bytes costs O(n) queue operations (and a sort within a bucket), so very long
pre-tokens need no special case.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import kept
from .encoding import Encoder, Ids, spaced
from .shingles import slices

#: Ids that are decoded at a time.
DECODED = 1 << 20


class Merger:
    """Ids of one pre-token at a time, by a vocabulary of ranks. The queue is empty between calls."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * (max(ranks.values(), default=0) // 256 + 1)
        self.buckets: dict[int, int | list[int]] = {}  # a lone position, or a heap of them
        self.bits = [1 << k for k in range(max(256, len(self.low)))]

    def __call__(self, token: bytes) -> list[int]:
        rank_of, low, buckets, bits = self.ranks.get, self.low, self.buckets, self.bits
        whole = rank_of(token)
        if whole is not None:
            return [whole]
        n, top = len(token), 0
        end = list(range(1, n + 1))  # of the part that starts at a position; 0 once it belongs to the part before
        before = list(range(-1, n))
        waits = [None] * n  # the rank that the pair starting at a position waits under
        for k in range(n - 1):
            rank = rank_of(token[k : k + 2])
            if rank is not None:
                waits[k] = rank
                if rank in buckets:
                    self._join(rank, k)
                else:
                    buckets[rank] = k
                    low[rank >> 8] |= bits[rank & 255]
                    top |= bits[rank >> 8]
        while top:
            word = (top & -top).bit_length() - 1
            inner = low[word]
            rank = word << 8 | (inner & -inner).bit_length() - 1
            k = buckets[rank]
            if k.__class__ is list:
                if len(k) > 1:
                    k = heappop(k)
                    inner = 0
                else:
                    k = k[0]
            if inner:
                del buckets[rank]
                low[word] = inner = inner & (inner - 1)
                if not inner:
                    top &= top - 1
            if waits[k] != rank:
                continue  # stale
            gone = end[k]
            end[k] = stop = end[gone]
            end[gone] = 0
            waits[gone] = waits[k] = None
            before[stop] = k
            if stop < n:
                rank = rank_of(token[k : end[stop]])
                if rank is not None:
                    waits[k] = rank
                    if rank in buckets:
                        self._join(rank, k)
                    else:
                        buckets[rank] = k
                        low[rank >> 8] |= bits[rank & 255]
                        top |= bits[rank >> 8]
            k = before[k]
            if k >= 0:
                rank = rank_of(token[k:stop])
                if rank != waits[k]:
                    waits[k] = rank
                    if rank is not None:
                        if rank in buckets:
                            self._join(rank, k)
                        else:
                            buckets[rank] = k
                            low[rank >> 8] |= bits[rank & 255]
                            top |= bits[rank >> 8]
        out, k = [], 0
        while k < n:
            stop = end[k]
            out.append(rank_of(token[k:stop]))
            k = stop
        return out

    def _join(self, rank: int, k: int) -> None:
        bucket = self.buckets[rank]
        if bucket.__class__ is list:
            heappush(bucket, k)
        else:
            self.buckets[rank] = [bucket, k] if bucket < k else [k, bucket]


class Codec:
    """text -> little-endian 32-bit ids -> bytes, by a file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        width = max(self.ranks.values()) + 1
        known = [b""] * width
        for token, rank in self.ranks.items():
            known[rank] = token
        self.size = np.array([len(x) for x in known], np.int64)
        self.start, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(known), np.uint8)
        self.split = regex.compile(pattern).findall
        self.merger = Merger(self.ranks)
        self.encode = Encoder(spaced, self._many, lambda text: self._many([text])[0], id_type=np.uint16 if width <= 1 << 16 else np.uint32)

    def _many(self, pieces: list[str]) -> Ids:
        ids, counts = array("I"), []
        for piece in pieces:
            before = len(ids)
            for token in self.split(piece):
                ids.extend(self.merger(token.encode()))
            counts.append(len(ids) - before)
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def decode(self, ids: bytes) -> bytes:
        out = []
        for lo in range(0, len(ids), 4 * DECODED):
            found = np.frombuffer(ids[lo : lo + 4 * DECODED], "<u4")
            size = self.size[found]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.start[found] - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def codec(path: str, pattern: str) -> Codec:
    """One per worker process, so that words stay remembered between tasks."""
    return kept(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with `ids` binary (little-endian unsigned 32-bit) instead of its text; null text counts as empty.

    Any columns and repeated rows pass through; a column named ids is replaced.
    """
    others = [c for c in docs.columns if c not in (text, "ids")]
    schema = docs.select(*others).schema.add("ids", "binary")

    def run(stream):
        coder = codec(path, pattern)
        for batch in stream:
            for lo, hi, texts in slices(batch.column(len(others))):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(coder.encode(texts), pa.binary())], [*others, "ids"])

    return docs.select(*others, text).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, pattern: str, make: Callable[[bytes, bytes], tuple], schema: str) -> DataFrame:
    """docs(doc_id, ids binary) -> doc_id and what make(ids, decoded bytes) gives, typed by `schema`. Null ids decode to nothing."""
    fields = docs.select("doc_id").schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    full = StructType([*fields.fields, *made.fields])

    def run(stream):
        coder = codec(path, pattern)
        for batch in stream:
            out = [make(ids, coder.decode(ids)) for ids in (x or b"" for x in batch.column(1).to_pylist())]
            cols = list(zip(*out)) or [()] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) if c else pa.array([], pa.null()) for c in cols)], [f.name for f in full])

    return docs.select("doc_id", "ids").mapInArrow(run, full)


def _digests(ids: bytes, decoded: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op4_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .common import table

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, P.PATTERN)
    return decode_documents(ids, path, P.PATTERN, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
