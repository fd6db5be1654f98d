"""Word shingles of a batch of texts, hashed with numpy.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. A shingle is
five words in a row; a text of one to four words has one shingle, all its words. A null, empty or wordless text has
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_M = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _M(2) + _M(1)
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * _M(2) + _M(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> _M(30))
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and for each text the offset of its first word (with a last one past the end)."""
    raw = "\0".join([(t.replace("\0", " ") if "\0" in t else t) if t else "" for t in texts]).lower().encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = flips[0::2], flips[1::2]
    up, down = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * down[starts])
    breaks = np.flatnonzero(data == 0)
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:-1] = np.searchsorted(starts, breaks)
    offsets[-1] = len(starts)
    return hashes, offsets


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of texts among them, word hashes, offsets of texts among those)."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    run = np.zeros(len(words), np.uint64)
    for j in range(WIDTH):
        run += padded[j : j + len(words)] * _PLACE[j]
    kept = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(kept)])
    index = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], kept)
    out = run[index]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    for k in short:  # fewer than five words: the whole sequence
        own = words[at[k] : at[k + 1]]
        out[offsets[k]] = (own * _PLACE[: len(own)]).sum() ^ _M(len(own))
    return mix(out), offsets, words, at


def slices(column: pa.Array, limit: int = 500_000):
    """(from, to, texts) of parts of an Arrow column whose texts hold about `limit` bytes at most; a longer text is a part of its own.
    Only a part's texts are Python strings at a time."""
    size = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(size):
        if total and total + n > limit:
            yield start, k, column[start:k].to_pylist()
            start, total = k, 0
        total += n + 1
    if start < len(size):
        yield start, len(size), column[start:].to_pylist()


def batches(texts: list[str | None], limit: int = 500_000):
    """Slices of a list whose texts hold about `limit` characters at most; a longer text is a slice of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, k
            start, size = k, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)
