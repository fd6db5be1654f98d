"""Batches of rows that Python code reads."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(stream: Iterable[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so few at a time that what Python makes of them stays small."""
    for batch in stream:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
