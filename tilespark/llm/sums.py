"""Sums of integer tables over all partitions, without gathering a group in memory.

A map task turns its table into sparse blocks; the blocks of one number meet
sorted in a task that adds them one by one, so it holds one block at a time.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLOCK = 1 << 14
DDL = "block long, data binary"


def _data(own: np.ndarray) -> bytes:
    """The non-zero cells of a block: their numbers, then their values by byte planes, compressed."""
    at = np.flatnonzero(own)
    planes = np.ascontiguousarray(own[at].astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(at.astype("<u2").tobytes() + planes.tobytes())


def to_blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Non-zero cells of a flat integer table as (block, cell numbers then values)."""
    for k in range(0, len(table), BLOCK):
        own = table[k : k + BLOCK]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([_data(own)], pa.binary())], names=["block", "data"])


def _add(own: np.ndarray, data: bytes) -> None:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = len(data) // 10
    planes = np.frombuffer(data, np.uint8, 8 * n, 2 * n).reshape(8, n)
    own[np.frombuffer(data, "<u2", n)] += np.ascontiguousarray(planes.T).view("<i8").ravel()


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, own = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_data(own)], pa.binary())], names=["block", "data"])

    for b in batches:
        for k, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
            if k != block:
                if block is not None:
                    yield done()
                block, own = k, np.zeros(BLOCK, np.int64)
            _add(own, data)
    if block is not None:
        yield done()


def collect_sum(parts: DataFrame, size: int) -> np.ndarray:
    """The summed table; ``size`` is fixed by the caller's parameters, so the driver's share is bounded."""
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_sum, DDL)
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for r in summed.toLocalIterator():
        _add(out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK], r["data"])
    return out[:size]
