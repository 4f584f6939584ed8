"""Tables of counters in which all tasks count, put together on the executors and small enough to broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Cells of a block, the unit that is shuffled: compressed, as most counters of a task are 0 or small.
BLOCK = 1 << 14
#: Bounds of the size of a table, as powers of two; a task holds one table of 4-byte counters.
LEAST_BITS, MOST_BITS = 14, 24
#: Steps in which a count doubles: counts are kept as levels of one byte.
STEPS = 8


def bits_for(cells: int) -> int:
    """The power of two of a table for about so many counters."""
    return min(max(int(max(cells, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys) >> np.uint64(64 - bits)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as levels on a logarithmic scale; 0 and 1 have levels of their own."""
    return np.round(STEPS * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def counts_of(level: np.ndarray) -> np.ndarray:
    return np.exp2(level / STEPS) - 1


ONCE = int(levels(np.array([1]))[0])


def _packed(block: np.ndarray) -> bytes:
    """Byte planes one after the other: the upper ones are nearly all zero."""
    return zstandard.ZstdCompressor(level=1).compress(block.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def level_table(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Levels of the counts of all keys that keys_of yields for the batches of rows: one byte for each of 2**bits cells.

    Every task counts in a table of its own; its blocks are summed on the executors, and only levels reach the
    driver. Keys that share a cell share a count, which is never below the true one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for keys in keys_of(batches):
            at = cells(keys, bits)
            if 16 * len(at) > len(table):
                table += np.bincount(at, minlength=len(table)).astype(np.uint32)
            else:
                np.add.at(table, at, np.uint32(1))
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([_packed(blocks[b]) for b in used], pa.binary())], names=["block", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(b, np.zeros(BLOCK, np.uint64))
                own += _unpacked(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([levels(s).tobytes() for s in sums.values()], pa.binary())], names=["block", "data"])

    shape = "block int, data binary"
    got = rows.mapInArrow(count, shape).repartition("block").mapInArrow(total, shape).collect()
    table = np.zeros(1 << bits, np.uint8)
    for r in got:
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["data"], np.uint8)
    return table
