"""Sets of hashes as bits: filters of a bounded size that are sent to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bits_for(entries: int, each: int, most: int, least: int = 1 << 10) -> int:
    """A power of two of about `each` bits an entry, between `least` and `most`."""
    return min(1 << most.bit_length() - 1, max(least, 1 << max(1, each * entries).bit_length()))


def place(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each hash."""
    x = hashes.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(bits - 1)).astype(np.int64)


def _placed(bits: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at // (bits // parts)).astype(np.int32)), pa.array(at)], names=["part", "at"])

    return run


def _part(bits: int, parts: int):
    """(part, found): the bits of one part, packed; a task has one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = np.zeros(bits // parts, bool), None
        for batch in batches:
            at = batch["at"].to_numpy()
            if len(at):
                part = int(at[0]) // (bits // parts)
                found[at - part * (bits // parts)] = True
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["part", "found"])

    return run


def gathered(hashes: DataFrame, bits: int) -> bytes:
    """The set of a column of 64-bit hashes: bits / 8 bytes, put together part by part by the tasks."""
    parts = min(64, max(1, bits >> 16))
    out, size = np.zeros(bits // 8, np.uint8), bits // parts // 8
    placed = hashes.mapInArrow(_placed(bits, parts), "part int, at bigint")
    # bits / 8 bytes in all
    for part, blob in placed.repartitionById(parts, "part").mapInArrow(_part(bits, parts), "part int, found binary").collect():
        out[part * size : (part + 1) * size] = np.frombuffer(blob, np.uint8)
    return out.tobytes()


def opened(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
