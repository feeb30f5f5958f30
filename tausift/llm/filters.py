"""A filter of hashes that is put together where the rows lie and has a bounded size, for broadcast."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each hash, and bits at most: 16 MB. A fuller filter lets more through, which the join behind it
#: then leaves out.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Bits in the parts from which it is put together.
_PART = 1 << 16


def filter_bits(count: int) -> int:
    """The size of a filter for so many hashes, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * count).bit_length()))


class HashFilter:
    """A bitmap of 64-bit hashes: none that was put in is missed, a few others pass."""

    def __init__(self, bits: int, packed: bytes) -> None:
        self.mask, self.packed = bits - 1, packed

    @classmethod
    def of(cls, hashes: np.ndarray) -> HashFilter:
        whole = np.zeros(filter_bits(len(hashes)), bool)
        whole[(hashes.view(np.uint64) & np.uint64(len(whole) - 1)).astype(np.int64)] = True
        return cls(len(whole), np.packbits(whole, bitorder="little").tobytes())

    def __contains__(self, h: int) -> bool:
        h &= self.mask
        return bool(self.packed[h >> 3] >> (h & 7) & 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these unsigned hashes pass."""
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        return (np.frombuffer(self.packed, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def hash_filter(hashes: DataFrame) -> HashFilter:
    """The filter of the long column `h`. Its parts come to the driver, at most MOST_BITS in all."""
    bits = filter_bits(hashes.agg(F.approx_count_distinct("h")).first()[0])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(bits, bool)
        for batch in batches:
            whole[batch.column(0).to_numpy() & (bits - 1)] = True
        parts = np.flatnonzero(whole.reshape(-1, _PART).any(axis=1)).tolist()
        packed = [np.packbits(whole[k * _PART : (k + 1) * _PART], bitorder="little").tobytes() for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["k", "b"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(_PART // 8, np.uint8)
        for b in rows.column("b").to_pylist():
            out |= np.frombuffer(b, np.uint8)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([out.tobytes()], pa.binary())})

    parts = hashes.select("h").mapInArrow(gather, "k int, b binary").groupBy("k").applyInArrow(merge, "k int, b binary")
    packed = bytearray(bits // 8)
    for r in parts.collect():
        packed[r.k * (_PART // 8) : (r.k + 1) * (_PART // 8)] = bytes(r.b)
    return HashFilter(bits, bytes(packed))
