"""Bloom filters of once- or of repeatedly-seen 64-bit hashes, merged over partitions, that grow with the data.

Hashes fall into blocks by their first bits, about BLOCK_RECORDS a block however many there are. Each partition sends
the sorted positions of its hashes among SPREAD positions a record, some two bytes a record, in one message a block;
a block is merged by one task, which knows a position as repeated if any part repeats it or two parts have it. The
merged positions stay in the shared folder. A filter that is broadcast covers a range of blocks and has at most
max_bits bits: where all positions wanted need more, there are several filters, one a range of hashes, and the
records are passed by the filter of their range. So a filter is never fuller than BITS_PER_RECORD allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import flat
from weftline.llm.common import sorted_distinct, stored

#: Records of a block, and positions a record among which they are told apart before they are filtered.
BLOCK_RECORDS, SPREAD = 1 << 17, 64
#: Most bits of one filter (64 MB packed), its bits for each position held, and the bits set for one.
MAX_BITS = 1 << 29
BITS_PER_RECORD, PROBES = 12, 4
#: Hashes that a partition sorts at once.
FLUSH = 1 << 22


@dataclass
class Filter:
    """The hashes of blocks first to last; packed holds block_bits bits of each block."""

    packed: np.ndarray
    first: int
    last: int
    width: int  # bits of a hash that tell its block
    depth: int  # bits of a hash that tell its position
    block_bits: int

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be among those seen; never False for one that is."""
        block, at = self._places(h.view(np.uint64))
        ok = (block >= self.first) & (block <= self.last)
        base = np.where(ok, block - self.first, 0) * self.block_bits
        for place in at:
            bit = base + place
            ok &= (self.packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 != 0
        return ok

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        position = h >> np.uint64(64 - self.depth)
        return block_of(position, self.depth, self.width), probes(position, self.block_bits)


def block_of(position: np.ndarray, depth: int, width: int) -> np.ndarray:
    return (position >> np.uint64(depth - width)).astype(np.int64)


def probes(position: np.ndarray, block_bits: int) -> list[np.ndarray]:
    x = flat.mix(position + np.uint64(0x51))
    return [((x >> np.uint64(16 * k)) * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) & (block_bits - 1) for k in range(PROBES)]


def _pack(positions: np.ndarray) -> bytes:
    if not len(positions):
        return b""
    gaps = np.diff(positions, prepend=positions[:1])
    narrow = gaps.astype(np.uint32) if gaps.max() < 1 << 32 else gaps
    return bytes([narrow.dtype.itemsize]) + positions[:1].tobytes() + zlib.compress(narrow.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(zlib.decompress(data[9:]), np.uint32 if data[0] == 4 else np.uint64)
    return np.frombuffer(data[1:9], np.uint64)[0] + np.cumsum(gaps, dtype=np.uint64)


def _messages(h: np.ndarray, width: int, depth: int) -> pa.RecordBatch:
    once, n = sorted_distinct(h.view(np.uint64) >> np.uint64(64 - depth))
    twice = once[n > 1]
    block = block_of(once, depth, width)
    blocks, first = np.unique(block, return_index=True)
    ends = np.append(first[1:], len(once))
    mine = block_of(twice, depth, width)
    low, high = np.searchsorted(mine, blocks), np.searchsorted(mine, blocks, "right")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(blocks),
            pa.array([_pack(once[a:b]) for a, b in zip(first, ends)], pa.binary()),
            pa.array([_pack(twice[a:b]) for a, b in zip(low, high)], pa.binary()),
        ],
        ["block", "once", "twice"],
    )


def partial_filters(width: int, depth: int):
    """mapInArrow function: h -> (block, once, twice), the sorted positions of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            kept.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            if sum(map(len, kept)) >= FLUSH:
                yield _messages(np.concatenate(kept), width, depth)
                kept = []
        if sum(map(len, kept)):
            yield _messages(np.concatenate(kept), width, depth)

    return run


def _merge(repeats: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        seen, n = sorted_distinct(np.concatenate([_unpack(x) for x in part["once"]]))
        if repeats:
            seen = sorted_distinct(np.concatenate([seen[n > 1], *(_unpack(x) for x in part["twice"])]))[0]
        return pd.DataFrame({"block": part["block"].iloc[:1], "n": [len(seen)], "positions": [_pack(seen)]})

    return run


def _block_bits(block_bits: int):
    """mapInArrow function: (block, positions) -> (block, bits), the packed bits of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                bits = np.zeros(block_bits, bool)
                for place in probes(_unpack(data), block_bits):
                    bits[place] = True
                out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "bits"])

    return run


def _power(n: float) -> int:
    """The exponent of the least power of two that is n at least."""
    return max(0, int(np.ceil(np.log2(max(1.0, n)))))


def fit(hashes: DataFrame, max_bits: int = MAX_BITS, repeated: bool = False, single: bool = False) -> Iterator[Filter]:
    """Filters of the one column of hashes, of those seen (or, if repeated, seen twice) in all rows, range by range.

    Each has max_bits bits at most, is made when it is asked for, and covers the hashes of its blocks only. single: one
    filter for all, which is fuller and lets more pass where it would need more bits.
    """
    records = max(1, hashes.count())
    width = _power(records / BLOCK_RECORDS)
    depth = min(62, max(width + 1, _power(records * SPREAD)))
    parts = hashes.mapInArrow(partial_filters(width, depth), "block long, once binary, twice binary")
    merged = stored(parts.groupBy("block").applyInPandas(_merge(repeated), "block long, n long, positions binary"))
    most = merged.agg(F.max("n")).first()[0] or 0
    block_bits = 1 << max(6, _power(most * BITS_PER_RECORD))
    if single:
        block_bits = max(64, min(block_bits, 1 << int(np.log2(max(1, max_bits >> width)))))
    step = 1 << width if single else max(1, max_bits // block_bits)
    for first in range(0, 1 << width, step):
        last = min(first + step, 1 << width) - 1
        packed = np.zeros((last - first + 1) * block_bits // 8, np.uint8)
        own = merged.where((F.col("block") >= first) & (F.col("block") <= last) & (F.col("n") > 0)).select("block", "positions")
        for block, data in own.mapInArrow(_block_bits(block_bits), "block long, bits binary").toLocalIterator():
            at = (block - first) * block_bits // 8
            packed[at : at + block_bits // 8] = np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
        yield Filter(packed, first, last, width, depth, block_bits)


def fit_one(hashes: DataFrame, max_bits: int = MAX_BITS) -> Filter:
    return next(fit(hashes, max_bits, single=True))
