"""Whole Arrow string columns as flat numpy arrays: one array of code points, one of row starts.

Every text kernel in Python works on these, so the per-character work is
vectorised and no text is looped over in Python. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def _as_string(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def byte_offsets(col: pa.Array) -> np.ndarray:
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]


def slices(col: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Yields (first row, part) with at most max_bytes of text a part, or one row if it alone is longer."""
    col = _as_string(col)
    n, at = len(col), 0
    if n == 0:
        return
    off = byte_offsets(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        yield at, col.slice(at, to - at)
        at = to


def decode(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all rows and the n + 1 row starts among them."""
    col = _as_string(col)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = byte_offsets(col)
    data = col.buffers()[2]
    raw = b"" if data is None else bytes(memoryview(data)[int(off[0]) : int(off[-1])])
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1] - off[0], off[1:] - off[0])]
        return of_strings(rows)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(text) == len(raw):
        return cps, off - off[0]
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    return cps, count[off - off[0]]


def of_strings(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cps = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=starts[1:])
    return cps, starts


def compact(values: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops the values that are not kept and moves the row starts accordingly."""
    count = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return values[keep], count[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial of values[i:j], shifted by i; see span_hash."""
    up, _ = _power(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values.astype(U64) + U64(0x1234567)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Karp-Rabin digests of the spans [start, stop): equal spans have equal digests wherever they stand."""
    _, down = _power(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(U64))


def row_ids(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def list_array(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))
