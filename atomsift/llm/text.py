"""Byte-level text kernels shared by the operators of this folder.

A batch of texts is handled as one byte buffer with offsets, as Arrow keeps it.
Words are runs of bytes other than space and the control bytes 9 to 13; no byte
of a longer UTF-8 sequence is among those, so cutting bytes cuts whole characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (shifts and odd multipliers), element by element."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


class Texts:
    """Texts of one chunk: lower-cased bytes, offsets, and their words."""

    _powers = _Powers()

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = data, offsets
        upper = (data >= 65) & (data <= 90)
        self.data = data + (upper * np.uint8(32))
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        if n:
            before = np.empty(n, bool)
            before[0] = True
            before[1:] = blank[:-1]
            after = np.empty(n, bool)
            after[-1] = True
            after[:-1] = blank[1:]
            self.starts = np.flatnonzero(~blank & (before | begins[:-1]))
            self.ends = np.flatnonzero(~blank & (after | begins[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1

    def __len__(self):
        return len(self.offsets) - 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range of the lower-cased buffer."""
        up, down = self._powers.upto(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def chunks(column, size: int = CHUNK_BYTES, most: int = 4096):
    """``(first row, Texts)`` pieces of a column: whole texts, about ``size`` bytes each."""
    if len(column) == 0:
        return
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n, row + most)
        part = offsets[row : end + 1]
        yield row, Texts(data[part[0] : part[-1]], part - part[0])
        row = end


def per_text(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    """Counts or sums per text, for sorted or unsorted text numbers."""
    return np.bincount(doc, weights, minlength=n)


def lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """List column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    flat = pa.array(values) if kind is None else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
