"""Text columns of Arrow batches as arrays of code points (numpy), for tasks that work on all characters of some pages at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import WHITESPACE_RANGES

NO_CHAR = 0x110000  # one past the last code point
SPACE = np.zeros(NO_CHAR + 1, bool)
for _lo, _hi in WHITESPACE_RANGES:
    SPACE[_lo:_hi + 1] = True


def string_parts(strings: pa.Array) -> tuple[np.ndarray, bytes]:
    """(byte offsets from 0, bytes) of a string column, whatever slice of its buffers it is; null strings are empty."""
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    if not len(strings):
        return np.zeros(1, np.int64), b""
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, kind)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    return at - at[0], data[int(at[0]):int(at[-1])].to_pybytes() if data is not None else b""


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, where each string starts, and one past the last)."""
    at, data = string_parts(strings)
    text = data.decode("utf-8")
    if len(text) < len(data):
        leads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(leads)])[at]
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), at


def strings_of(cps: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string column: string ``i`` holds the code points from ``ends[i]`` to ``ends[i + 1]``."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    return joined_strings(np.concatenate([[0], np.cumsum(width)])[ends], data)


def joined_strings(at: np.ndarray, data: bytes) -> pa.Array:
    """A string column of the byte offsets ``at`` into ``data``."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data))


def single_characters(cps: np.ndarray) -> pa.Array:
    """A string column of one character each; ``NO_CHAR`` is the empty string."""
    seen = np.zeros(NO_CHAR + 1, bool)
    seen[cps] = True
    codes = np.flatnonzero(seen)
    place = np.zeros(NO_CHAR + 1, np.int32)
    place[codes] = np.arange(len(codes))
    return pa.array(["" if c == NO_CHAR else chr(c) for c in codes.tolist()], pa.string()).take(pa.array(place[cps]))


def list_parts(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of a list column; a null list is empty."""
    size = np.diff(column.offsets.to_numpy().astype(np.int64))
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
    return np.concatenate([[0], np.cumsum(size)]), column.flatten()


def integers(column: pa.Array, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64) if column.null_count else column.to_numpy(zero_copy_only=False).astype(np.int64)


def codes(column: pa.Array) -> np.ndarray:
    """Small numbers that are equal where the values are, nulls included."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def within(size: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``size``, one after the other."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(first, size)


def slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most ``most`` (a larger one by itself)."""
    ends, first = np.cumsum(size), 0
    while first < len(size):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last
