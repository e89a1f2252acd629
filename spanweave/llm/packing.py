"""Integer arrays as bytes for binary columns."""

from __future__ import annotations

import numpy as np

_TYPES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on, in the narrowest width that holds them, byte planes apart so that a general compressor takes them well."""
    out, planes = [np.array([len(arrays)], np.int64).tobytes()], []
    for a in arrays:
        top = int(a.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - (w == 8)))
        out.append(np.array([len(a), width], np.int64).tobytes())
        planes.append(np.ascontiguousarray(a.astype(_TYPES[width]).view(np.uint8).reshape(len(a), width).T).tobytes())
    return b"".join([*out, *planes])


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`, as 64-bit integers."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + head.nbytes, []
    for length, width in head.tolist():
        planes = np.frombuffer(data, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_TYPES[width]).astype(np.int64))
        at += length * width
    return out
