"""Vectorized words of many texts: hashes, endings and the document of each word."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACES = b" \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts of about PIECE_BYTES, cut at spaces."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, code of the last two bytes, first byte's position) of every word of ``raw``.

    A word is a run of bytes that are not one of the six ASCII spaces.
    """
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    length = ends - starts
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()), _BASE), dtype=np.uint64)
        inner = np.flatnonzero(~space)
        first = np.cumsum(length) - length  # of each word among the inner bytes
        value = (data[inner].astype(np.uint64) + np.uint64(1)) * power[inner - np.repeat(starts, length)]
        hashes = mix(np.add.reduceat(value, first) + length.astype(np.uint64))
    before = np.where(length > 1, data[ends - 2], 0).astype(np.int64)
    return hashes, data[ends - 1].astype(np.int64) | before << 8, starts


def batch_words(texts: Collection[str | None], lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the words of ``texts`` in order: hash, ending, index of the text, and the texts that end in this piece.

    A text longer than a piece is cut at a space and goes on in the next one.
    """
    held: list[bytes] = []
    size, first = 0, 0

    def flush(upto: int) -> tuple[np.ndarray, ...]:
        raw = b"\n".join(held) + b"\n"
        hashes, endings, starts = word_hashes(raw)
        bounds = np.cumsum([len(x) + 1 for x in held])
        return hashes, endings, first + np.searchsorted(bounds, starts, side="right"), np.arange(first, upto)

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        raw = raw.lower() if lower else raw  # bytes.lower() changes ASCII letters only
        parts = list(_pieces(raw)) if len(raw) > PIECE_BYTES else [raw]
        for k, part in enumerate(parts):
            held.append(part)
            size += len(part) + 1
            last = k == len(parts) - 1
            if size >= PIECE_BYTES:
                yield flush(i + last)
                held, size, first = [], 0, i + last
    if held:
        yield flush(len(texts))
