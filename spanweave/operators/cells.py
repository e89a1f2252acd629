"""Lines and spans of some pages as arrays (numpy): kept characters, the cells of spans, and the last one of each character.

Rows come in Arrow batches and are worked on in pieces of a bounded number of
characters and cells, so that a task's memory does not follow the size of its
input.  The rules are those of ``annotate.expand_spans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TextParams
from ..functions.codepoints import SPACE, code_points, integers, list_parts, slices, within

PIECE_CHARS = 1 << 20  # characters of the lines that are held at once
PIECE_CELLS = 1 << 20  # cells of spans that are held at once
LOWEST = np.iinfo(np.int64).min


def line_columns() -> list[Column]:
    """What :class:`Lines` reads of a page frame: the lines' texts and two of their fields, as lists."""
    return [F.col(f"lines.{c}").alias(name) for c, name in (("line", "lines"), ("in_body", "in_body"), ("kept_base", "kept_base"))]


def page_pieces(batches: Iterator[pa.RecordBatch], texts: str = "lines") -> Iterator[pa.RecordBatch]:
    """Batches cut into whole pages of about ``PIECE_CHARS`` bytes of text."""
    for batch in batches:
        if batch.num_rows:
            column = batch.column(texts)
            at, lines = list_parts(column)
            bytes_before = np.concatenate([[0], np.cumsum(integers(pc.binary_length(lines), 0))])
            for first, last in slices(np.diff(bytes_before[at]), PIECE_CHARS):
                yield batch.slice(first, last - first)


class Lines:
    """The lines of a piece (``line_columns``)."""

    def __init__(self, piece: pa.RecordBatch, p: TextParams):
        self.first, lines = list_parts(piece.column("lines"))
        size = np.diff(self.first)
        self.row, self.no = np.repeat(np.arange(len(size)), size), within(size)
        self.cps, self.start = code_points(lines)
        self.length = np.diff(self.start)
        self.base = integers(list_parts(piece.column("kept_base"))[1], 0)
        self.in_body = list_parts(piece.column("in_body"))[1].to_numpy(zero_copy_only=False).astype(bool)
        self.kept = ~SPACE[self.cps]
        self.before = np.concatenate([[0], np.cumsum(self.kept)])  # kept characters before each
        self.p = p

    def rank(self, at: np.ndarray, line: np.ndarray) -> np.ndarray:
        return self.before[at] - self.before[self.start[line]]

    def kept_body(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, lines) of the characters that the page's text keeps."""
        at = np.flatnonzero(self.kept & np.repeat(self.in_body, self.length))
        line = np.searchsorted(self.start, at, side="right") - 1 if len(at) else at
        if self.p.mode == "line":
            own = self.rank(at, line) < self.p.capacity
            at, line = at[own], line[own]
        return at, line


class Spans:
    """The spans of a piece (column spans: a list of structs per page)."""

    def __init__(self, piece: pa.RecordBatch):
        self.first, s = list_parts(piece.column("spans"))
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.values = s
        names = [f.name for f in s.type]
        self.field = lambda name: s.field(names.index(name))
        # As least and greatest, which pass over nulls; a span without offsets covers nothing.
        self.sl, self.el = integers(self.field("sl"), -1), integers(self.field("el"), np.iinfo(np.int32).max)
        self.so, self.eo = integers(self.field("so"), 0), integers(self.field("eo"), 0)
        self.some = (self.so < self.eo) & self.field("so").is_valid().to_numpy(zero_copy_only=False) & self.field("eo").is_valid().to_numpy(zero_copy_only=False)
        seq = self.field("anno_seq")
        self.no_seq = ~seq.is_valid().to_numpy(zero_copy_only=False)
        self.seq = integers(seq, 0)


def kept_cells(lines: Lines, spans: Spans, use: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, line, span, w) of the cells on kept characters, all those of a line together; w = annotation ordinal × 2 + (1 for I)."""
    n_lines = np.diff(lines.first)[spans.row]
    lo, hi = np.maximum(spans.sl, 0), np.minimum(spans.el, n_lines - 1)
    some = spans.some if use is None else spans.some & use
    count = np.where(some & (lo <= hi), hi - lo + 1, 0)
    span = np.repeat(np.arange(len(count)), count)
    line = lines.first[spans.row[span]] + lo[span] + within(count)
    a, b = np.maximum(spans.so[span], 0), np.minimum(spans.eo[span], lines.length[line])
    covers = np.flatnonzero((a < b) & lines.in_body[line])
    covers = covers[np.argsort(line[covers], kind="stable")]
    span, line, a, b = span[covers], line[covers], a[covers], b[covers]
    # Cut between lines only.
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    ends = np.append(heads, len(line))
    size = np.add.reduceat(b - a, heads) if len(heads) else np.zeros(0, np.int64)
    for i, j in slices(size, PIECE_CELLS):
        some = slice(ends[i], ends[j])
        n = b[some] - a[some]
        at = np.repeat(lines.start[line[some]] + a[some], n) + within(n)
        own = np.flatnonzero(lines.kept[at])
        at, of = at[own], np.repeat(np.arange(ends[i], ends[j]), n)[own]
        x, s = line[of], span[of]
        if lines.p.mode == "line":
            own = lines.rank(at, x) < lines.p.capacity
            at, x, s = at[own], x[own], s[own]
        begins = (lines.no[x] == spans.sl[s]) & (at - lines.start[x] == spans.so[s])
        w = np.where(spans.no_seq[s], LOWEST, spans.seq[s] * 2 + ~begins)
        yield at, x, s, w


def last_of(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one index per distinct key, in the order of the keys, and the largest w of each)."""
    if not len(key):
        return np.zeros(0, np.int64), w
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
    return order[first], np.maximum.reduceat(w[order], first)
