"""Exact substring dedup with distributed difference-cover suffix arrays.

A byte is removed when a string of ``LENGTH`` bytes that covers it starts
somewhere else too.  Such strings are found by sorting suffixes and comparing
neighbours; the suffixes are sorted by the difference-cover algorithm (triples at
the sampled positions i mod 3 != 0, recursion on their names, merge with the rest).

To sort on many machines, suffixes that can share ``LENGTH`` bytes must meet.
Every window of ``LENGTH`` bytes has an anchor: the smallest hash of the
``ANCHOR``-byte strings in it.  Equal windows have equal anchors, so windows are
dealt out by anchor, as pieces: the bytes that a run of windows with one anchor
covers.  Anchors that occur once are dropped before any text moves, which leaves
about a tenth of it, and equal pieces are one row with a count, so thousands of
copies are sorted once.  Each task builds suffix arrays over the pieces of whole
anchors, about a megabyte at a time.  An anchor with very many different pieces is
not sorted in one task: the 128-bit hashes of its windows are counted instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import mix

LENGTH = 400
ANCHOR = 128
HEAVY_BYTES = 2 << 20
CHUNK_BYTES = 1 << 20
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15


# --- rolling hashes -------------------------------------------------------------

class _Rolling:
    """Hashes of all substrings of one width, for byte strings of up to ``most`` bytes."""

    def __init__(self, base: int, most: int):
        self.most = most
        self.power = np.cumprod(np.full(most, base, np.uint64), dtype=np.uint64)
        self.inverse = np.cumprod(np.full(most, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=total[1:])
        n = len(data) - width + 1
        return mix((total[width:] - total[:-width]) * self.inverse[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def anchors(raw: bytes, length: int, anchor: int, rolling: _Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first, end, hits) of the runs of windows with one anchor; long texts in segments.

    ``hits`` counts the places of the anchor that the run holds: windows of one run
    can be equal when there are two or more.  (It may be too low for an anchor of
    several runs, which counts twice anyway.)
    """
    data = np.frombuffer(raw, np.uint8)
    width = length - anchor + 1
    for at in range(0, len(data) - length + 1, SEGMENT):
        hashes = rolling(data[at:at + SEGMENT + length - 1], anchor)
        least = _sliding_min(hashes, width)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.concatenate([first[1:], [len(least)]])
        value = least[first]
        place = np.flatnonzero(hashes <= value.max())
        order = np.argsort(value)
        near = np.searchsorted(value[order], hashes[place])
        near[near == len(order)] = 0
        run = order[near]
        inside = (value[run] == hashes[place]) & (place >= first[run]) & (place < end[run] + width - 1)
        hits = np.maximum(1, np.bincount(run[inside], minlength=len(first)))
        yield value, at + first, at + end, hits


# --- difference cover -----------------------------------------------------------

_BITS = 21


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Triples as integers of the same order, for values below 2^21 or, by way of names for the pairs, 2^31."""
    if max(int(x.max(initial=0)) for x in (a, b, c)) < 1 << _BITS:
        return (a << 2 * _BITS) | (b << _BITS) | c
    _, pair = np.unique((a << 31) | b, return_inverse=True)
    return (pair.astype(np.int64) << 31) | c


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers below 2^31 by the difference cover modulo 3.

    Sorts the triples at positions i mod 3 != 0, recurses on their names until
    they are unique, sorts the other suffixes by (symbol, rank of the next) and
    merges: each of them goes after the sampled suffixes smaller than it, which
    are counted by searching its key among those of either residue.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    x = np.concatenate([t.astype(np.int64), np.zeros(6, np.int64)])
    extra = n % 3 == 1  # a sampled empty suffix keeps the two halves of the recursion apart
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    key = _packed(x[sampled], x[sampled + 1], x[sampled + 2])
    order = np.argsort(key)
    ordered = key[order]
    name = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    if name[-1] < len(sampled):
        names = np.empty(len(sampled), np.int64)
        names[order] = name
        order = suffix_array(names)
    by_rank = sampled[order]
    rank = np.zeros(n + 8, np.int64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]

    def pair(i: np.ndarray) -> np.ndarray:
        return (x[i] << 31) | rank[i + 1]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(pair(rest))]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    both = np.concatenate([twos, rest])  # packed together, so that their keys compare
    triples = _packed(x[both], x[both + 1], rank[both + 2])
    place = np.arange(len(rest)) + np.searchsorted(pair(ones), pair(rest)) + np.searchsorted(triples[:len(twos)], triples[len(twos):])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = by_rank
    return out


def _equal_neighbours(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of starts in suffix order: does the window of ``length`` bytes equal that of the next start?"""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    at = np.arange(len(starts) - 1)
    for lo, hi in ((0, 8), (length - 8, length), (length // 2, length // 2 + 8)):  # most pairs differ here
        at = at[(windows[starts[at], lo:hi] == windows[starts[at + 1], lo:hi]).all(axis=1)]
    same = np.zeros(len(starts), bool)
    for lo in range(0, len(at), 16_384):
        part = at[lo:lo + 16_384]
        same[part] = (windows[starts[part]] == windows[starts[part + 1]]).all(axis=1)
    return same


def repeated_starts(pieces: list[bytes], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Per piece: which of its window starts are found again, in it, in another piece, or as another copy."""
    sizes = np.array([len(p) for p in pieces])
    first = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\n".join(pieces), np.uint8)
    text = data.astype(np.int64) + 2
    text[(first[1:] - 1)] = 1
    start = np.zeros(len(data), bool)
    for a, n in zip(first.tolist(), sizes.tolist()):
        start[a:a + n - length + 1] = True
    order = suffix_array(text)
    order = order[start[order]]
    same = _equal_neighbours(data, order, length)
    again = np.zeros(len(data), bool)
    again[order[:-1][same[:-1]]] = True
    again[order[1:][same[:-1]]] = True
    return [np.ones(n - length + 1, bool) if c > 1 else again[a:a + n - length + 1] for a, n, c in zip(first.tolist(), sizes.tolist(), copies)]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# --- on Spark -------------------------------------------------------------------

TEXT_KEY = ("text_h1", "text_h2", "n_bytes")
PIECE_KEY = ("piece_h1", "piece_h2")


def _hash128(raw: str, names: tuple[str, ...]) -> tuple[Column, Column]:
    """Two hashes of other seeds: what has both is taken for one string."""
    return F.xxhash64(raw).alias(names[0]), F.xxhash64(F.lit(1), raw).alias(names[1])


def _keyed(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    return docs.select(*keep, raw.alias("raw")).select(*keep, *_hash128("raw", TEXT_KEY), F.octet_length("raw").cast("long").alias("n_bytes"), "raw")


def _find_anchors(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """texts(TEXT_KEY, raw, copies) → (anchor, TEXT_KEY, copies, first, end, hits) of every run of windows."""
    names = ["anchor", *TEXT_KEY, "copies", "first", "end", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling(_BASE, SEGMENT + length)
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in names]
            for *key, raw in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4)):
                for value, first, end, hits in anchors(raw.as_py(), length, anchor, rolling):
                    for column, x in zip(held, (value.view(np.int64), *[np.full(len(value), k) for k in key], first, end, hits)):
                        column.append(x)
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in held], names=names)

    return texts.select(*TEXT_KEY, "copies", "raw").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _sort_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """pieces(anchor, PIECE_KEY, piece, copies) → (PIECE_KEY, a, b): repeated starts a .. b-1 within a piece."""
    names = [*PIECE_KEY, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, int]] = []
        size = 0

        def sort(rows: list[tuple[int, int, int, bytes, int]]) -> pa.RecordBatch:
            found: list[list] = [[], [], [], []]
            for (_, h1, h2, _, _), flags in zip(rows, repeated_starts([r[3] for r in rows], [r[4] for r in rows], length)):
                a, b = _intervals(flags)
                for column, values in zip(found, ([h1] * len(a), [h2] * len(a), a.tolist(), b.tolist())):
                    column += values
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if size >= CHUNK_BYTES and row[0] != held[-1][0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield sort(held)

    dealt = pieces.select("anchor", *PIECE_KEY, "piece", "copies").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _repeated(texts: DataFrame, length: int, anchor: int, heavy_bytes: int) -> DataFrame:
    """texts(TEXT_KEY, raw, copies) → (TEXT_KEY, a, b): the intervals [a, b) of starts of repeated strings, each text once."""
    whole = anchor == length  # all windows of a run are one string then: its first one stands for them
    runs = _find_anchors(texts, length, anchor).groupBy("anchor", *TEXT_KEY, "first", "end", "hits").agg(F.sum("copies").alias("copies"))
    runs = materialize(runs, "suffix-anchors")
    twice = materialize(runs.groupBy("anchor").agg(F.sum(F.col("copies") * F.col("hits")).alias("n")).where("n > 1").select("anchor"), "suffix-twice")
    wanted = runs.join(twice, "anchor", "left_semi").groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("anchor", "first", "end", "copies")).alias("runs"))
    # Each text once; the runs of one text come to it.
    found = texts.groupBy(*TEXT_KEY).agg(F.first("raw").alias("raw")).join(wanted, list(TEXT_KEY))
    windows = F.col("r.end") - F.col("r.first")
    cut = found.select(*TEXT_KEY, "raw", F.explode_outer("runs").alias("r")).select(
        *TEXT_KEY, F.col("r.anchor").alias("anchor"), F.col("r.first").alias("first"), F.col("r.end").alias("end"),
        (F.col("r.copies") * (windows if whole else 1)).alias("copies"),
        F.expr(f"substring(raw, int(r.first) + 1, {length if whole else f'int(r.end - r.first) + {length - 1}'})").alias("piece"))
    placed = materialize(cut.select("*", *_hash128("piece", PIECE_KEY)), "suffix-pieces")

    # The bytes of a piece decide its anchor, so a piece is found again by its own key.
    pieces = placed.groupBy("anchor", *PIECE_KEY).agg(F.first("piece").alias("piece"), F.sum("copies").alias("copies"))
    pieces = materialize(pieces, "suffix-distinct")
    heavy = materialize(pieces.groupBy("anchor").agg(F.sum(F.octet_length("piece")).alias("n")).where(F.col("n") > heavy_bytes).select("anchor"), "suffix-heavy")
    if whole or heavy.isEmpty():
        marks = _sort_pieces(pieces, length)
    else:
        again = pieces.join(heavy, "anchor", "left_semi").select(
            *[F.col(p).alias(t) for p, t in zip(PIECE_KEY, TEXT_KEY)], F.octet_length("piece").cast("long").alias("n_bytes"), F.col("piece").alias("raw"), "copies")
        deeper = _repeated(again, length, anchor + (length - anchor + 1) // 2, heavy_bytes)
        marks = _sort_pieces(pieces.join(heavy, "anchor", "left_anti"), length).unionByName(
            deeper.select(*[F.col(t).alias(p) for p, t in zip(PIECE_KEY, TEXT_KEY)], "a", "b"))
    starts = placed.select(*PIECE_KEY, *TEXT_KEY, "first", "end").join(materialize(marks, "suffix-marks"), list(PIECE_KEY))
    return starts.select(*TEXT_KEY, (F.col("first") + F.col("a")).alias("a"), (F.col("end") if whole else F.col("first") + F.col("b")).alias("b"))


def repeated_intervals(docs: DataFrame, text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """(TEXT_KEY, starts): per text with repeats, the intervals [a, b) of starts of repeated strings."""
    keyed = _keyed(docs, text_col).where(F.col("n_bytes") >= length).withColumn("copies", F.lit(1).cast("long"))
    return _repeated(keyed, length, anchor, heavy_bytes).groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("a", "b")).alias("starts"))


def cut_out(raw: bytes, starts: list[tuple[int, int]] | None, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, bytes kept)."""
    removed = spans = at = 0
    kept = []
    for a, b in sorted(starts or ()):
        end = b - 1 + length
        if end <= at and spans:
            continue
        if a > at or not spans:
            kept.append(raw[at:a])
            spans += 1
            at = a
        removed += end - at
        at = end
    kept.append(raw[at:])
    return removed, spans, b"".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   heavy_bytes: int = HEAVY_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, ``keep``, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Every byte that a repeated string of ``length`` bytes covers is removed, in all
    places it occurs.  Strings do not cross documents.

    Defined results: a null text is empty; texts shorter than ``length`` keep all;
    repeated rows are documents of their own, so a text of ``length`` or more that
    occurs twice is removed everywhere; what is left need not be valid UTF-8; an
    empty table gives no rows; columns not named are ignored.
    """
    found = materialize(repeated_intervals(docs, text_col, length, anchor, heavy_bytes), "suffix-starts")
    keyed = _keyed(docs, text_col, id_col, *keep)
    joined = keyed.join(found, list(TEXT_KEY), "left").select(id_col, *keep, "n_bytes", "raw", "starts")
    fields = joined.schema[:-2]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_removed long, n_spans long, kept_sha256 string, kept binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            out: list[list] = [[], [], [], []]
            for raw, starts in zip(batch.column(n - 2), batch.column(n - 1).to_pylist()):
                removed, spans, kept = cut_out(raw.as_py(), starts and [(s["a"], s["b"]) for s in starts], length)
                for column, value in zip(out, (removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], names=[*batch.schema.names[:-2], "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, schema)
