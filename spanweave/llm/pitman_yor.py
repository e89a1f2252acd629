"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one per context, where the context of a word is the whole word before
it (the end of a text stands before the first word of the next), and a root
restaurant that all contexts share as their parent; the root's parent is uniform
over the known words and one unknown.  Customers of a context are the training
tokens seen there; a table that a context opens for a word is a customer of the
root.  The seating is sampled by Gibbs: all customers of one word in one restaurant
leave and are seated again one after another, given everybody else.  Tables of the
contexts and root probabilities are averaged over the samples; the predictive
probability of w after u is (own + (strength + discount x tables of u) x root(w)) /
(strength + customers of u), own being customers less discount x tables of w at u.

Every token is the context of one other, so a word's count is also the number of
customers of its own restaurant, and a word seen once in a context has one table
there.  Only pairs seen twice or more ("active") are sampled; all totals are counts
less what the active pairs have seated at shared tables.

Words with at least 1/``frequent`` of the training tokens have numbers, of which
tasks hold arrays (at most ``frequent`` entries); the others are told apart by hash.
Pairs are dealt by word, those of frequent words by word and context, so that none
piles up.  A sweep exchanges the active pairs' totals: arrays of the frequent words,
rows of the rare contexts (each with a bounded number of pairs).

The logarithm of a probability is that of root(w), that of the context's backoff
weight, and a correction for pairs seen in training.  In a text every word is a
context once, so the first two are looked up by word, by the task itself if the
word is frequent; corrections of the most frequent pairs are too.  The rest is asked
of the buckets, in packed cells, and sums per document come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import batch_words, mix

END_HASH = np.uint64(0x5851F42D4C957F2D)
FLUSH_TOKENS = 400_000
HEAVY_SHARE = 1 << 22
HELD_ANSWERS = 1_000_000
SINGLE_STEPS = 64


@dataclass(frozen=True)
class Settings:
    """Discounts and strengths of the two levels, Gibbs sweeps, how many of the last ones are averaged, seed, share of a frequent word."""

    root_discount: float = 0.6
    root_strength: float = 10.0
    discount: float = 0.75
    strength: float = 50.0
    sweeps: int = 4
    averaged: int = 3
    seed: int = 0
    frequent: int = 1 << 21


# --- packing ------------------------------------------------------------------

_TYPES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on, in the narrowest width that holds them, byte planes apart and compressed."""
    out, planes = [np.array([len(arrays)], np.int64).tobytes()], []
    for a in arrays:
        top = int(a.max(initial=0))
        width = next(w for w in _TYPES if top < 1 << 8 * w)
        out.append(np.array([len(a), width], np.int64).tobytes())
        planes.append(np.ascontiguousarray(a.astype(_TYPES[width]).view(np.uint8).reshape(len(a), width).T).tobytes())
    raw = b"".join([*out, *planes])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(cell: bytes) -> list[np.ndarray]:
    """The arrays of :func:`_pack`, as unsigned 64-bit integers."""
    data = pa.decompress(cell[8:], int(np.frombuffer(cell, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + head.nbytes, []
    for length, width in head.tolist():
        planes = np.frombuffer(data, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_TYPES[width]).astype(np.uint64))
        at += length * width
    return out


def _ints(arrays: list[np.ndarray]) -> list[np.ndarray]:
    return [a.view(np.int64) for a in arrays]


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _sum_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Vocabulary:
    """The frequent words, most frequent first: a word's place is its number."""

    words: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for rare ones."""
        return _find(self.sorted, words, self.order)

    def code(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rare words, codes of the words and of their contexts) of tokens one after another, each the context of the next.

        A code is a frequent word's number, or len(self) + a rare word's place among them.
        """
        distinct, place = np.unique(np.concatenate([contexts[:1], words]), return_inverse=True)
        number = self.find(distinct)
        rare = number < 0
        code = np.where(rare, len(self) + np.cumsum(rare) - 1, number)[place]
        return distinct[rare], code[1:], code[:-1]


def _find(ordered: np.ndarray, values: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Places of values in an ordered array, -1 for those that are not there."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at if place is None else place[at], -1)


def _recode(code: np.ndarray, place: np.ndarray, known: int) -> np.ndarray:
    """Codes whose rare words have moved to other places (-1: nowhere)."""
    if not len(place):
        return code.astype(np.int64)
    moved = place[np.maximum(code - known, 0)]
    return np.where(code < known, code, np.where(moved < 0, -1, known + moved))


def _deal(known: int, rare: np.ndarray, bucket: np.ndarray, w: np.ndarray, ctx: np.ndarray, *planes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows sorted by (word, context) as one packed cell per bucket: its rare words, steps of the word codes, context codes, planes."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket, w, ctx, planes = bucket[order], w[order], ctx[order], [p[order] for p in planes]
    first = _runs(bucket)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), _cell(known, rare, w[a:b], ctx[a:b], *[p[a:b] for p in planes])


def _cell(known: int, rare: np.ndarray, w: np.ndarray, ctx: np.ndarray, *planes: np.ndarray) -> bytes:
    both = np.concatenate([w, ctx])
    used = np.unique(both[both >= known])
    w, ctx = (np.where(x < known, x, known + np.searchsorted(used, x)) for x in (w, ctx))
    return _pack(rare[used - known], np.diff(w, prepend=0), ctx, *planes)


def _open(cell: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rare words, [word codes, context codes, planes])."""
    rare, *rest = _unpack(cell)
    w, *rest = _ints(rest)
    return rare, [np.cumsum(w), *rest]


# --- tokens of a batch --------------------------------------------------------

class _Texts:
    """The texts of an Arrow column, one Python string at a time."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __iter__(self) -> Iterator[str | None]:
        return (x.as_py() for x in self.column)


def _tokens(texts: _Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, word before it, index of the text) of the tokens, ends included, in pieces."""
    before = END_HASH
    for words, _, doc, ended in batch_words(texts):
        # Ends go in after the last word of their text: sort positions (text, word number, end last).
        all_words = np.concatenate([words, np.full(len(ended), END_HASH)])
        all_docs = np.concatenate([doc, ended])
        order = np.argsort(all_docs, kind="stable")
        all_words, all_docs = all_words[order], all_docs[order]
        context = np.concatenate([[before], all_words])[:-1].astype(np.uint64)
        before = all_words[-1] if len(all_words) else before
        yield all_words, context, all_docs


# --- counting -----------------------------------------------------------------

def _flushed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, context) of the texts in the first column, some ``size`` tokens at a time."""
    held, n = [], 0
    for batch in batches:
        for words, context, _ in _tokens(_Texts(batch.column(0))):
            held.append((words, context))
            n += len(words)
            if n >= size:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _count_words(docs: DataFrame) -> DataFrame:
    """docs(text), training only → (word, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _flushed(batches, 4 * FLUSH_TOKENS):
            word, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pair_bucket(vocabulary: Vocabulary, rare: np.ndarray, w: np.ndarray, ctx: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of pairs: by the word if it is rare, else by the word and the context."""
    words = np.concatenate([vocabulary.words, rare])
    return _bucket(np.where(w < len(vocabulary), words[w] ^ mix(words + np.uint64(1))[ctx], words[w]), buckets)


def _count(docs: DataFrame, vocabulary, buckets: int) -> DataFrame:
    """docs(text), training only → (bucket, cell): packed counts of (word, context), per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(vocabulary.value)
        for words, contexts in _flushed(batches, FLUSH_TOKENS):
            rare, w, ctx = vocabulary.value.code(words, contexts)
            key, n = np.unique(w * (known + len(rare)) + ctx, return_counts=True)
            w, ctx = np.divmod(key, known + len(rare))
            yield from _rows(_deal(known, rare, _pair_bucket(vocabulary.value, rare, w, ctx, buckets), w, ctx, n))

    return docs.mapInArrow(run, "bucket int, cell binary")


def _rows(cells: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    keys, data, size = [], [], 0
    for key, cell in cells:
        keys.append(key)
        data.append(cell)
        size += len(cell)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "cell"])
            keys, data, size = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "cell"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Cells of one bucket after another, of rows sorted by bucket."""
    key, held = None, []
    for batch in batches:
        for k, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(cell.as_py())
    if held:
        yield key, held


_STATE = "bucket int, cell binary, sums binary, ctx array<long>, c array<long>, e array<long>"


def _state_row(bucket: int, cell: bytes, sums: bytes, rare: np.ndarray, c: np.ndarray, e: np.ndarray, **more: bytes) -> pa.RecordBatch:
    """A row of a sampler's state: besides the cell and the sums of the frequent words, excess and customers of rare contexts."""
    lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (rare, c, e)]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([cell], pa.binary()), pa.array([sums], pa.binary()), *lists,
                                       *[pa.array([x], pa.binary()) for x in more.values()]], names=["bucket", "cell", "sums", "ctx", "c", "e", *more])


def _dishes(cells: DataFrame, known: int, partitions: int) -> DataFrame:
    """Cells summed up per bucket: ``dishes`` holds all pairs and their counts, the other columns the state before the first sweep."""
    def merged(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [_open(c) for c in held]
        rare = np.unique(np.concatenate([r for r, _ in parts]))
        w, ctx = (np.concatenate([_recode(p[i], np.searchsorted(rare, r), known) for r, p in parts]) for i in (0, 1))
        key = w * (known + len(rare)) + ctx
        order = np.argsort(key, kind="stable")
        first = _runs(key[order])
        return rare, w[order][first], ctx[order][first], _sum_runs(np.concatenate([p[2] for _, p in parts])[order], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _grouped(batches):
            rare, w, ctx, n = merged(held)
            count = np.bincount(w[w >= known] - known, weights=n[w >= known], minlength=len(rare)).astype(np.int64)
            active = n > 1
            dishes = _cell(known, rare, w, ctx, n)
            w, ctx, n = w[active], ctx[active], n[active]
            # Rare words that are seen once have one table in the root, whatever happens.
            used = count > 1
            used[ctx[ctx >= known] - known] = True
            place = np.cumsum(used) - 1
            rare, count = rare[used], np.where(count > 1, count, 0)[used]
            w, ctx = _recode(w, place, known), _recode(ctx, place, known)
            t = np.ones(len(n), np.int64)
            state = _pack(rare, count, (count > 0).astype(np.int64), np.diff(w, prepend=0), ctx, n, t, np.zeros(len(n), np.int64))
            at, e = _excess(ctx, n - t, known)
            yield _state_row(bucket, state, _sums(known, w, ctx, n - t, np.minimum(count, 1)), rare[at], np.zeros(len(at), np.int64), e, dishes=dishes)

    return cells.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{_STATE}, dishes binary")


def _excess(ctx: np.ndarray, excess: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, excess) of the rare contexts: their active customers less their tables."""
    rare = ctx >= known
    at, by = np.unique(ctx[rare] - known, return_inverse=True)
    return at, np.bincount(by, weights=excess[rare], minlength=len(at)).astype(np.int64)


def _sums(known: int, w: np.ndarray, ctx: np.ndarray, excess: np.ndarray, root_t: np.ndarray) -> bytes:
    """Excess of the frequent contexts and words, and of all pairs; tables of the root for this cell's rare words, and their number."""
    out = []
    for code in (ctx, w):
        frequent = code < known
        at, by = np.unique(code[frequent], return_inverse=True)
        out += [at, np.bincount(by, weights=excess[frequent], minlength=len(at)).astype(np.int64)]
    return _pack(*out, np.array([excess.sum(), root_t.sum(), (root_t > 0).sum()]))


# --- seating ------------------------------------------------------------------

def seat(n: np.ndarray, discount: float, new_table: np.ndarray, per_table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables after ``n`` customers of one word have been seated one after another.

    With m seated at t tables, the next opens a table with weight new_table +
    per_table × t and joins one with weight m - discount × t.  The first 64 are
    seated singly, later ones in groups of 1/64 of those seated, so a word with
    very many customers takes a number of steps that grows with the logarithm.
    """
    order = np.argsort(-n, kind="stable")
    left, a, b = n[order], new_table[order], per_table[order]
    t = np.ones(len(n), np.int64)
    m, active = 1, int(np.searchsorted(-left, -1, side="left"))  # those with more than m
    while active:
        step = max(1, m // SINGLE_STEPS)
        weight = a[:active] + b[:active] * t[:active]
        p = weight / (m - discount * t[:active] + weight)
        t[:active] += rng.binomial(np.minimum(step, left[:active] - m), np.clip(p, 0.0, 1.0))
        m += step
        active = int(np.searchsorted(-left, -m, side="left"))
    out = np.empty_like(t)
    out[order] = np.minimum(t, left)
    return out


@dataclass
class Totals:
    """Customers and tables of the restaurants of frequent words, their own in the root, and the root's; ``known`` is the number of distinct words."""

    words: np.ndarray
    customers: np.ndarray  # per context
    tables: np.ndarray  # per context
    root_n: np.ndarray  # per word
    root_t: np.ndarray  # per word
    root_customers: float
    root_tables: float
    known: int
    tokens: int


def _root_probability(customers: np.ndarray, tables: np.ndarray, t: Totals, s: Settings) -> np.ndarray:
    uniform = 1.0 / (t.known + 1)
    return (customers - s.root_discount * tables + (s.root_strength + s.root_discount * t.root_tables) * uniform) / (s.root_strength + t.root_customers)


def _seat_root(n: np.ndarray, tables: np.ndarray, t: Totals, s: Settings, rng: np.random.Generator) -> np.ndarray:
    uniform = np.full(len(n), 1.0 / (t.known + 1))
    return seat(n, s.root_discount, (s.root_strength + s.root_discount * np.maximum(t.root_tables - tables, 0)) * uniform, s.root_discount * uniform, rng)


def _replies(rows: DataFrame, partitions: int) -> DataFrame:
    """rows(bucket, ctx, c, e) → (bucket, told): customers and excess of rare contexts, one row per bucket."""
    return rows.repartition(partitions, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("ctx", "c", "e")).alias("told"))


def _told(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The last column, of :func:`_replies`, packed row by row."""
    for row in batch.column(batch.num_columns - 1):
        told = row.values
        if told is None:
            yield _pack(*[np.zeros(0, np.uint64)] * 3)
        else:
            ctx, c, e = (x.to_numpy() for x in told.flatten())
            order = np.argsort(ctx.view(np.uint64))
            yield _pack(ctx.view(np.uint64)[order], c[order], e[order])


def _messages(state: DataFrame) -> DataFrame:
    """(bucket, ctx, c, e) of the rare contexts of every cell."""
    return state.select("bucket", F.explode(F.arrays_zip("ctx", "c", "e")).alias("m")).select("bucket", "m.ctx", "m.c", "m.e")


def _rare_totals(rare: np.ndarray, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(customers, excess, told) of rare words as contexts, out of the replies."""
    c, e, told = np.zeros(len(rare), np.int64), np.zeros(len(rare), np.int64), np.zeros(len(rare), bool)
    for cell in cells:
        ctx, cell_c, cell_e = _unpack(cell)
        at = _find(rare, ctx)
        here = at >= 0
        c[at[here]], e[at[here]], told[at[here]] = cell_c.view(np.int64)[here], cell_e.view(np.int64)[here], True
    return c, e, told


def _sweep(state: DataFrame, replies: DataFrame, totals: Totals, s: Settings, sweep: int) -> DataFrame:
    """One Gibbs sweep over every bucket: a state row each.

    A cell holds its rare words, their counts (0 if only contexts) and tables in the
    root, the active pairs' word and context codes, customers, tables and tables
    summed over the averaged samples, and per such sample customers and tables of the
    rare words in the root.
    """
    shared = state.sparkSession.sparkContext.broadcast(totals)
    keep = sweep >= s.sweeps - s.averaged

    def one(bucket: int, cell: bytes, told: list[bytes]) -> pa.RecordBatch:
        t = shared.value
        known = len(t.customers)
        rare, *rest = _unpack(cell)
        count, rare_t, w, ctx, n, tables, table_sum, *samples = _ints(rest)
        w = np.cumsum(w)
        rng = np.random.default_rng([s.seed, sweep, bucket])
        c, e, _ = _rare_totals(rare, told)
        context_tables = np.concatenate([t.tables, c - e])
        home = w >= known

        def rare_root(tables: np.ndarray) -> np.ndarray:
            return count - np.bincount(w[home] - known, weights=(n - tables)[home], minlength=len(rare)).astype(np.int64)

        root_n, root_t = np.concatenate([t.root_n, rare_root(tables)]), np.concatenate([t.root_t, rare_t])
        # Everybody but this word's customers of this context.
        others = np.maximum(root_n[w] - tables, 0)
        parent = _root_probability(others, np.minimum(root_t[w], others), t, s)
        new_tables = seat(n, s.discount, (s.strength + s.discount * np.maximum(context_tables[ctx] - tables, 0)) * parent, s.discount * parent, rng)
        rare_n = rare_root(new_tables)
        rare_t = np.where(count > 0, _seat_root(np.maximum(rare_n, 1), rare_t, t, s, rng), 0)
        if keep:
            table_sum = table_sum + new_tables
            samples += [rare_n, rare_t]
        at, own = _excess(ctx, n - new_tables, known)
        packed = _pack(rare, count, rare_t, np.diff(w, prepend=0), ctx, n, new_tables, table_sum, *samples)
        return _state_row(bucket, packed, _sums(known, w, ctx, n - new_tables, rare_t), rare[at], c[at], own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cell, told in zip(batch.column(0).to_pylist(), batch.column(1), _told(batch)):
                yield one(bucket, cell.as_py(), [told])

    return state.select("bucket", "cell").join(replies.hint("merge"), "bucket", "left").mapInArrow(run, _STATE)


def _totals(state: DataFrame, before: Totals, s: Settings, sweep: int, rare_once: int | None = None) -> tuple[Totals, int]:
    """Totals after a sweep and the number of rare words that are seen once, from sums per task (at most 2 x ``frequent`` rows).

    The frequent words are seated in the root here, by their new customers.
    """
    known = len(before.customers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rest = np.zeros(2 * known, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for data in batch.column(0):
                u, u_e, w, w_e, more = _ints(_unpack(data.as_py()))
                sums[u] += u_e
                sums[known + w] += w_e
                rest += more
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2, -3]])), pa.array(np.concatenate([sums[at], rest]))], names=["at", "n"])

    rows = state.select("sums").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    sums, rest = np.zeros(2 * known, np.int64), {-1: 0, -2: 0, -3: 0} | dict(zip(at[at < 0].tolist(), n[at < 0].tolist()))
    sums[at[at >= 0]] = n[at >= 0]
    if rare_once is None:
        rare_once = before.known - known - rest[-3]
    root_n = before.customers - sums[known:]
    root_t = _seat_root(root_n, before.root_t, before, s, np.random.default_rng([s.seed, sweep + 1])) if sweep >= 0 else np.minimum(root_n, 1)
    return Totals(before.words, before.customers, before.customers - sums[:known], root_n, root_t, float(before.tokens - rest[-1]),
                  float(root_t.sum() + rest[-2] + rare_once), before.known, before.tokens), rare_once


@dataclass
class Model:
    """The sampled model: packed cells per bucket and the totals of the averaged samples."""

    cells: DataFrame
    state: DataFrame
    buckets: int
    partitions: int
    vocabulary: Vocabulary
    totals: Totals
    samples: list[Totals]
    settings: Settings


def fit(texts: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Model:
    """Count the training texts and sample the seating; the model stays on Spark, in the shared folder."""
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    docs = texts.select(F.col(text_col).alias("text"))
    words = materialize(_count_words(docs), "hpy-words")
    known, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = words.where(F.col("n") >= max(1, -(-tokens // settings.frequent))).orderBy(F.col("n").desc(), "word").toArrow()
    vocabulary = Vocabulary(frequent.column(0).to_numpy().astype(np.int64).view(np.uint64), frequent.column(1).to_numpy().astype(np.int64))
    n = vocabulary.counts
    first = materialize(_dishes(_count(docs, spark.sparkContext.broadcast(vocabulary), buckets), len(n), partitions), "hpy-dishes")
    totals = Totals(vocabulary.words, n, n, n, np.minimum(n, 1), float(tokens), float(known), int(known), int(tokens))
    totals, rare_once = _totals(first, totals, settings, -1)
    counts = words.select(F.col("word").alias("ctx"), F.col("n").alias("c"))
    messages = _messages(first).drop("c").join(counts.hint("merge"), "ctx")
    state, samples = first, []
    for sweep in range(settings.sweeps):
        asked = messages.select("bucket", "ctx", "c", F.sum("e").over(Window.partitionBy("ctx")).alias("e"))
        state = materialize(_sweep(state, _replies(asked, partitions), totals, settings, sweep), "hpy-state")
        messages = _messages(state)
        totals, _ = _totals(state, totals, settings, sweep, rare_once)
        if sweep >= settings.sweeps - settings.averaged:
            samples.append(totals)
    cells = _model_cells(first, state, counts, len(n), len(samples), buckets, partitions)
    return Model(cells, state.select("bucket", "cell"), buckets, partitions, vocabulary, totals, samples, settings)


def _model_cells(first: DataFrame, state: DataFrame, counts: DataFrame, known: int, samples: int, buckets: int, partitions: int) -> DataFrame:
    """(bucket, cell): the pairs, the state after the last sweep, and customers and summed excess of the rare contexts, told apart by their tag."""
    def tag(column: str, value: int) -> Column:
        return F.concat(F.lit(bytes([value])), F.col(column)).alias("cell")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                rare, (_, ctx, _) = _open(cell.as_py())
                used = rare[np.unique(ctx[ctx >= known] - known)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), bucket, np.int32)), pa.array(used)], names=["bucket", "ctx"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rare, *rest = _unpack(cell.as_py())
                _, _, _, ctx, n, _, table_sum, *_ = _ints(rest)
                at, e = _excess(ctx, samples * n - table_sum, known)
                yield pa.RecordBatch.from_arrays([pa.array(rare[at].view(np.int64)), pa.array(e)], names=["ctx", "e"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _bucket(batch.column(0).to_numpy().view(np.uint64), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "ctx", "c", "e"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), _told(batch)):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([cell], pa.binary())], names=["bucket", "cell"])

    excess = state.select("cell").mapInArrow(summed, "ctx long, e long").groupBy("ctx").agg(F.sum("e").alias("e"))
    # A context is told to the buckets that have pairs of it and, if it has an excess, to the bucket of its own word.
    asked = first.select("bucket", "dishes").mapInArrow(contexts, "bucket int, ctx long").join(counts.hint("merge"), "ctx").join(excess.hint("merge"), "ctx", "left")
    own = excess.join(counts.hint("merge"), "ctx").select("ctx", "c", "e").mapInArrow(home, "bucket int, ctx long, c long, e long")
    told = _replies(asked.select("bucket", "ctx", "c", F.coalesce("e", F.lit(0)).alias("e")).unionByName(own), partitions).mapInArrow(packed, "bucket int, cell binary")
    return first.select("bucket", tag("dishes", 0)).unionByName(state.select("bucket", tag("cell", 1))).unionByName(told.select("bucket", tag("cell", 2)))


class _Predictor:
    """Averaged predictive probabilities of the words of one or more buckets; words and contexts go by code."""

    def __init__(self, cells: list[bytes], totals: Totals, samples: list[Totals], s: Settings):
        self.totals, self.s, known = totals, s, len(totals.customers)
        parts: list[list[bytes]] = [[], [], []]
        for cell in cells:
            parts[cell[0]].append(cell[1:])
        dishes, n_samples = [_open(c) for c in parts[0]], max(1, len(samples))
        self.rare = rare = np.unique(np.concatenate([np.zeros(0, np.uint64), *[r for r, _ in dishes]]))
        self.words = np.concatenate([totals.words, rare])
        self.width = len(self.words)

        def keys(words: np.ndarray, w: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = _find(rare, words)
            w = _recode(w, place, known)
            return w, w * self.width + _recode(ctx, place, known)

        count = np.zeros(self.width, np.int64)
        count[:known] = totals.customers
        key, own = [np.zeros(0, np.int64)], [np.zeros(0)]
        for words, (w, ctx, n) in dishes:
            w, k = keys(words, w, ctx)
            count[known:] += np.bincount(w[w >= known] - known, weights=n[w >= known], minlength=len(rare)).astype(np.int64)
            key.append(k)
            own.append(n - s.discount)  # a word seen once has one table
        self.key, own = np.concatenate(key), np.concatenate(own)
        order = np.argsort(self.key, kind="stable")
        self.key, own = self.key[order], own[order]
        self.count = np.append(count, 0)

        # Root probabilities; the last is that of a word never seen.
        once = np.minimum(self.count, 1)
        root = [(once.copy(), once.copy()) for _ in samples]
        for (n, t), sample in zip(root, samples):
            n[:known], t[:known] = sample.root_n, sample.root_t
        for cell in parts[1]:
            words, *rest = _unpack(cell)
            times, _, w, ctx, n, _, table_sum, *sampled = _ints(rest)
            at = np.searchsorted(self.key, keys(words, np.cumsum(w), ctx)[1])
            own[at] = n - s.discount * table_sum / n_samples
            home = known + _find(rare, words)
            for i, (root_n, root_t) in enumerate(root):
                root_n[home[times > 0]], root_t[home[times > 0]] = sampled[2 * i][times > 0], sampled[2 * i + 1][times > 0]
        self.root = np.zeros(self.width + 1)
        for (n, t), sample in zip(root, samples):
            self.root += _root_probability(n, t, sample, s) / n_samples

        # Contexts; the last is one never seen.
        c, e, told = _rare_totals(rare, parts[2])
        c = np.where(told, c, count[known:])
        tables = np.concatenate([sum((x.tables for x in samples), np.zeros(known)) / n_samples, c - e / n_samples, [0.0]])
        customers = np.concatenate([totals.customers, c, [0]])
        weight = s.strength + s.discount * tables
        self.backoff = np.log10(weight / (s.strength + customers))
        self.correction = np.log10(1.0 + own / (weight[self.key % max(1, self.width)] * self.root[self.key // max(1, self.width)]))
        self.value = np.log10(self.root) + self.backoff
        self.base = np.log10((self.count + 0.5) / (totals.tokens + 0.5 * (totals.known + 1)))

    def code(self, rare: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Codes given with other rare words, as codes of this predictor; -1 for words that are not here."""
        return _recode(codes, _find(self.rare, rare), len(self.totals.customers))

    def corrections(self, w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        at = _find(self.key, w * self.width + ctx)
        seen = (w >= 0) & (ctx >= 0) & (ctx < self.width) & (at >= 0)
        return np.where(seen, self.correction[at], 0.0) if len(self.key) else np.zeros(len(w))

    def __call__(self, row: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 base probability, known) of words by code, -1 for unseen ones."""
        ctx = np.where((context >= 0) & (context < self.width), context, -1)
        return np.log10(self.root[row]) + self.backoff[ctx] + self.corrections(row, ctx), self.base[row], self.count[row] > 0


@dataclass
class Frequent:
    """What every task answers itself: logarithms and base of the frequent words, corrections of the most frequent pairs."""

    vocabulary: Vocabulary
    value: np.ndarray
    base: np.ndarray
    key: np.ndarray
    correction: np.ndarray


def _frequent(model: Model) -> Frequent:
    """Pairs with at least 1/HEAVY_SHARE of all training tokens, at most HEAVY_SHARE, are put together here."""
    known, least = len(model.vocabulary), max(2, -(-model.totals.tokens // HEAVY_SHARE))
    s, samples = model.settings, max(1, len(model.samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(1):
                _, *rest = _unpack(cell.as_py())
                _, _, w, ctx, n, _, table_sum, *_ = _ints(rest)
                w = np.cumsum(w)
                heavy = (n >= least) & (w < known) & (ctx < known)
                yield pa.RecordBatch.from_arrays([pa.array(w[heavy] * known + ctx[heavy]), pa.array(n[heavy] - s.discount * table_sum[heavy] / samples)], names=["key", "own"])

    pairs = model.state.mapInArrow(run, "key long, own double").toArrow()
    key, own = pairs.column(0).to_numpy(), pairs.column(1).to_numpy()
    order = np.argsort(key)
    words = _Predictor([], model.totals, model.samples, s)
    key, own = key[order], own[order]
    weight = 10 ** words.backoff * (s.strength + np.append(model.totals.customers, 0))
    correction = np.log10(1.0 + own / (weight[key % max(1, known)] * words.root[key // max(1, known)]))
    return Frequent(model.vocabulary, words.value[:known], words.base[:known], key, correction)


# --- scoring ------------------------------------------------------------------

def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` + n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each whole text.

    Defined results: a null or empty text is one token, its end; without training
    texts every word is unknown; an empty table gives no rows; repeated rows are
    scored each; columns not named are ignored.
    """
    spark = docs.sparkSession
    settings, totals, samples, buckets = model.settings, model.totals, model.samples, model.buckets
    shared = spark.sparkContext.broadcast((_frequent(model), totals, samples))
    fields, tokens = docs.select(*keep).schema, totals.tokens

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (target, block, kind, data): kind 0 asks a bucket, kind 1 holds a block's own documents and sums."""
        frequent, _, _ = shared.value
        known = len(frequent.vocabulary)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = _Texts(batch.column(batch.num_columns - 1))
            own = {k: np.zeros(len(texts)) for k in ("n_tokens", "n_known", "base", "score")}
            held, size = [], 0
            for words, contexts, doc in _tokens(texts):
                if not len(words):
                    continue
                rare, w, ctx = frequent.vocabulary.code(words, contexts)
                mine = w < known
                number, of = w[mine], doc[mine]
                pair = _find(frequent.key, np.where(mine & (ctx < known), w * known + ctx, -1))
                for name, at, values in (("n_tokens", doc, None), ("n_known", of, None), ("base", of, frequent.base[number]), ("score", of, frequent.value[number]),
                                         ("score", doc[pair >= 0], frequent.correction[pair[pair >= 0]])):
                    own[name] += np.bincount(at, weights=values, minlength=len(texts))
                held.append((rare, w[pair < 0], ctx[pair < 0], doc[pair < 0]))
                size += int((pair < 0).sum())
                if size >= FLUSH_TOKENS:
                    yield from asked(block, held)
                    held, size = [], 0
            if size:
                yield from asked(block, held)
            sink = pa.BufferOutputStream()
            part = pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(v) for v in own.values()]], names=[*batch.schema.names[:-1], *own])
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield _asked([block % buckets], [block], [1], [sink.getvalue().to_pybytes()])
            block += 1

    def asked(block: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[0].vocabulary
        known = len(vocabulary)
        rare = np.unique(np.concatenate([r for r, _, _, _ in held]))
        w, ctx = (np.concatenate([_recode(h[i], np.searchsorted(rare, h[0]), known) for h in held]) for i in (1, 2))
        doc = np.concatenate([h[3] for h in held])
        least = int(doc.min())
        base = int(doc.max()) + 1 - least
        # (word, context, document) in one number: codes < 2^22, documents of a batch < 2^19.
        key, n = np.unique((w * (known + len(rare)) + ctx) * base + doc - least, return_counts=True)
        key, doc = np.divmod(key, base)
        w, ctx = np.divmod(key, known + len(rare))
        bucket = _pair_bucket(vocabulary, rare, w, ctx, buckets)
        rows: list[list] = [[], [], [], []]
        for b, cell in _deal(known, rare, bucket, w, ctx, doc + least, n):
            for column, value in zip(rows, (b, block, 0, cell)):
                column.append(value)
        for at in range(0, len(rows[0]), 64):
            yield _asked(*[c[at:at + 64] for c in rows])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (target, kind): kind -1 is the bucket's part of the model, then come the questions."""
        _, totals, samples = shared.value
        known = len(totals.customers)
        target, cells, predict = None, [], None
        sums: dict[int, list[np.ndarray]] = {}
        size = 0

        def told() -> pa.RecordBatch:
            rows = []
            for block, (at, *values) in sums.items():
                rows.append((0, block, 0, _pack(at, values[0].astype(np.int64), *[v.view(np.uint64) for v in values[1:]])))
            return _asked(*[list(c) for c in zip(*rows)])

        for batch in batches:
            passed: list[list] = [[], [], [], []]
            for t, block, kind, data in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if t != target:
                    target, cells, predict = t, [], None
                if kind == -1:
                    cells.append(data.as_py())
                elif kind == 1:
                    for column, value in zip(passed, (t, block, kind, data.as_py())):
                        column.append(value)
                else:
                    predict = predict or _Predictor(cells, totals, samples, settings)
                    rare, (w, ctx, doc, n) = _open(data.as_py())
                    row, ctx, asked_here = predict.code(rare, w), predict.code(rare, ctx), w >= known
                    value = predict.corrections(row, ctx) + np.where(asked_here, predict.value[row], 0.0)
                    at, by = np.unique(doc, return_inverse=True)
                    values = [np.bincount(by, weights=x * n, minlength=len(at))
                              for x in (asked_here & (predict.count[row] > 0), np.where(asked_here, predict.base[row], 0.0), value)]
                    if block in sums:  # another bucket of this task has answered the block before
                        before = sums[block]
                        size -= len(before[0])
                        at, by = np.unique(np.concatenate([before[0], at]), return_inverse=True)
                        values = [np.bincount(by, weights=np.concatenate(x), minlength=len(at)) for x in zip(before[1:], values)]
                    sums[block] = [at, *values]
                    size += len(at)
                    if size >= HELD_ANSWERS:
                        yield told()
                        sums, size = {}, 0
            if passed[0]:
                yield _asked(*passed)
        if sums:
            yield told()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, kind descending): a block's documents, then the answers."""
        names = ("n_known", "base", "score")
        now = sums = None

        def done() -> pa.RecordBatch:
            n = len(keep)
            return pa.RecordBatch.from_arrays(
                [*now.columns[:n], pa.array(now.column(n).to_numpy().astype(np.int64)), pa.array(sums["n_known"].astype(np.int64)),
                 pa.array(np.full(now.num_rows, tokens, np.int64)), pa.array(sums["base"]), pa.array(sums["score"])],
                names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(3)):
                if kind == 1:
                    if now is not None:
                        yield done()
                    now = pa.ipc.open_stream(data.as_py()).read_next_batch()
                    sums = {k: now.column(now.schema.get_field_index(k)).to_numpy().copy() for k in names}
                else:
                    at, known, base, s = _unpack(data.as_py())
                    at = at.view(np.int64)
                    sums["n_known"][at] += known
                    sums["base"][at] += base.view(np.float64)
                    sums["score"][at] += s.view(np.float64)
        if now is not None:
            yield done()

    packed = "target int, block long, kind int, data binary"
    questions = docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(ask, packed)
    model_rows = model.cells.select(F.col("bucket").alias("target"), F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("kind"), F.col("cell").alias("data"))
    answers = questions.unionByName(model_rows).repartition(model.partitions, "target").sortWithinPartitions("target", "kind").mapInArrow(answer, packed)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return answers.repartition(model.partitions, "block").sortWithinPartitions("block", F.col("kind").desc()).mapInArrow(total, schema)


def _asked(target: list[int], block: list[int], kind: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())],
                                      names=["target", "block", "kind", "data"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Learn from the documents that are not held out and score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is held out when crc32(id as text) mod 5 is 1; a null id is not.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col).alias("_t"))
    model = fit(rows.where(~F.col("held_out")), settings, "_t")
    return score(rows, model, (id_col, "held_out"), "_t")
