"""Phrase collocations with weighted acyclic automata.

1. Every task cuts its texts into shards of some megabytes per language, encodes
   the words of a shard by a dictionary and writes both once.
2. Dictionaries are dealt out by word, sorted and summed up.  Words below the least
   count cannot be part of a candidate; the others are numbered by the running sum
   of their counts in that order, so a number tells the share of the corpus before it.
3. Each shard sorts its n-grams and builds a count automaton from them, state layer
   by state layer: an arc has a word as label and the number of occurrences of the
   path up to it as weight.  First for pairs of frequent words; then, over chains
   of frequent pairs only, for phrases of three words on.
4. An automaton is cut into prefix ranges, the same in every shard and of about
   equal mass (a hot first word is cut again by its next words), and the parts of
   one range are united: equal paths get one state, weights are summed.
5. A candidate's left parts are the weights on its own path; its right parts are
   looked up in the united automata, joined by path.

A range holds at most some millions of arcs whatever the corpus' size, since their
number follows the counted words; nothing is broadcast but a row per language, and
that only after a count.

Defined results: a null text has no words, a null language is ``und``; repeated
rows count each; empty tables give no rows; a piece, however long, is never cut;
equal scores go by count, then by the phrase's UTF-8 bytes; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .packing import pack, unpack

SHARD_BYTES = 8 << 20
RANGE_TOKENS = 1 << 20
BROADCAST_LANGS = 10_000
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND[list(_BREAKS)] = _BREAK


@dataclass(frozen=True)
class Settings:
    """Longest phrase, least count, percentage of a longer candidate's count that absorbs a shorter one, rows per language, scale of the score."""

    longest: int = 5
    least: int = 100
    absorb_percent: int = 100
    top: int = 2_000
    scale: int = 1_000


# --- shards -------------------------------------------------------------------

def encode_words(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """(stream, words): the words of ``raw`` in order as numbers from 1 into ``words``, with a 0 before each piece."""
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    inner = kind == _WORD
    edge = np.diff(inner.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inner])])
    coded = column.dictionary_encode()
    piece = np.cumsum(kind == _BREAK)[starts]
    first = np.diff(piece, prepend=-1) != 0
    stream = np.zeros(len(starts) + int(first.sum()), np.int64)
    stream[np.arange(len(starts)) + np.cumsum(first)] = coded.indices.to_numpy() + 1
    return stream, coded.dictionary


def _cut(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about SHARD_BYTES, cut at the end of a piece."""
    at = 0
    while len(text) - at > SHARD_BYTES:
        breaks = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, offset=at + SHARD_BYTES)] == _BREAK)
        if not len(breaks):
            break
        end = at + SHARD_BYTES + int(breaks[0])
        yield text[at:end]
        at = end
    yield text[at:]


def _shards(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(shard, lang, n_words, stream, words, counts): the words of some megabytes of one language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        shard = TaskContext.get().partitionId() << 32

        def written(lang: str) -> pa.RecordBatch:
            stream, words = encode_words(b"\n".join(held.pop(lang)))
            del size[lang]
            counts = np.bincount(stream, minlength=len(words) + 1)[1:]
            ends = pa.array([0, len(words)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([lang]), pa.array([int(counts.sum())]), pa.array([pack(stream)], pa.binary()),
                 pa.ListArray.from_arrays(ends, words.cast(pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
                names=["shard", "lang", "n_words", "stream", "words", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in _cut((text.as_py() or "").encode().lower()):  # bytes.lower() changes ASCII letters only
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= SHARD_BYTES:
                        yield written(lang)
                        shard += 1
                if sum(size.values()) >= 4 * SHARD_BYTES:  # many languages with a little each
                    for other in list(held):
                        yield written(other)
                        shard += 1
        for lang in list(held):
            yield written(lang)
            shard += 1

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "shard long, lang string, n_words long, stream binary, words array<string>, counts array<long>")


# --- automata -----------------------------------------------------------------

def _runs(*keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal rows of sorted key columns."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


@dataclass
class CountAutomaton:
    """Acyclic automaton over word numbers, layer by layer.

    Layer k holds the arcs from the states of depth k, sorted by (state, label):
    the state they leave (the index of an arc of the layer before), the label and
    the weight.  An arc is also the state it leads to.
    """

    states: list[np.ndarray]
    labels: list[np.ndarray]
    weights: list[np.ndarray]

    @classmethod
    def of_windows(cls, stream: np.ndarray, linked: np.ndarray, base: int, shortest: int, longest: int) -> CountAutomaton:
        """From the windows of ``stream`` (numbers below ``base``) whose neighbours are all linked; paths shorter than ``shortest`` get weight 0.

        ``linked[i]`` says whether positions i and i + 1 may be neighbours.
        """
        # Positions where a window of the shortest length starts, then those that go on.
        start = np.arange(len(stream) - shortest + 1) if len(stream) >= shortest else np.zeros(0, np.int64)
        for k in range(shortest - 1):
            start = start[linked[start + k]]
        state = np.zeros(len(start), np.int64)
        states, labels, weights = [], [], []
        for depth in range(longest):
            if depth >= shortest:
                goes_on = np.flatnonzero(linked[np.minimum(start + depth - 1, len(linked) - 1)] & (start + depth < len(stream)))
                start, state = start[goes_on], state[goes_on]
            key, state, n = np.unique(state * base + stream[start + depth], return_inverse=True, return_counts=True)
            states.append(key // base)
            labels.append(key % base)
            weights.append(n if depth + 1 >= shortest else np.zeros(len(n), np.int64))
        return cls(states, labels, weights)

    @property
    def depth(self) -> int:
        return len(self.labels)

    def part(self, layer: int, lo: int, hi: int) -> CountAutomaton:
        """The paths through the arcs ``lo`` to ``hi`` of one layer."""
        bounds = {layer: (lo, hi)}
        for k in range(layer, 0, -1):
            a, b = bounds[k]
            bounds[k - 1] = (int(self.states[k][a]), int(self.states[k][b - 1]) + 1)
        for k in range(layer + 1, self.depth):
            a, b = bounds[k - 1]
            bounds[k] = (int(np.searchsorted(self.states[k], a)), int(np.searchsorted(self.states[k], b)))
        cut = lambda arrays: [x[slice(*bounds[k])] for k, x in enumerate(arrays)]
        states = [s - (bounds[k - 1][0] if k else 0) for k, s in enumerate(cut(self.states))]
        return CountAutomaton(states, cut(self.labels), cut(self.weights))

    @classmethod
    def union(cls, parts: list[CountAutomaton], shortest: int) -> tuple[CountAutomaton, list[list[np.ndarray]]]:
        """One automaton with the paths of all, weights summed (paths below ``shortest`` keep theirs), and where each part's arcs went, by layer."""
        states, labels, weights = [], [], []
        went: list[list[np.ndarray]] = [[] for _ in parts]
        for k in range(parts[0].depth):
            state = np.concatenate([went[i][k - 1][p.states[k]] if k else p.states[k] for i, p in enumerate(parts)])
            label, weight = np.concatenate([p.labels[k] for p in parts]), np.concatenate([p.weights[k] for p in parts])
            order = np.lexsort((label, state))
            state, label, weight = state[order], label[order], weight[order]
            first = _runs(state, label)
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            for i, own in enumerate(np.split(place, np.cumsum([len(p.labels[k]) for p in parts])[:-1])):
                went[i].append(own)
            states.append(state[first])
            labels.append(label[first])
            weights.append((np.add if k + 1 >= shortest else np.maximum).reduceat(weight, first) if len(first) else weight)
        return cls(states, labels, weights), went

    def paths(self, layer: int, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, weights) of the paths that end in ``arcs`` of a layer, one row each."""
        labels, weights = [], []
        for k in range(layer, -1, -1):
            labels.append(self.labels[k][arcs])
            weights.append(self.weights[k][arcs])
            arcs = self.states[k][arcs]
        return np.stack(labels[::-1], axis=1), np.stack(weights[::-1], axis=1)

    def pack(self) -> bytes:
        return pack(*self.states, *self.labels, *self.weights)

    @classmethod
    def unpack(cls, data: bytes) -> CountAutomaton:
        a = unpack(data)
        n = len(a) // 3
        return cls(a[:n], a[n:2 * n], a[2 * n:])


def _position(numbers: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """Where paths (columns of word numbers, with their counts) lie in the sorted corpus, from 0 to 1, as if words were independent."""
    at = np.zeros(len(numbers))
    for k in range(numbers.shape[1] - 1, -1, -1):
        at = (numbers[:, k] + counts[:, k] * at) / total
    return at


def _ranges(automaton: CountAutomaton, layer: int, number: np.ndarray, count: np.ndarray, total: int, ranges: int) -> Iterator[tuple[int, CountAutomaton]]:
    """``automaton`` cut at one layer into prefix ranges; its labels index ``number`` and ``count`` and leave as numbers."""
    if not len(automaton.labels[layer]):
        return
    labels, _ = automaton.paths(layer, np.arange(len(automaton.labels[layer])))
    bucket = np.minimum((_position(number[labels], count[labels], total) * ranges).astype(np.int64), ranges - 1)
    first = _runs(bucket)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        part = automaton.part(layer, lo, hi)
        part.labels = [number[x] for x in part.labels]
        yield int(bucket[lo]), part


# --- words --------------------------------------------------------------------

def _vocabulary(shards: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, shard words): (lang, word, count, number) of the frequent words, and (shard, at, number, count) arrays of each shard's.

    The dictionaries are dealt out by word and sorted; a task sums up its words in
    order and answers with one row per shard, not per word and shard.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_range = TaskContext.get().partitionId()
        sofar, rest, held, size = 0, None, [], 0

        def answered() -> Iterator[pa.RecordBatch]:
            shard, at, numbers, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(shard, kind="stable")
            first = _runs(shard[order])
            ends = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (at, numbers, counts)]
            yield _vocabulary_batch(at_range, shard[order][first], [None] * len(first), [None] * len(first), lists)

        for batch in _with_end(batches):
            rows = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)])
            # The last word may go on in the next batch.
            rows = rows.combine_chunks()
            lang, word = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], pa.string()) for c in ("lang", "word"))
            new = np.ones(rows.num_rows, bool)
            if rows.num_rows > 1:
                new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(word[1:], word[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            whole = rows.num_rows if not batch.num_rows else int(first[-1])
            rest, first = rows.slice(whole), first[first < whole]
            if not whole:
                continue
            n = rows.column("n").to_numpy()[:whole]
            totals = np.add.reduceat(n, first)
            frequent = totals >= least
            numbers = sofar + np.cumsum(np.where(frequent, totals, 0)) - np.where(frequent, totals, 0)
            sofar += int(totals[frequent].sum())
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, whole)))
            mine = frequent[of]
            if not mine.any():
                continue
            held.append((rows.column("shard").to_numpy()[:whole][mine], rows.column("at").to_numpy()[:whole][mine].astype(np.int64), numbers[of][mine], totals[of][mine]))
            size += int(mine.sum())
            some = pa.array(first[frequent])
            singles = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1), pa.int32()), pa.array(x[frequent])) for x in (np.zeros_like(totals), numbers, totals)]
            yield _vocabulary_batch(at_range, np.full(len(some), -1), lang.take(some), word.take(some), singles)
            if size >= RANGE_TOKENS:
                yield from answered()
                held, size = [], 0
        if held:
            yield from answered()

    cells = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    cells = cells.select("shard", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "lang", "word").sortWithinPartitions("lang", "word")
    answers = materialize(dealt.mapInArrow(number, "of int, shard long, lang string, word string, at array<long>, number array<long>, count array<long>"), "phrase-numbers")
    words = answers.where("shard = -1").select("of", "lang", "word", F.get("count", F.lit(0)).alias("count"), F.get("number", F.lit(0)).alias("number"))
    # What the tasks before have counted; one row per task.
    sums = words.groupBy("of").agg(F.sum("count").alias("s"))
    before = F.broadcast(sums.select("of", F.coalesce(F.sum("s").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    words = materialize(words.join(before, "of").select("lang", "word", "count", (F.col("number") + F.col("before")).alias("number")), "phrase-words")
    own = answers.where("shard >= 0").join(before, "of").select("shard", "at", F.transform("number", lambda x: x + F.col("before")).alias("number"), "count")
    return words, materialize(own.groupBy("shard").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("at", "number", "count")]), "phrase-shard-words")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, and an empty one after the last."""
    last = None
    for last in batches:
        if last.num_rows:
            yield last
    if last is not None:
        yield last.slice(0, 0)


def _vocabulary_batch(of: int, shard: np.ndarray, lang, word, lists: list[pa.Array]) -> pa.RecordBatch:
    text = lambda x: x if isinstance(x, pa.Array) else pa.array(x, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(shard), of), pa.int32()), pa.array(shard, pa.int64()), text(lang), text(word), *lists],
                                      names=["of", "shard", "lang", "word", "at", "number", "count"])


def _longs(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(stream: np.ndarray, at: np.ndarray, number: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream of ranks from 1, 0 for rare words and breaks; number and count by rank)."""
    order = np.argsort(number)
    rank = np.zeros(int(max(stream.max(initial=0), at.max(initial=0) + 1)) + 1, np.int64)
    rank[at[order] + 1] = np.arange(1, len(at) + 1)
    pad = np.zeros(1, np.int64)
    return rank[stream], np.concatenate([pad, number[order]]), np.concatenate([pad, count[order]])


_PART = "bucket long, shard long, part binary"


def _part_rows(shard: int, parts: Iterator[tuple[int, CountAutomaton]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    size = 0
    for bucket, part in parts:
        held.append((bucket, part.pack()))
        size += len(held[-1][1])
        if size > 4 << 20:
            yield _part_batch(shard, held)
            held, size = [], 0
    if held:
        yield _part_batch(shard, held)


def _part_batch(shard: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([shard] * len(held), pa.int64()), pa.array([d for _, d in held], pa.binary())],
                                      names=["bucket", "shard", "part"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[CountAutomaton]]]:
    """(shards, parts) of one range after another, of rows sorted by range."""
    now, shards, parts = None, [], []
    for batch in batches:
        for bucket, shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != now and parts:
                yield shards, parts
                shards, parts = [], []
            now = bucket
            shards.append(shard)
            parts.append(CountAutomaton.unpack(data.as_py()))
    if parts:
        yield shards, parts


def _gathered(parts: DataFrame) -> DataFrame:
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "bucket").sortWithinPartitions("bucket")


# --- pairs --------------------------------------------------------------------

def _pairs(numbered: DataFrame, total: int, least: int) -> DataFrame:
    """(shard, first, second, n): arrays of each shard's frequent pairs; shard -1 has all of a range once."""
    ranges = -(-total // RANGE_TOKENS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column(0).to_pylist()):
                stream, number, n = _numbered(unpack(batch.column(1)[i].as_py())[0], *[_longs(batch.column(k)[i]) for k in (2, 3, 4)])
                linked = (stream[:-1] > 0) & (stream[1:] > 0)
                pairs = CountAutomaton.of_windows(stream, linked, len(number), 2, 2)
                yield from _part_rows(shard, _ranges(pairs, 1, number, n, total, ranges))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, parts in _by_bucket(batches):
            united, went = CountAutomaton.union(parts, 2)
            frequent = united.weights[1] >= least
            if not frequent.any():
                continue
            rows = [(-1, np.flatnonzero(frequent))]
            rows += [(shard, own[1][frequent[own[1]]]) for shard, own in zip(shards, went)]
            rows = [(shard, arcs) for shard, arcs in rows if len(arcs)]
            paths = [united.paths(1, arcs)[0] for _, arcs in rows]
            lists = lambda arrays: pa.array([list(a) for a in arrays], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), lists([p[:, 0] for p in paths]), lists([p[:, 1] for p in paths]),
                                              lists([united.weights[1][arcs] for _, arcs in rows])], names=["shard", "first", "second", "n"])

    return _gathered(numbered.mapInArrow(count, _PART)).mapInArrow(unite, "shard long, first array<long>, second array<long>, n array<long>")


# --- longer phrases -----------------------------------------------------------

def _longer(numbered: DataFrame, total: int, pair_total: int, s: Settings) -> DataFrame:
    """(path, lefts, n): the frequent phrases of three words on, with the counts of their left parts of three words on.

    ``numbered`` has each shard's frequent pairs in (first, second) besides.
    """
    ranges = -(-pair_total // RANGE_TOKENS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column(0).to_pylist()):
                at, number, n, first, second = (_longs(batch.column(k)[i]) for k in range(2, 7))
                stream, number, n = _numbered(unpack(batch.column(1)[i].as_py())[0], at, number, n)
                base = len(number)
                pairs = np.sort(np.searchsorted(number[1:], first) * base + np.searchsorted(number[1:], second)) + base + 1
                key = stream[:-1] * base + stream[1:]
                found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                phrases = CountAutomaton.of_windows(stream, pairs[found] == key, base, 3, s.longest)
                yield from _part_rows(shard, _ranges(phrases, 2, number, n, total, ranges))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_bucket(batches):
            united, _ = CountAutomaton.union(parts, 3)
            for layer in range(2, united.depth):
                arcs = np.flatnonzero(united.weights[layer] >= s.least)
                if len(arcs):
                    labels, weights = united.paths(layer, arcs)
                    rows = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int64()), x.shape[1]).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows(labels), rows(weights[:, 2:-1]) if layer > 2 else pa.array([[]] * len(arcs), pa.list_(pa.int64())),
                                                      pa.array(weights[:, -1], pa.int64())], names=["path", "lefts", "n"])

    return _gathered(numbered.mapInArrow(count, _PART)).mapInArrow(unite, "path array<long>, lefts array<long>, n long")


# --- phrases ------------------------------------------------------------------

def _frequent_phrases(shards: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(words, paths): the frequent words, and (path, lefts, n) of all frequent phrases from single words on."""
    words, held = _vocabulary(shards, s.least)
    total = words.agg(F.sum("count")).first()[0] or 0
    single = words.select(F.array("number").alias("path"), F.array().cast("array<long>").alias("lefts"), F.col("count").alias("n"))
    if not total or s.longest < 2:
        return words, single
    numbered = shards.select("shard", "stream").join(held.hint("merge"), "shard").select("shard", "stream", "at", "number", "count")
    pairs = materialize(_pairs(numbered, total, s.least), "phrase-pairs")
    flat = pairs.where("shard = -1").select(F.explode(F.arrays_zip("first", "second", "n")).alias("p"))
    found = single.unionByName(flat.select(F.array("p.first", "p.second").alias("path"), F.array().cast("array<long>").alias("lefts"), F.col("p.n").alias("n")))
    pair_total = flat.agg(F.sum("p.n")).first()[0] or 0
    if not pair_total or s.longest < 3:
        return words, found
    own = pairs.where("shard >= 0").groupBy("shard").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("first", "second")])
    longer = _longer(numbered.join(own.hint("merge"), "shard"), total, pair_total, s)
    return words, materialize(found.unionByName(longer), "phrase-paths")


def _part_counts(paths: DataFrame, longest: int) -> DataFrame:
    """(path, n, cuts): candidates with (k, l, r) of every cut; l from the path where it has it, else looked up like r."""
    candidates = paths.where(F.size("path") >= 2)
    cut = candidates.select("path", "n", "lefts", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    right = F.expr("slice(path, k + 1, size(path) - k)")
    asked = cut.select("path", "n", "k", F.when(F.col("k") >= 3, F.expr("get(lefts, k - 3)")).alias("l"), F.col("k").alias("of"), right.alias("part"))
    shorter = cut.where("k < 3").select("path", "n", "k", F.lit(None).cast("long").alias("l"), F.lit(0).alias("of"), F.expr("slice(path, 1, k)").alias("part"))
    counts = paths.select(F.col("path").alias("part"), F.col("n").alias("found"))
    answered = asked.unionByName(shorter).join(counts.hint("merge"), "part")
    sides = answered.groupBy("path", "n", "k").agg(F.max(F.when(F.col("of") == 0, F.col("found")).otherwise(F.col("l"))).alias("l"),
                                                   F.max(F.when(F.col("of") > 0, F.col("found"))).alias("r"))
    return sides


def cut_score(cuts: DataFrame, scale: int) -> DataFrame:
    """``cuts`` (n, size, l, r) + score, the floor of scale × n × size / (l × r), in 38-digit decimals."""
    product = F.expr(f"CAST({scale} AS DECIMAL(5,0)) * CAST(n AS DECIMAL(15,0)) * CAST(size AS DECIMAL(16,0))")
    return cuts.withColumn("_anz", product).withColumn("_lr", F.expr("CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))")).withColumn("score", F.expr("_anz div _lr")).drop("_anz", "_lr")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases (see the module's text)."""
    s = settings
    shards = materialize(_shards(docs, lang_col, text_col), "phrase-shards")
    words, paths = _frequent_phrases(shards, s)
    sizes = materialize(shards.groupBy("lang").agg(F.sum("n_words").alias("size")), "phrase-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes.hint("merge")

    # Candidates whose words lie in a longer one that is (nearly) as frequent go.
    longer = paths.where(F.size("path") >= 3).select("path", "n")
    inner = longer.select("n", F.explode(F.expr("filter(flatten(transform(sequence(2, size(path) - 1), w -> transform(sequence(1, size(path) - w + 1), i -> slice(path, i, w)))), x -> size(x) > 1)")).alias("path"))
    absorbed = inner.groupBy("path").agg(F.max("n").alias("most"))
    kept = paths.where(F.size("path") >= 2).join(absorbed.hint("merge"), "path", "left").where(F.expr(f"most IS NULL OR 100 * most < {s.absorb_percent} * n")).select("path")

    # Words and language of a path, then the score of every cut.
    spelled = kept.select("path", F.posexplode("path").alias("at", "number")).join(words.select("number", "lang", "word").hint("merge"), "number")
    spelled = spelled.groupBy("path").agg(F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    scored = _part_counts(paths, s.longest).join(spelled.hint("merge"), "path").join(sizes, "lang")
    scored = cut_score(scored, s.scale)
    least = F.min_by(F.struct("score", "l", "r", "k"), F.struct("score", "k")).alias("c")
    best = scored.groupBy("lang", "phrase", F.col("n").alias("a"), "size").agg(least)

    # The first rows of each language in two steps, so that a large language is not ranked by one task.
    order = [F.col("c.score").desc(), F.col("a").desc(), F.col("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(n))).withColumn("_rank", first).where(F.col("_rank") <= s.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= s.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"),
                         F.col("size").alias("n"), F.col("c.score").cast("long").alias("score"))


def mine_sql(s: Settings = Settings()) -> str:
    """DuckDB statement of :func:`mine` over the table documents."""
    leads = ", ".join(f"lead(w, {k}) OVER p AS w{k}" for k in range(1, s.longest))
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, {' || chr(32) || '.join(['w', *[f'w{k}' for k in range(1, m)]])} AS g FROM runs" + (f" WHERE w{m - 1} IS NOT NULL" if m > 1 else "")
                              for m in range(1, s.longest + 1))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS d FROM documents),
pieces AS (SELECT lang, d, generate_subscripts(x, 1) AS j, unnest(x) AS p FROM (SELECT lang, d, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS x FROM texts)),
words AS (SELECT lang, d, j, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT lang, d, j, regexp_extract_all(p, '[^\\x20\\x09]+') AS x FROM pieces)),
runs AS (SELECT lang, w, {leads} FROM words WINDOW p AS (PARTITION BY d, j ORDER BY i)),
grams AS ({grams}),
f AS MATERIALIZED (SELECT lang, m, g, count(*) AS c FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE m >= 2 AND c >= {s.least}),
split AS (SELECT *, string_split(g, ' ') AS x FROM cand),
inner_parts AS (SELECT lang, array_to_string(x[i:i + v - 1], ' ') AS g, c FROM split, unnest(range(2, m)) a(v), unnest(range(1, m - v + 2)) b(i)),
absorbed AS (SELECT lang, g, max(c) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM split c LEFT JOIN absorbed a ON c.lang = a.lang AND c.g = a.g WHERE a.most IS NULL OR 100 * a.most < {s.absorb_percent} * c.c),
cuts AS (SELECT lang, m, g, c, k, array_to_string(x[1:k], ' ') AS lg, array_to_string(x[k + 1:m], ' ') AS rg FROM kept, unnest(range(1, m)) t(k)),
lefts AS MATERIALIZED (SELECT x.*, l.c AS l FROM cuts x JOIN f l ON x.lang = l.lang AND x.lg = l.g),
sides AS MATERIALIZED (SELECT x.*, r.c AS r FROM lefts x JOIN f r ON x.lang = r.lang AND x.rg = r.g),
scored AS (SELECT lang, g, k, c AS a, l, r, n, ({s.scale}::HUGEINT * c * n) // (l::HUGEINT * r) AS score FROM sides JOIN sizes USING (lang)),
best AS (SELECT lang, g AS phrase, a, l, r, n, score::BIGINT AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {s.top}"""
