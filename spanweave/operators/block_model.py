"""Batch scoring of blocks with a pluggable model: ids and mask → logits → tags → spans in one plan.

A scorer is any object with ``attributes`` (names, in the order of its heads) and a
call that takes a :class:`Batch` and returns logits (rows, positions, attributes, 3).
Blocks are dealt to it in padded batches inside Arrow tasks; predicted tags come back
as arrays beside the block's characters, so putting a page together again and
finding source coordinates needs no join and no row per untagged character.  The
only exchange is the one of the decode, on (page, attribute), of tagged characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PAGE, TextParams
from ..functions.codepoints import list_parts, single_characters, within
from . import spans
from .annotate import bio_from_index
from .blocks import block_arrays
from .cells import line_columns, page_pieces
from .chars import page_frame
from .examples import SpecialIds

N_TAGS = 3
O_TAG = 2
MAX_CHARS = 1 << 19


@dataclass(frozen=True)
class Batch:
    """Padded model input: ids [CLS] + code points (+ padding), mask (true on characters), the raw code point to the left of each character, and the rows' categories."""

    ids: np.ndarray
    mask: np.ndarray
    before: np.ndarray
    category: Sequence[str | None]


class Scorer(Protocol):
    attributes: Sequence[str]

    def __call__(self, batch: Batch) -> np.ndarray: ...


@dataclass(frozen=True)
class HeadScorer:
    """An encoder (batch → hidden vector per position) and per attribute Linear → ReLU → Linear; the weights' last column is the bias."""

    attributes: Sequence[str]
    encoder: Callable[[Batch], np.ndarray]
    w1: np.ndarray
    w2: np.ndarray

    def __call__(self, batch: Batch) -> np.ndarray:
        hidden = self.encoder(batch)
        flat = hidden.reshape(-1, hidden.shape[-1]).astype(np.float64)
        out = np.empty((len(flat), len(self.attributes), N_TAGS))
        for a in range(len(self.attributes)):
            inner = np.maximum(flat @ self.w1[a][:, :-1].T + self.w1[a][:, -1], 0.0)
            out[:, a] = inner @ self.w2[a][:, :-1].T + self.w2[a][:, -1]
        return out.reshape(*hidden.shape[:2], len(self.attributes), N_TAGS)


class CountScorer:
    """The count tagger as a scorer: the model's tag of (category, attribute, previous raw character, character) gets logit 1, O elsewhere.

    ``model``: its rows that are not O.  They are few (train pages are bounded per
    category); ``count_scorer`` counts them before they are collected.
    """

    def __init__(self, attributes: Sequence[str], categories: Sequence[str], keys: np.ndarray, tags: np.ndarray):
        self.attributes, self.categories, self.keys, self.tags = attributes, {c: i for i, c in enumerate(categories)}, keys, tags

    @staticmethod
    def key(category: np.ndarray, attribute: np.ndarray, before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """(category × attributes, previous character, character) in one number: 21 bits a code point."""
        return (category.astype(np.int64) * 64 + attribute) << 42 | before.astype(np.int64) << 21 | cp.astype(np.int64)

    def __call__(self, batch: Batch) -> np.ndarray:
        logits = np.zeros((*batch.ids.shape, len(self.attributes), N_TAGS))
        logits[..., O_TAG] = 0.5
        if not len(self.keys):
            return logits
        category = np.array([self.categories.get(c, -1) for c in batch.category])[:, None]
        for a in range(len(self.attributes)):
            key = self.key(category, np.int64(a), batch.before, batch.ids)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            row, col = np.nonzero((self.keys[at] == key) & batch.mask & (category >= 0))
            logits[row, col, a, self.tags[at[row, col]]] = 1.0
        return logits


def count_scorer(model: DataFrame, max_rows: int = 1_000_000) -> CountScorer:
    """A :class:`CountScorer` of a count model (``train_tagger_counts``) of at most ``max_rows`` rows that are not O."""
    rows = model.where(F.col("bio") != "O").select("category", "attribute", F.ascii("prev_ch").alias("before"), F.ascii("ch").alias("cp"), F.when(F.col("bio") == "B", 0).otherwise(1).alias("tag"))
    held = rows.limit(max_rows + 1).collect()
    if len(held) > max_rows:
        raise ValueError(f"the model has more than {max_rows} rows; score it with scoring.score_with_counts")
    attributes, categories = sorted({r.attribute for r in held}), sorted({r.category for r in held})
    if len(attributes) > 64:
        raise ValueError("more than 64 attributes; score it with scoring.score_with_counts")
    column = lambda f: np.array([f(r) for r in held], np.int64)
    keys = CountScorer.key(column(lambda r: categories.index(r.category)), column(lambda r: attributes.index(r.attribute)), column(lambda r: r.before), column(lambda r: r.cp))
    order = np.argsort(keys)
    return CountScorer(attributes, categories, keys[order], column(lambda r: r.tag)[order])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column, whatever slice of its buffers it is."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _pieces(rows: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole blocks with at most ``most`` characters each (a longer block by itself)."""
    ends = np.cumsum(np.diff(rows.column("_ids").offsets.to_numpy()))
    first = 0
    while first < rows.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield rows.slice(first, last - first)
        first = last


def score_blocks(blocks: DataFrame, scorer: Scorer, batch_size: int = 32, ids: SpecialIds = SpecialIds()) -> DataFrame:
    """``page_blocks`` rows (with places) + pred: per attribute the predicted tag (0 B, 1 I, 2 O) of each character.

    Blocks of a task are sorted by length and padded in batches of ``batch_size`` to
    the longest of each: [CLS] + code points + padding.  Ties go to the lower tag.
    An Arrow batch holds up to 10,000 blocks, so it is scored in pieces of at most
    ``MAX_CHARS`` characters: that bounds a worker's memory and what it sends back.
    The scorer travels as a broadcast, once to each executor.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(scorer)
    rows = blocks.withColumns({"_ids": F.transform("chars", lambda c: c["cp"]), "_before": F.transform("chars", lambda c: c["before"])})
    schema = T.StructType([*blocks.schema.fields, T.StructField("pred", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n_attr = len(model.attributes)
        for arrow in (piece for batch in batches for piece in _pieces(batch, MAX_CHARS)):
            cps, at = _lists(arrow.column("_ids"))
            before, _ = _lists(arrow.column("_before"))
            n = np.diff(at)
            tags = _block_tags(model, cps, before, at, arrow.column("category").to_pylist(), batch_size, ids)
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(n, n_attr))]), pa.int32()), pa.array(tags, pa.int32()))
            pred = pa.ListArray.from_arrays(pa.array(np.arange(arrow.num_rows + 1) * n_attr, pa.int32()), inner)
            kept = [arrow.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pred], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _block_tags(model: Scorer, cps: np.ndarray, before: np.ndarray, at: np.ndarray, category: Sequence[str | None], batch_size: int, ids: SpecialIds) -> np.ndarray:
    """Predicted tags of the blocks that start at ``at``: block after block, attribute after attribute."""
    n, n_attr = np.diff(at), len(model.attributes)
    tags = np.zeros(n_attr * len(cps), np.int32)
    for some in np.array_split(np.argsort(n, kind="stable"), range(batch_size, len(n), batch_size)):
        if not len(some):
            continue
        width = int(n[some].max()) + 1
        mask = np.arange(width) <= n[some][:, None]
        mask[:, 0] = False
        padded, left = np.full(mask.shape, ids.pad, np.int64), np.zeros(mask.shape, np.int64)
        padded[:, 0] = ids.cls
        source = (at[some][:, None] + np.arange(width) - 1)[mask]
        padded[mask], left[mask] = cps[source], before[source]
        best = model(Batch(padded, mask, left, [category[i] for i in some])).argmax(axis=3)
        row, col = np.nonzero(mask)
        for a in range(n_attr):
            tags[n_attr * at[some][row] + a * n[some][row] + col - 1] = best[row, col, a]
    return tags


def predicted_tags(scored: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Scored blocks put together again: the tagged characters with kept index and source place (input of ``decode_spans``)."""
    def of_attribute(tags, a):
        both = F.zip_with("chars", tags, lambda c, t: F.struct(c.alias("c"), t.alias("t")))
        placed = F.transform(both, lambda x, i: F.struct(a.alias("a"), i.alias("i"), x["t"].alias("tag"), x["c"]["line_id"].alias("line_id"),
                                                         x["c"]["offset"].alias("offset"), x["c"]["cp"].alias("cp")))
        return F.filter(placed, lambda x: x["tag"] != O_TAG)

    cells = scored.select(*PAGE, "first_idx", F.inline_outer(F.flatten(F.transform("pred", of_attribute)))).where(F.col("a").isNotNull())
    names = F.array(*[F.lit(a) for a in attributes])
    # The character by its code point: one UTF-32 unit.
    ch = F.decode(F.unhex(F.lpad(F.hex("cp"), 8, "0")), "UTF-32")
    return cells.select(*PAGE, F.get(names, F.col("a")).alias("attribute"), (F.col("first_idx") + F.col("i")).alias("new_char_idx"),
                        bio_from_index(F.col("tag")).alias("bio"), "line_id", "offset", ch.alias("ch"))


def tagged_chars(frame: DataFrame, p: TextParams, scorer: Scorer, batch_size: int = 32, ids: SpecialIds = SpecialIds()) -> DataFrame:
    """``predicted_tags`` of ``score_blocks`` of ``page_blocks`` in one Arrow pass over page frames.

    The steps are the same, on the arrays of about a million characters at a time; no
    row holds the places of a whole block's characters.
    """
    shared = frame.sparkSession.sparkContext.broadcast(scorer)
    rows = frame.select(*PAGE, *line_columns())
    types = {f.name: f.dataType for f in rows.schema.fields}
    types |= {"attribute": T.StringType(), "new_char_idx": T.LongType(), "bio": T.StringType(), "line_id": T.IntegerType(), "offset": T.IntegerType(), "ch": T.StringType()}
    names = [*PAGE, "attribute", "new_char_idx", "bio", "line_id", "offset", "ch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in page_pieces(batches):
            made = block_arrays(piece, p, places=True)
            at, chars = list_parts(made["chars"])
            if not len(chars):
                continue
            line, offset, cps, before = (chars.field(i).to_numpy() for i in range(4))
            n, n_attr = np.diff(at), len(model.attributes)
            tags = _block_tags(model, cps, before, at, made["category"].to_pylist(), batch_size, ids)
            block, i = np.repeat(np.arange(len(n)), n), within(n)
            first = made["first_idx"].to_numpy()
            for a, name in enumerate(model.attributes):
                tag = tags[n_attr * at[block] + a * n[block] + i]
                own = np.flatnonzero(tag != O_TAG)
                of = pa.array(block[own])
                yield pa.RecordBatch.from_arrays(
                    [*[made[c].take(of) for c in PAGE], pa.array([name], pa.string()).take(pa.array(np.zeros(len(own), np.int32))), pa.array(first[block[own]] + i[own]),
                     pa.array(["B", "I"]).take(pa.array(tag[own])), pa.array(line[own]), pa.array(offset[own]), single_characters(cps[own])], names=names)

    return rows.mapInArrow(run, T.StructType([T.StructField(c, types[c]) for c in names]))


def predict_spans(pages: DataFrame, p: TextParams, scorer: Scorer, batch_size: int = 32) -> DataFrame:
    """Pages → predicted spans with source coordinates: clean, block, score, reassemble, decode."""
    return spans.decode_spans(tagged_chars(page_frame(pages, p), p, scorer, batch_size))
