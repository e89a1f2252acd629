"""Tag sequences → spans (gaps and islands) with exact source coordinates.

Transition rule (previous tag → current tag):
    B/I → B : close the open span, open a new one
    B/I → I : extend
    B/I → O : close
    O   → B : open
    O   → I : open (a lone I starts a span)
    O   → O : nothing
and a span still open at the end of the page is emitted.  So a span starts
exactly where ``bio = 'B'`` or (``bio = 'I'`` and the previous tag is O).

Only tagged (non-O) characters are needed: the previous tag is O exactly when
the previous tagged character of the same (page, attribute) is not at
``new_char_idx - 1``.  Decoding never looks at blocks or lines, so spans run
across both, as in the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PAGE
from ..functions.codepoints import code_points, codes, integers, joined_strings, string_parts, strings_of, within


KEYS = (*PAGE, "attribute")


def bio_transitions(tagged: DataFrame, keys=KEYS) -> DataFrame:
    """Sparse tags → the positions where something happens, with their flags.

    tagged: keys + new_char_idx, bio, n_kept (kept characters of the page).
    start: a span begins here; end: the span may end here (every tagged
    position); insert: the span before this position is closed here, that is the
    position after a tagged one unless it holds an I.  All three follow from the
    tagged characters, so O positions are never produced: the only ones that
    matter stand right after a run.
    """
    w = Window.partitionBy(*keys).orderBy("new_char_idx")
    t = tagged.where(F.col("bio").isin("B", "I"))
    prev, nxt = F.lag("new_char_idx").over(w), F.lead("new_char_idx").over(w)
    here = F.col("new_char_idx")
    t = t.withColumns({"_prev": prev, "_next": nxt})
    after_run = F.col("_prev").isNotNull() & (F.col("_prev") == here - 1)
    own = F.struct(here.alias("new_char_idx"), F.col("bio"),
                   (after_run & (F.col("bio") == "B")).alias("insert"),
                   ((F.col("bio") == "B") | ~after_run).alias("start"), F.lit(True).alias("end"))
    # The O position that closes a run, if the page goes on.
    gap = (F.col("_next").isNull() | (F.col("_next") != here + 1)) & (here + 1 < F.col("n_kept"))
    closing = F.when(gap, F.struct((here + 1).alias("new_char_idx"), F.lit("O").alias("bio"), F.lit(True).alias("insert"),
                                   F.lit(False).alias("start"), F.lit(False).alias("end")))
    return t.select(*keys, F.inline(F.array_compact(F.array(own, closing))))


FRAGMENT = ("start_idx", "n", "begins", "line_id", "offset", "text")
SPAN = ("start_idx", "end_idx", "start_line", "start_offset", "end_line", "end_offset", "text")


def decode_spans(tagged: DataFrame, keys=KEYS) -> DataFrame:
    """Sparse tagged characters → one row per span.

    tagged: keys + new_char_idx, bio ('B'/'I'), line_id, offset, ch.
    Output: keys + start_idx, end_idx, start_line, start_offset, end_line,
    end_offset (exclusive), text (the kept characters of the span, in order).

    Each task first joins neighbouring rows that continue one another into fragments
    (``fragments``), whatever the order of its rows; only these are exchanged, by
    (page, attribute), and sorted; one pass over them joins fragments into spans
    (``joined_spans``).  A task holds the fragments of one Arrow batch and one group.
    """
    t = tagged.where(F.col("bio").isin("B", "I")).select(*keys, "new_char_idx", "bio", "line_id", "offset", "ch")
    types = {f.name: f.dataType for f in t.schema.fields}
    types |= {"start_idx": types["new_char_idx"], "end_idx": types["new_char_idx"], "n": T.IntegerType(), "begins": T.BooleanType(), "text": T.StringType(),
              "start_line": types["line_id"], "end_line": types["line_id"], "start_offset": types["offset"], "end_offset": types["offset"]}
    schema = lambda *names: T.StructType([T.StructField(c, types[c]) for c in (*keys, *names)])
    n_keys = len(keys)
    parts = t.mapInArrow(lambda batches: (fragments(b, n_keys) for b in batches if b.num_rows), schema(*FRAGMENT))
    dealt = parts.repartition(*KEYS).sortWithinPartitions(*keys, "start_idx", "n", "begins", "line_id", "offset", "text")
    return dealt.mapInArrow(lambda batches: joined_spans(batches, n_keys), schema(*SPAN))


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before in one of the columns (nulls are equal)."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        one = codes(c)
        out[1:] |= one[1:] != one[:-1]
    out[:1] = True
    return out


def fragments(batch: pa.RecordBatch, n_keys: int) -> pa.RecordBatch:
    """Rows of the keys, new_char_idx, bio, line_id, offset and ch → fragments: runs of one line, each character
    but the first an I that stands, in the page and in its line, right after the one before."""
    order = np.argsort(codes(batch.column(KEYS.index("attribute"))), kind="stable")
    if (np.diff(order) != 1).any():
        batch = batch.take(pa.array(order))
    idx, line, offset = (integers(batch.column(n_keys + i), -1) for i in (0, 2, 3))
    begins = pc.equal(batch.column(n_keys + 1), "B").to_numpy(zero_copy_only=False).astype(bool)
    ch = batch.column(n_keys + 4)
    single = integers(pc.utf8_length(ch), 0) == 1
    new = _changes(batch.columns[:n_keys]) | begins | ~single
    new[1:] |= (idx[1:] != idx[:-1] + 1) | (line[1:] != line[:-1]) | (offset[1:] != offset[:-1] + 1) | ~single[:-1]
    first = np.flatnonzero(new)
    at, data = string_parts(ch)
    own = batch.take(pa.array(first))
    size = np.diff(np.append(first, len(new)))
    return pa.RecordBatch.from_arrays([*own.columns[:n_keys], own.column(n_keys), pa.array(size.astype(np.int32)), pa.array(begins[first]), own.column(n_keys + 2),
                                       own.column(n_keys + 3), joined_strings(np.append(at[first], at[-1]), data)], names=[*batch.schema.names[:n_keys], *FRAGMENT])


def joined_spans(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Fragments, sorted by the keys and the place → spans.  A group goes on until another key comes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.flatnonzero(_changes(batch.columns[:n_keys]))
        if held:
            edge = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            heads = heads if _changes(edge.columns[:n_keys])[1] else heads[1:]
        if len(heads) and (held or heads[-1]):
            yield _spans_of(pa.concat_batches([*held, batch.slice(0, int(heads[-1]))]), n_keys)
            held = []
        held.append(batch.slice(int(heads[-1])) if len(heads) else batch)
    if held:
        yield _spans_of(pa.concat_batches(held), n_keys)


def _spans_of(rows: pa.RecordBatch, n_keys: int) -> pa.RecordBatch:
    """Spans of whole groups of fragments."""
    head = _changes(rows.columns[:n_keys])
    idx, n = integers(rows.column(n_keys), -1), integers(rows.column(n_keys + 1), 1)
    laps = ~head[1:] & (idx[1:] < idx[:-1] + n[:-1])
    if laps.any():  # page keys that repeat: the fragments of such a group are dealt with character by character
        group = np.cumsum(head) - 1
        rows = _characters(rows, n_keys, np.isin(group, group[1:][laps]), group)
        head = _changes(rows.columns[:n_keys])
        idx, n = integers(rows.column(n_keys), -1), integers(rows.column(n_keys + 1), 1)
    starts = head | rows.column(n_keys + 2).to_numpy(zero_copy_only=False).astype(bool)
    starts[1:] |= idx[1:] != idx[:-1] + n[:-1]
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(starts)) - 1
    at, data = string_parts(rows.column(n_keys + 5))
    one, end = rows.take(pa.array(first)), rows.take(pa.array(last))
    shift = lambda column, by: pc.add(column, pa.array(n[last] - 1 + by, column.type))
    return pa.RecordBatch.from_arrays(
        [*one.columns[:n_keys], one.column(n_keys), shift(end.column(n_keys), 0), one.column(n_keys + 3), one.column(n_keys + 4), end.column(n_keys + 3),
         shift(end.column(n_keys + 4), 1), joined_strings(np.append(at[first], at[-1]), data)], names=[*rows.schema.names[:n_keys], *SPAN])


def _characters(rows: pa.RecordBatch, n_keys: int, spelled: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """The fragments, those to be spelled as one of a character each, by group and place."""
    n = integers(rows.column(n_keys + 1), 1)
    times = np.where(spelled, n, 1)
    of, nth = np.repeat(np.arange(len(n)), times), within(times)
    cps, start = code_points(rows.column(n_keys + 5))
    whole = times == 1
    ends = start[of] + nth
    text = strings_of(cps, np.append(ends, start[-1]))  # a fragment that stays whole ends where the next one starts
    idx = integers(rows.column(n_keys), -1)[of] + nth
    begins = rows.column(n_keys + 2).to_numpy(zero_copy_only=False).astype(bool)[of] & (nth == 0)
    order = np.lexsort((ends, ~begins, idx, group[of]))
    out = rows.take(pa.array(of[order]))
    move = lambda i: pc.add(out.column(i), pa.array(nth[order], out.column(i).type))
    return pa.RecordBatch.from_arrays([*out.columns[:n_keys], pa.array(idx[order], out.column(n_keys).type), pa.array(np.where(whole, n, 1)[of][order].astype(np.int32)), pa.array(begins[order]),
                                       out.column(n_keys + 3), move(n_keys + 4), text.take(pa.array(order))], names=rows.schema.names)


def span_records(spans: DataFrame) -> DataFrame:
    """Spans with their page's title (a decode key) → nested prediction records.

    Field order of text_offset is start, text, end.
    """
    return spans.select(
        *PAGE, "title", "attribute",
        F.struct(
            F.struct(F.col("start_line").alias("line_id"), F.col("start_offset").alias("offset")).alias("start"),
            F.col("text").alias("text"),
            F.struct(F.col("end_line").alias("line_id"), F.col("end_offset").alias("offset")).alias("end"),
        ).alias("text_offset"),
        "start_idx", "end_idx",
    )


def reassemble_page(block_scores: DataFrame) -> DataFrame:
    """Block predictions → per-character tags of each page.

    block_scores: category, page_id, block_id, attr_idx, first_idx (kept index of
    the block's first character) and two arrays over the model input, labels
    (-1 = special/padding) and pred (tag index).  Positions with label -1 are
    dropped; position ``i`` holds the character ``i - 1`` of its block (position 0
    is [CLS]), so its kept index is arithmetic and nothing is joined.
    """
    pos = block_scores.select(*PAGE, "block_id", "attr_idx", "first_idx", "pred", F.posexplode_outer("labels").alias("_pos", "_label"))
    return pos.where(F.col("_label") != -1).select(
        *PAGE, "block_id", "attr_idx", (F.col("_pos") - 1).cast("int").alias("block_idx"),
        (F.col("first_idx") + F.col("_pos") - 1).cast("bigint").alias("new_char_idx"), F.get("pred", F.col("_pos")).alias("pred"))
