"""Gold spans → per-character B/I/O tags.

A span covers lines ``sl..el`` and, on EVERY one of those lines, offsets
``so..eo-1``; its first cell is B, every other cell I.

Plan shape: the annotations of a page become one array (small), which meets the
page frame in one join on the page; everything after that happens inside the
page row.  Spans are clipped to the lines that exist, grouped by line, and a
line is split once however many spans it holds.  All cells of a character stand
in the row of its page, so overlaps are resolved there and labels need no
exchange: ``label_chars`` works on the code points of many pages at once, in
Arrow tasks (``cells``).  The decode moves the tagged runs, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PAGE, TextParams
from ..functions.arrays import prefix_sum
from ..functions.codepoints import NO_CHAR, codes, single_characters
from ..functions.text import is_whitespace_cp, kept_count, let
from .cells import Lines, Spans, kept_cells, last_of, line_columns, page_pieces

CHUNK = 64  # characters of a line that are counted together


def span_bounds(annotations: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Flatten text_offset to sl, so, el, eo and the span's text."""
    return annotations.select(
        *PAGE, "attribute", "anno_seq", *extra,
        F.col("text_offset.start.line_id").alias("sl"),
        F.col("text_offset.start.offset").alias("so"),
        F.col("text_offset.end.line_id").alias("el"),
        F.col("text_offset.end.offset").alias("eo"),
        F.col("text_offset.text").alias("text"),
    )


def attribute_index(annotations: DataFrame) -> DataFrame:
    """Sorted distinct attributes of each category → attr_idx 0..n-1.

    The distinct runs as a partial + final aggregate, and the rank is per
    category, over the names of its annotation schema.
    """
    names = annotations.select("category", "attribute").where(F.col("attribute").isNotNull()).distinct()
    return names.select(
        "category", "attribute",
        (F.row_number().over(Window.partitionBy("category").orderBy("attribute")) - 1).cast("int").alias("attr_idx"),
    )


def annotated_pages(annotations: DataFrame) -> DataFrame:
    return annotations.select(*PAGE).distinct()


def page_annotations(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Annotations with the state of their page: found, empty, or missing.

    pages: page rows with their text, or ``list_pages`` rows with the files' lengths
    (n_bytes), which also know empty files.  A left join from the annotated pages, so
    that a page without a file (or with an empty one) is reported instead of dropping
    out unseen.
    """
    size = F.col("n_bytes") if "n_bytes" in pages.columns else F.length("text")
    state = pages.groupBy(*PAGE).agg(F.max(size).alias("_n"))
    j = annotations.join(state, PAGE, "left")
    return j.withColumn("page_state", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 0, "empty")
                        .otherwise("found")).drop("_n")


def page_spans(annotations: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per annotated page: its spans as an array (the annotations of one page)."""
    b = span_bounds(annotations, extra)
    return b.groupBy(*PAGE).agg(
        F.collect_list(F.struct("attribute", "anno_seq", "sl", "so", "el", "eo", *extra)).alias("spans"))


def _by_line(spans: Column, n_lines: Column) -> Column:
    """Array of (line_id, spans on it): spans clipped to the page, sorted, cut into runs of one line."""
    none = F.array().cast("array<int>")

    def covered(s: Column) -> Column:
        lo, hi = F.greatest(s["sl"], F.lit(0)), F.least(s["el"], n_lines - 1)
        lines = F.when((s["so"] < s["eo"]) & (lo <= hi), F.sequence(lo, hi)).otherwise(none)
        return F.transform(lines, lambda line: F.struct(line.alias("line_id"), s.alias("span")))

    def runs(cells: Column) -> Column:
        first = F.filter(
            F.when(F.size(cells) > 0, F.sequence(F.lit(0), F.size(cells) - 1)).otherwise(none),
            lambda i: (i == 0) | (F.get(cells, i)["line_id"] != F.get(cells, i - 1)["line_id"]))
        return let(first, lambda starts: F.transform(starts, lambda at, r: F.struct(
            F.get(cells, at)["line_id"].alias("line_id"),
            F.transform(F.slice(cells, at + 1, F.coalesce(F.get(starts, r + 1), F.size(cells)) - at), lambda c: c["span"]).alias("spans"))))

    return let(F.sort_array(F.flatten(F.transform(spans, covered))), runs)


def _on_lines(spans: Column, n_lines: Column, lines: Column) -> Column:
    """Array of (line, spans on it): a line goes with its own spans, so that no generated row carries the whole page."""
    return let(lines, lambda ls: F.transform(_by_line(spans, n_lines), lambda r: F.struct(
        F.get(ls, r["line_id"]).alias("line"), r["spans"].alias("spans"))))


def chunk_counts(chars: Column) -> Column:
    """Kept characters of each chunk of a line."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / CHUNK).cast("int")),
                       lambda i: kept_count(F.array_join(F.slice(chars, i * CHUNK + 1, F.lit(CHUNK)), "")))


def kept_before(chars: Column, run: Column, o: Column) -> Column:
    """Kept characters before offset ``o``: those of the whole chunks before it, and those of its own chunk."""
    chunk = F.floor(o / CHUNK).cast("int")
    own = F.array_join(F.slice(chars, chunk * CHUNK + 1, o - chunk * CHUNK), "")
    return F.when(chunk > 0, F.get(run, chunk - 1)).otherwise(F.lit(0).cast("bigint")) + kept_count(own)


def _line_cells(line: Column, spans: Column, extra: tuple[str, ...]) -> Column:
    """Cells of all spans of one line.

    The line is split once, and its kept characters are counted by chunks; only
    spans that hold whitespace count character by character.  A span's cost is
    that of its own characters and one chunk, a line's that of its characters.
    """
    flag = lambda c: F.when(is_whitespace_cp(F.ascii(c)), F.lit(0)).otherwise(F.lit(1))

    def cells(chars: Column, run: Column) -> Column:
        def of_span(s: Column) -> Column:
            lo, hi = F.greatest(s["so"], F.lit(0)), F.least(s["eo"], F.size(chars))

            def cell(own: Column, left: Column, c: Column, i: Column, keep: Column, rank: Column) -> Column:
                return F.struct(
                    s["attribute"].alias("attribute"), s["anno_seq"].alias("anno_seq"),
                    s["sl"].alias("sl"), s["so"].alias("so"),
                    (left["lo"] + i).alias("offset"), c.alias("ch"),
                    F.when(i > 0, F.get(own, i - 1)).otherwise(left["prev_ch"]).alias("prev_ch"),
                    keep.alias("keep"), rank.alias("rank"), *[s[e].alias(e) for e in extra])

            def of_chars(own: Column, left: Column) -> Column:
                plain = F.transform(own, lambda c, i: cell(own, left, c, i, F.lit(1), left["before"] + i))
                counted = let(F.transform(own, flag), lambda kept: let(prefix_sum(kept), lambda n: F.transform(own, lambda c, i: cell(
                    own, left, c, i, F.get(kept, i), left["before"] + F.get(n, i) - 1))))
                return F.when(kept_count(F.array_join(own, "")) == F.size(own), plain).otherwise(counted)

            left = F.struct(lo.alias("lo"), F.when(lo > 0, F.get(chars, lo - 1)).otherwise("").alias("prev_ch"), kept_before(chars, run, lo).alias("before"))
            return F.when(lo < hi, let(F.slice(chars, lo + 1, hi - lo), lambda own: let(left, lambda l: of_chars(own, l))))

        return F.flatten(F.filter(F.transform(spans, of_span), lambda x: x.isNotNull()))

    # An empty pattern leaves no trailing '' for a line that is not empty.
    return let(F.split(line, ""), lambda chars: let(prefix_sum(chunk_counts(chars)), lambda run: cells(chars, run)))


def _annotated_lines(annotations: DataFrame, frame: DataFrame, extra: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """One row per line that spans cover: the fields of the line, its text ``_l`` and its spans ``_s``."""
    j = frame.select(*PAGE, "n_lines", "lines", *carry).join(page_spans(annotations, extra), PAGE)
    # ``*_outer`` and a filter on the generated column: see ``clean_lines``.
    runs = j.select(*PAGE, *carry, F.explode_outer(_on_lines(F.col("spans"), F.col("n_lines"), F.col("lines"))).alias("_r"))
    # The fields by themselves: a cell's row carries none of the line's text.
    return runs.where(F.col("_r").isNotNull()).select(
        *PAGE, *carry, *[F.col(f"_r.line.{c}").alias(c) for c in ("line_id", "in_body", "kept_base")],
        F.col("_r.line.line").alias("_l"), F.col("_r.spans").alias("_s"))


def expand_spans(annotations: DataFrame, frame: DataFrame, p: TextParams, extra: tuple[str, ...] = (),
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """All cells of all spans on existing characters, kept or not.

    frame: ``page_frame`` rows.  Columns: category, page_id, line_id, offset,
    attribute, anno_seq, bio, ch, prev_ch (the raw character before, '' at line
    start), new_char_idx (null when the character is dropped), line_rank, plus
    the ``extra`` annotation columns and the ``carry`` columns of the page.
    """
    runs = _annotated_lines(annotations, frame, extra, carry)
    cells = runs.select(*PAGE, *carry, "line_id", "in_body", "kept_base", F.explode_outer(_line_cells(F.col("_l"), F.col("_s"), extra)).alias("_c"))
    cells = cells.where(F.col("_c").isNotNull())
    rank = F.col("_c.rank")
    kept = (F.col("_c.keep") == 1) & F.col("in_body")
    if p.mode == "line":
        kept = kept & (rank < p.capacity)
    first = (F.col("line_id") == F.col("_c.sl")) & (F.col("_c.offset") == F.col("_c.so"))
    return cells.select(
        *PAGE, "line_id",
        F.col("_c.offset").alias("offset"),
        F.col("_c.attribute").alias("attribute"), F.col("_c.anno_seq").alias("anno_seq"),
        F.when(first, F.lit("B")).otherwise(F.lit("I")).alias("bio"),
        F.col("_c.ch").alias("ch"),
        F.col("_c.prev_ch").alias("prev_ch"),
        F.when(kept, F.col("kept_base") + rank).alias("new_char_idx"),
        F.when(kept, rank.cast("int")).alias("line_rank"),
        *[F.col(f"_c.{e}").alias(e) for e in extra], *carry,
    )


def resolve_overlaps(cells: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Same (page, line, offset, attribute) written twice → later annotation wins.

    ch, prev_ch and new_char_idx are functions of the cell, so they ride along
    as grouping keys; the winner is packed into one bigint (anno_seq * 2 +
    tag) so the aggregate stays a hash aggregate with a fixed-width buffer.
    """
    packed = F.col("anno_seq") * 2 + F.when(F.col("bio") == "I", 1).otherwise(0)
    g = cells.groupBy(*PAGE, "line_id", "offset", "attribute", *extra, "ch", "prev_ch", "new_char_idx",
                      "line_rank").agg(
        F.max(packed).alias("_w"))
    return g.select(
        *PAGE, "line_id", "offset", "attribute", *extra,
        F.when(F.pmod(F.col("_w"), F.lit(2)) == 1, F.lit("I")).otherwise(F.lit("B")).alias("bio"),
        "ch", "prev_ch", "new_char_idx", "line_rank",
    )


def label_chars(annotations: DataFrame, frame: DataFrame, p: TextParams, extra: tuple[str, ...] = (),
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Sparse labels: the tagged kept characters (every other kept char is O).

    Columns: category, page_id, attribute, new_char_idx, bio, line_id, offset,
    ch, prev_ch, line_rank (rank among the kept chars of its line), ``extra``
    and ``carry``.  Cells on dropped characters vanish before the overlap
    resolution, which only needs the cells of one character: those of one line
    of a page's row.  Only where page keys repeat (counted over the keys alone) do
    cells of several rows meet, in an aggregate.
    """
    if _keys_repeat(frame):
        cells = expand_spans(annotations, frame, p, extra, carry).where(F.col("new_char_idx").isNotNull())
        return resolve_overlaps(cells, (*extra, *carry))
    j = frame.select(*PAGE, *line_columns(), *carry).join(page_spans(annotations, extra), PAGE)
    types = {f.name: f.dataType for f in j.schema.fields}
    types |= {f.name: f.dataType for f in types["spans"].elementType.fields}
    types |= {"line_id": T.IntegerType(), "offset": T.IntegerType(), "bio": T.StringType(), "ch": T.StringType(), "prev_ch": T.StringType(),
              "new_char_idx": T.LongType(), "line_rank": T.IntegerType()}
    names = [*PAGE, "line_id", "offset", "attribute", *extra, *carry, "bio", "ch", "prev_ch", "new_char_idx", "line_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in page_pieces(batches):
            for columns in _labels(piece, p, extra, carry):
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return j.mapInArrow(run, T.StructType([T.StructField(c, types[c]) for c in names]))


def _keys_repeat(frame: DataFrame) -> bool:
    """Whether several rows have the same page key (reads the keys only)."""
    return not frame.select(*PAGE).dropna().groupBy(*PAGE).count().where("count > 1").isEmpty()


def _labels(piece: pa.RecordBatch, p: TextParams, extra: tuple[str, ...], carry: tuple[str, ...]) -> Iterator[dict[str, pa.Array]]:
    """The tagged kept characters of some pages: of equal (character, attribute, extra) the cell of the later annotation."""
    lines, spans = Lines(piece, p), Spans(piece)
    if not len(spans.row):
        return
    kind = codes(spans.field("attribute")).astype(np.int64)
    for e in extra:
        kind = np.unique(kind * len(kind) + codes(spans.field(e)), return_inverse=True)[1]
    for at, line, span, w in kept_cells(lines, spans):
        one, w = last_of(kind[span] * (len(lines.cps) + 1) + at, w)
        at, line, span = at[one], line[one], span[one]
        rank, offset = lines.rank(at, line), at - lines.start[line]
        row, of = pa.array(lines.row[line]), pa.array(span)
        before = np.where(offset > 0, lines.cps[np.maximum(at - 1, 0)], NO_CHAR)
        yield {
            **{c: piece.column(c).take(row) for c in (*PAGE, *carry)}, **{c: spans.field(c).take(of) for c in ("attribute", *extra)},
            "line_id": pa.array(lines.no[line].astype(np.int32)), "offset": pa.array(offset.astype(np.int32)),
            "bio": pa.array(["B", "I"]).take(pa.array(w & 1)), "ch": single_characters(lines.cps[at]), "prev_ch": single_characters(before),
            "new_char_idx": pa.array(lines.base[line] + rank), "line_rank": pa.array(rank.astype(np.int32))}


def tag_string(bio, attribute):
    """'B'/'I' + attribute → 'B-attr'/'I-attr'; 'O' stays 'O'."""
    return F.when(bio == "O", F.lit("O")).otherwise(F.concat(bio, F.lit("-"), attribute))


def tag_prefix(tag):
    """The part before the first '-' (attribute names may contain '-')."""
    return F.substring_index(tag, "-", 1)


def bio_index(bio):
    return F.when(bio == "B", 0).when(bio == "I", 1).when(bio == "O", 2).cast("int")


def bio_from_index(idx):
    return F.when(idx == 0, "B").when(idx == 1, "I").when(idx == 2, "O")
