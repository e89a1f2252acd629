"""Bindings of the driver tables to the span-annotation data model.

The driver tables hold invented prose, not annotated pages, so gold spans,
"predictions" and training logs are derived from them by fixed rules (see
FIXTURES.md §G).  Every rule is row-local or per page, so the derived tables
grow with the input tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PAGE
from ..functions.codepoints import integers, slices, strings_of, within
from ..operators.block_model import HeadScorer
from ..operators.cells import PIECE_CHARS
from ..operators.scoring import head_weights
from .pages import TEXT_OFFSET, split_lines

# --- fixture rules (fixed values shared with the SQL oracle) ------------------
# attribute name → pattern; every match on a raw line is a gold span.
ATTRIBUTE_PATTERNS = (
    ("cap", "[A-Z][a-z]{3,}"),
    ("accent-word", "[a-z]*[éèê][a-z]*"),
    ("number", "[0-9]+"),
)
# id arithmetic for extra spans
MULTI_LINE_MOD = 7        # cap span (1,2)-(2,6): offsets 2..5 on lines 1 and 2
OVERLAP_MOD = 11          # accent-word span (1,0)-(1,8), later than the line spans
EMPTY_MOD = 13            # number spans (1,5)-(1,5) and (1,8)-(2,3): no cells
MISSING_PAGE_MOD = 97     # cap span on page_id + MISSING_PAGE_SHIFT (no such page)
MISSING_PAGE_SHIFT = 10_000_000
MATCH_STEP = 1 << 20      # ordinal = (line × 4 + attribute) × MATCH_STEP + match
EXTRA_SEQ = 1 << 50       # extras come after the line spans in file order
# predictions = gold, dropped when (page_id + line_id) % 5 = 0, end offset
# shortened by one when % 7 = 0
PRED_DROP_MOD = 5
PRED_SHORTEN_MOD = 7
# embeddings → scoring fixtures
# pages per category of the split (the documents have 20 sources of few pages)
N_TRAIN = 30
N_VALID = 5
HEAD_ATTRS = 3
BATCH_SIZE = 8
# ------------------------------------------------------------------------------


def _offset(sl, so, el, eo, text=None):
    return F.struct(
        F.struct(sl.cast("int").alias("line_id"), so.cast("int").alias("offset")).alias("start"),
        (text if text is not None else F.lit(None).cast("string")).alias("text"),
        F.struct(el.cast("int").alias("line_id"), eo.cast("int").alias("offset")).alias("end"),
    ).cast(TEXT_OFFSET)


OTHER, UPPER, LOWER, ACCENT, DIGIT = range(5)
CLASSES = np.zeros(256, np.uint8)
CLASSES[ord("A"):ord("Z") + 1], CLASSES[ord("a"):ord("z") + 1], CLASSES[ord("0"):ord("9") + 1] = UPPER, LOWER, DIGIT
CLASSES[[ord(c) for c in "éèê"]] = ACCENT


def pattern_matches(cps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the matches of each of ``ATTRIBUTE_PATTERNS`` in a text that ends with a line feed.

    No pattern matches a line feed, so the matches of a text are those of its lines.
    """
    kind = CLASSES[np.where(cps < 256, cps, 0)]
    upper, accent = np.flatnonzero(kind == UPPER), np.flatnonzero(kind == ACCENT)
    no_lower, no_word = np.flatnonzero(kind != LOWER), np.flatnonzero((kind != LOWER) & (kind != ACCENT))
    cap_end = no_lower[np.searchsorted(no_lower, upper + 1)]
    cap = cap_end - upper >= 4
    # Of a run of word characters, the first match begins with the run, later ones with their accent, where the one before ends.
    after = np.searchsorted(no_word, accent)
    run_start, run_end = np.where(after > 0, no_word[np.maximum(after - 1, 0)] + 1, 0), no_word[after]
    first = np.append(True, run_start[1:] != run_start[:-1])[:len(accent)]
    last = np.append(first[1:], True)[:len(accent)]
    start = np.where(first, run_start, accent)
    end = np.where(last, run_end, np.append(accent[1:], 0)[:len(accent)])
    edge = np.flatnonzero(np.diff((kind == DIGIT).astype(np.int8), prepend=0, append=0))
    return [(upper[cap], cap_end[cap]), (start, end), (edge[::2], edge[1::2])]


def _extra_spans(page_id: np.ndarray) -> list[tuple]:
    """(pages, page ids, attribute, sl, so, el, eo, anno_seq) of the spans that follow from the page id alone."""
    every = ((MULTI_LINE_MOD, 0, "cap", 1, 2, 2, 6, EXTRA_SEQ), (OVERLAP_MOD, 0, "accent-word", 1, 0, 1, 8, EXTRA_SEQ + 1),
             (EMPTY_MOD, 0, "number", 1, 5, 1, 5, EXTRA_SEQ + 2), (EMPTY_MOD, 0, "number", 1, 8, 2, 3, EXTRA_SEQ + 3),
             (MISSING_PAGE_MOD, MISSING_PAGE_SHIFT, "cap", 0, 0, 0, 3, 0))
    return [(found := np.flatnonzero(page_id % mod == 0), page_id[found] + shift, *rest) for mod, shift, *rest in every]


def _gold_rows(piece: pa.RecordBatch) -> pa.RecordBatch:
    """The gold spans of some pages (category, page_id, text), in the order of their lines."""
    texts = [t or "" for t in piece.column(2).to_pylist()]
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t for t in texts]
    cps = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) + 1 for t in texts])
    page_start = np.cumsum(size) - size
    feeds = np.flatnonzero(cps == 10)
    line_start, first_line = np.append(0, feeds + 1), np.searchsorted(feeds, page_start)
    page_id = integers(piece.column(1), 1)  # 1: no extra spans
    names = [name for name, _ in ATTRIBUTE_PATTERNS]
    parts, matched = [], []  # (order, page, page_id, attribute, sl, so, el, eo, seq); the places of matches
    for k, (start, end) in enumerate(pattern_matches(cps)):
        line = np.searchsorted(feeds, start)
        page = np.searchsorted(first_line, line, side="right") - 1
        number, so = line - first_line[page], start - line_start[line]
        nth = np.arange(len(line)) - np.searchsorted(line, line)
        parts.append((line * 4 + k, page, page_id[page], np.full(len(line), k), number, so, number, so + end - start, (number * 4 + k) * MATCH_STEP + nth))
        matched.append((start, end))
    for page, pid, attribute, *values in _extra_spans(page_id):
        parts.append((first_line[page] * 4 + 3, page, pid, *[np.full(len(page), v, np.int64) for v in (names.index(attribute), *values)]))
        matched.append((np.full(len(page), -1), np.full(len(page), -1)))
    order, page, pid, attribute, sl, so, el, eo, seq = [np.concatenate(x) for x in zip(*parts)]
    start, end = [np.concatenate(x) for x in zip(*matched)]
    by = np.argsort(order, kind="stable")
    start, n = start[by], (end - start)[by]
    text = strings_of(cps[np.repeat(start, n) + within(n)], np.append(0, np.cumsum(n)))
    text = pc.if_else(pa.array(start >= 0), text, pa.scalar(None, pa.string()))
    ids = pa.array(pid[by])
    if piece.column(1).null_count:
        ids = pc.if_else(piece.column(1).is_valid().take(pa.array(page[by])), ids, pa.scalar(None, pa.int64()))
    numbers = [pa.array(x[by].astype(np.int32)) for x in (sl, so, el, eo)]
    return pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(page[by])), ids, pa.array(names).take(pa.array(attribute[by])), *numbers, text, pa.array(seq[by])],
                                      names=["category", "page_id", "attribute", "sl", "so", "el", "eo", "text", "anno_seq"])


def fixture_annotations(pages: DataFrame) -> DataFrame:
    """Gold spans derived from raw page lines.

    Columns: category, page_id, title (null), attribute, text_offset, anno_seq.  One
    pass over the texts, in pieces of about a million characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(integers(pc.binary_length(batch.column(2)), 0), PIECE_CHARS):
                yield _gold_rows(batch.slice(first, last - first))

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    found = pages.select(*PAGE, "text").mapInArrow(run, f"category {kinds['category']}, page_id {kinds['page_id']}, attribute string, sl int, so int, el int, eo int, text string, anno_seq bigint")
    return found.select(*PAGE, F.lit(None).cast("string").alias("title"), "attribute",
                        _offset(F.col("sl"), F.col("so"), F.col("el"), F.col("eo"), F.col("text")).alias("text_offset"), "anno_seq")


def fixture_predictions(annotations: DataFrame) -> DataFrame:
    """Gold perturbed so that F1 lies strictly between 0 and 1."""
    key = F.col("page_id") + F.col("text_offset.start.line_id")
    kept = annotations.where(key % PRED_DROP_MOD != 0)
    eo = F.col("text_offset.end.offset")
    new_eo = F.when(key % PRED_SHORTEN_MOD == 0, eo - 1).otherwise(eo)
    return kept.withColumn(
        "text_offset",
        _offset(F.col("text_offset.start.line_id"), F.col("text_offset.start.offset"),
                F.col("text_offset.end.line_id"), new_eo, F.col("text_offset.text")),
    )


def fixture_gold_and_pred(annotations: DataFrame) -> DataFrame:
    """Gold spans and their perturbed predictions from ONE pass over the gold
    rows, as one table with ``set`` = gold | pred (the same rule as
    ``fixture_predictions``)."""
    key = F.col("page_id") + F.col("text_offset.start.line_id")
    eo = F.col("text_offset.end.offset")
    pred_off = _offset(F.col("text_offset.start.line_id"), F.col("text_offset.start.offset"),
                       F.col("text_offset.end.line_id"),
                       F.when(key % PRED_SHORTEN_MOD == 0, eo - 1).otherwise(eo), F.col("text_offset.text"))
    both = F.array(
        F.struct(F.lit("gold").alias("set"), F.col("text_offset").alias("t")),
        F.when(key % PRED_DROP_MOD != 0, F.struct(F.lit("pred").alias("set"), pred_off.alias("t"))),
    )
    return annotations.select(
        *PAGE, "title", "attribute", "anno_seq",
        F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_x"),
    ).select(*PAGE, "title", "attribute", F.col("_x.t").alias("text_offset"), "anno_seq",
             F.col("_x.set").alias("set"))


def epoch_log(events: DataFrame) -> DataFrame:
    """events → epoch_log(run, epoch, valid_f1): run = user, epoch = 0-based rank by time."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("run"),
        (F.row_number().over(w) - 1).cast("int").alias("epoch"),
        (F.col("value") / 500.0).alias("valid_f1"),
    )


def batch_log(events: DataFrame) -> DataFrame:
    """events → batch_log(run, epoch, loss): one batch per event, epoch = day index."""
    return events.select(
        F.col("user_id").alias("run"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        (F.col("value") / 100.0).alias("loss"),
    )


def head_weight(attr: int, out: int, inp: int) -> float:
    """Formula-defined weights of the per-attribute heads (input index h = bias)."""
    return ((attr * 31 + out * 17 + inp * 7) % 13 - 6) / 10.0


# The block model: hidden vectors by formula from a character and the raw one before it.
# All values are integers, so that logits are exact and ties fall alike everywhere.
BLOCK_ATTRS = ("first", "second")
BLOCK_HIDDEN = 8
BLOCK_O_BIAS = 60


def block_hidden(batch):
    """h_j = (cp × (2j + 3) + before × (j + 1) + 5j) mod 11 - 5."""
    j = np.arange(BLOCK_HIDDEN)
    return (batch.ids[..., None] * (2 * j + 3) + batch.before[..., None] * (j + 1) + 5 * j) % 11 - 5


def block_weight(attr: int, out: int, inp: int) -> int:
    """Formula-defined weights of the block model's heads (input index h = bias)."""
    return (attr * 31 + out * 17 + inp * 7) % 13 - 6


def block_scorer() -> HeadScorer:
    w1, w2 = head_weights(len(BLOCK_ATTRS), BLOCK_HIDDEN, block_weight)
    w2[:, 2, -1] += BLOCK_O_BIAS
    return HeadScorer(BLOCK_ATTRS, block_hidden, w1, w2)


def embedding_label(attr_idx):
    """Label of a vector for an attribute; -1 (ignored) when (vec_id + attr) % 4 = 0, and for all of batch % 7 = 0, attribute 2."""
    none = ((F.col("vec_id") + attr_idx) % 4 == 0) | ((embedding_batch() % 7 == 0) & (attr_idx == 2))
    return F.when(none, F.lit(-1)).otherwise(F.pmod(F.col("label") + attr_idx, F.lit(3))).cast("int")


def embedding_batch():
    return F.expr(f"vec_id div {BATCH_SIZE}").cast("bigint")


def logit_scale():
    """Every fifth vector's logits are scaled up, so that some probabilities underflow."""
    return F.when(F.col("vec_id") % 5 == 0, F.lit(100.0)).otherwise(F.lit(1.0))


# Raw lines that the driver documents lack: one of these is put before a line
# when its number matches (page_id + line_id) % 12.
FIXTURE_PREFIXES = {
    0: "^ ",
    1: "ファイル:a.png ファイル:bb.jpeg ",
    2: "移動先:\t\t\t\t\t案内、\t\t\t\t\t検索 ",
    3: "出典: フリー百科事典『ウィキペディア（Wikipedia）』 ",
    4: "「x」から取得 ",
    5: "see http://a.jp/x and https://longer.example.com/path?q=1 or ftp://f.org/abc ",
}
PREFIX_MOD = 12


def prefixed_lines(pages: DataFrame) -> DataFrame:
    """Raw lines, some of them with a prefix that the blanking and footer rules act on."""
    which = (F.col("page_id") + F.col("line_id")) % PREFIX_MOD
    prefix = F.lit("")
    for k, text in FIXTURE_PREFIXES.items():
        prefix = F.when(which == k, F.lit(text)).otherwise(prefix)
    return split_lines(pages).withColumn("line", F.concat(prefix, F.col("line")))
