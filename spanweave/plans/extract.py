"""End-to-end plans built from the operators.

``Corpus`` holds the lazily-built tables of one run (pages, lines, kept
characters, tags) so that a plan reads like the original program: clean →
characters → tags → spans → evaluation.  Nothing here collects data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PAGE, TextParams
from ..operators import annotate, chars, evaluate, spans


@dataclass
class Corpus:
    pages: DataFrame
    params: TextParams

    @cached_property
    def info(self) -> DataFrame:
        """category, page_id, title, n_lines."""
        return chars.page_info(self.pages, self.params)

    @cached_property
    def frame(self) -> DataFrame:
        """One row per page with its cleaned lines and running indices."""
        return chars.page_frame(self.pages, self.params)

    @cached_property
    def lines(self) -> DataFrame:
        return chars.frame_lines(self.frame)

    @cached_property
    def chars(self) -> DataFrame:
        return chars.kept_chars(self.lines, self.params)

    def labels(self, annotations: DataFrame, extra: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
        """Sparse gold labels: tagged kept characters."""
        return annotate.label_chars(annotations, self.frame, self.params, extra, carry)

    def spans_of(self, annotations: DataFrame) -> DataFrame:
        """Spans decoded from the labels the annotations put on kept characters."""
        return spans.decode_spans(self.labels(annotations))

    def records(self, annotations: DataFrame) -> DataFrame:
        """Prediction records; the title comes from the page row the labels come from."""
        return spans.span_records(spans.decode_spans(self.labels(annotations, carry=("title",)), keys=(*spans.KEYS, "title")))


def extract_spans(pages: DataFrame, annotations: DataFrame, params: TextParams) -> DataFrame:
    """For every page, which attribute values does it hold, and where?

    Gold spans are projected onto the kept characters and decoded back into
    spans with source coordinates and text (the round trip the training data
    goes through).  Flat columns: page_id, title, attribute, start/end
    coordinates, text, start_idx, end_idx.
    """
    labels = Corpus(pages, params).labels(annotations, carry=("title",))
    return spans.decode_spans(labels, keys=(*spans.KEYS, "title")).select(
        "page_id", "title", "attribute", "start_line", "start_offset", "end_line",
        "end_offset", "text", "start_idx", "end_idx",
    )


def set_spans(corpus: "Corpus", annotations: DataFrame) -> DataFrame:
    """Spans of annotations that carry a ``set`` column (gold | pred), from ONE expansion and ONE decode."""
    return spans.decode_spans(corpus.labels(annotations, extra=("set",)), keys=(*spans.KEYS, "set"))


def evaluate_pages(pages: DataFrame, gold: DataFrame, pred: DataFrame, params: TextParams,
                   eval_pages: DataFrame | None = None) -> DataFrame:
    """Per-page precision / recall / F1 of predicted spans against gold spans."""
    both = gold.withColumn("set", F.lit("gold")).unionByName(pred.withColumn("set", F.lit("pred")))
    matches = evaluate.match_sets(set_spans(Corpus(pages, params), both))
    pages_list = eval_pages if eval_pages is not None else annotate.annotated_pages(gold).join(
        pages.select(*PAGE), PAGE, "left_semi")
    return evaluate.page_prf(matches.join(pages_list.select(*PAGE), PAGE, "left_semi"), pages_list)


def flat_records(records: DataFrame, *more) -> DataFrame:
    return records.select(
        "page_id", "title", "attribute",
        F.col("text_offset.start.line_id").alias("start_line"),
        F.col("text_offset.start.offset").alias("start_offset"),
        F.col("text_offset.end.line_id").alias("end_line"),
        F.col("text_offset.end.offset").alias("end_offset"),
        F.col("text_offset.text").alias("text"), *more,
    )
