"""The page store: same spans as without it, no exchange of page text, reopened by its folder."""

import re

import pytest

from spanweave.config import TextParams
from spanweave.operators import annotate, spans
from spanweave.plans.extract import Corpus
from spanweave.sources.store import PageStore
from tests.test_pipeline import _anno_df, pages_df

P = TextParams(header_last=-1)
TEXTS = {1: "Ann saw Bob\nand x17\n", 2: "nothing here\n", 3: "", 4: "x4 Bob\n" * 50}
ROWS = [(1, "name", 0, 0, 0, 3, 0), (1, "name", 0, 8, 0, 11, 1), (1, "code", 1, 4, 1, 7, 2),
        (1, "name", 0, 8, 0, 11, 3), (4, "code", 2, 0, 2, 2, 4), (9, "name", 0, 0, 0, 3, 5)]


def rows(df):
    return sorted(map(str, df.collect()))


def stored(spark, root, texts=TEXTS, annos=ROWS, buckets=3):
    c, anno = Corpus(pages_df(spark, texts), P), _anno_df(spark, annos)
    store = PageStore(spark, str(root))
    store.write(c.frame, anno, buckets)
    return c, anno, store


def test_spans_are_those_without_a_store_and_a_later_session_finds_them(spark, tmp_path):
    c, anno, store = stored(spark, tmp_path / "s")
    want = rows(c.spans_of(anno))
    again = PageStore(spark, str(tmp_path / "s"))
    for s in (store, again):
        assert rows(s.frame()) == rows(c.frame) and rows(s.annotations()) == rows(anno)
        assert rows(spans.decode_spans(annotate.label_chars(s.annotations(), s.frame(), P))) == want and want
    with pytest.raises(Exception):
        PageStore(spark, str(tmp_path / "s")).write(c.frame, anno, 3)
    with pytest.raises(ValueError):
        PageStore(spark, str(tmp_path / "t")).write(c.frame, anno, 0)


def exchanges(df):
    """Output columns of every exchange of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan), plan


def test_page_text_is_not_exchanged(spark, tmp_path):
    c, anno, store = stored(spark, tmp_path / "s")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for s in (store, PageStore(spark, str(tmp_path / "s"))):
            found, plan = exchanges(spans.decode_spans(annotate.label_chars(s.annotations(), s.frame(), P)))
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            # The tagged characters move, once; neither lines nor the spans of a page do.
            assert len(found) == 1 and "lines#" not in found[0] and "spans#" not in found[0] and "text_offset#" not in found[0]
        without, _ = exchanges(c.spans_of(anno))
        assert any("lines#" in x for x in without)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_tables(spark, tmp_path):
    c, anno, store = stored(spark, tmp_path / "none")
    empty = PageStore(spark, str(tmp_path / "empty"))
    empty.write(c.frame.where("false"), anno.where("false"), 2)
    again = PageStore(spark, str(tmp_path / "empty"))
    assert again.frame().count() == 0 and again.annotations().count() == 0
    assert annotate.label_chars(again.annotations(), again.frame(), P).count() == 0
