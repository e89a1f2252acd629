"""Pages → kept characters → labels → spans, against the plain-Python model."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.config import TextParams
from spanweave.operators import annotate, chars, spans
from spanweave.plans.extract import Corpus
from spanweave.sources.fixtures import _offset
from tests import model
from tests.test_text import random_text

JA_PAGES = {
    1: "東京 - Wikipedia Dump 2021\n東京都は日本の首都。\n人口は約1400万人。\n^脚注の本文\n脚注\n後ろの行\n",
    2: "無題の頁\r\n説明 http://a.jp/x と http://longer.example.com/p を参照\r\nファイル:a.png 画像\r\n",
    3: "見出し\n本文　全角空白 行内\n東京都庁」から取得\n落ちる行\n",
    4: "",
    5: " \n\t\n　\n",
    6: "最後の見出し\n外部リンク",  # heading without newline does not fire
    7: "一行目\n" + "".join(f"行{i}の文\n" for i in range(40)),
}

PARAMS = [
    TextParams(header_last=-1, mode="char", variant="codepoint", max_length=6),
    TextParams(header_last=0, mode="char", variant="vocab", max_length=7),
    TextParams(header_last=-1, mode="line", variant="vocab", max_length=5),
    TextParams(header_last=26, mode="char", variant="codepoint", max_length=2048),
]


def pages_df(spark, pages: dict):
    return spark.createDataFrame([("C", k, v) for k, v in pages.items()], "category string, page_id bigint, text string")


def all_pages():
    rng = random.Random(7)
    pages = dict(JA_PAGES)
    for i in range(100, 160):
        pages[i] = random_text(rng)
    return pages


@pytest.mark.parametrize("p", PARAMS, ids=lambda p: f"{p.mode}-{p.capacity}-h{p.header_last}")
def test_kept_chars_match_model(spark, p):
    pages = all_pages()
    got = chars.page_chars(pages_df(spark, pages), p).collect()
    by_page = {}
    for r in got:
        by_page.setdefault(r.page_id, []).append(
            dict(line_id=r.line_id, offset=r.offset, char_idx=r.char_idx, ch=r.ch,
                 new_char_idx=r.new_char_idx, block_id=r.block_id, block_idx=r.block_idx))
    for pid, text in pages.items():
        expect = model.page_chars(text, p)
        have = sorted(by_page.get(pid, []), key=lambda d: d["new_char_idx"])
        assert have == expect, (pid, text)


def test_invariants_and_partition_independence(spark):
    p = TextParams(header_last=-1, max_length=9)
    df = pages_df(spark, all_pages())
    a = chars.page_chars(df, p)
    b = chars.page_chars(df.repartition(5), p)
    assert sorted(a.collect()) == sorted(b.collect())
    # new_char_idx dense from 0 per page, block_idx < capacity
    chk = a.groupBy("page_id").agg(F.min("new_char_idx").alias("lo"), F.max("new_char_idx").alias("hi"),
                                   F.count(F.lit(1)).alias("n"), F.max("block_idx").alias("bmax")).collect()
    for r in chk:
        assert r.lo == 0 and r.hi == r.n - 1 and r.bmax < p.capacity


def test_title_and_footer(spark):
    p = TextParams(header_last=-1)
    info = {r.page_id: r.title for r in chars.page_info(pages_df(spark, JA_PAGES), p).collect()}
    assert info[1] == "東京" and info[2] is None
    frame = {r.page_id: r.footer_line for r in chars.page_frame(pages_df(spark, JA_PAGES), p).collect()}
    assert frame[1] == 4 and frame[3] == 2 and frame[6] == -1


def _anno_df(spark, rows):
    schema = "page_id bigint, attribute string, sl int, so int, el int, eo int, anno_seq bigint"
    df = spark.createDataFrame(rows, schema)
    return df.select(F.lit("C").alias("category"), "page_id", F.lit(None).cast("string").alias("title"), "attribute",
                     _offset(F.col("sl"), F.col("so"), F.col("el"), F.col("eo")).alias("text_offset"), "anno_seq")


def random_annotations(rng, pages, attrs):
    rows, seq = [], 0
    for pid, text in pages.items():
        n = len(model.read_lines(text))
        for _ in range(rng.randint(0, 6)):
            sl = rng.randint(0, max(n, 1))
            el = sl + rng.choice([0, 0, 0, 1, 2, -1])
            so = rng.randint(0, 12)
            eo = so + rng.choice([0, 1, 2, 3, 5, -1])
            rows.append((pid, rng.choice(attrs), sl, so, el, eo, seq))
            seq += 1
    rows.append((999999, "a-b", 0, 0, 0, 3, seq))  # annotation for a missing page
    return rows


@pytest.mark.parametrize("p", PARAMS[:3], ids=lambda p: f"{p.mode}-{p.capacity}")
def test_spans_match_model(spark, p):
    rng = random.Random(11)
    pages = all_pages()
    attrs = ["a-b", "c", "d"]
    rows = random_annotations(rng, pages, attrs)
    c = Corpus(pages_df(spark, pages), p)
    got = {(r.page_id, r.attribute, r.start_idx, r.end_idx, r.start_line, r.start_offset, r.end_line,
            r.end_offset, r.text) for r in c.spans_of(_anno_df(spark, rows)).collect()}
    expect = set()
    for pid, text in pages.items():
        anns = [dict(sl=r[2], so=r[3], el=r[4], eo=r[5], attribute=r[1]) for r in sorted(rows, key=lambda r: r[6])
                if r[0] == pid]
        for s in model.page_spans(text, anns, attrs, p):
            expect.add((pid,) + s)
    assert got == expect


def test_overlap_later_wins_and_dropped_b(spark):
    p = TextParams(header_last=-1)
    pages = {1: "abcdef ghij\n"}
    rows = [(1, "x", 0, 0, 0, 4, 0),   # abcd  B at a
            (1, "x", 0, 2, 0, 6, 1),   # later: cdef  B at c overrides I
            (1, "y", 0, 6, 0, 9, 2)]   # ' gh': B falls on the dropped blank → starts with I
    c = Corpus(pages_df(spark, pages), p)
    lab = {(r.attribute, r.new_char_idx): r.bio for r in c.labels(_anno_df(spark, rows)).collect()}
    assert lab[("x", 0)] == "B" and lab[("x", 1)] == "I" and lab[("x", 2)] == "B"
    assert ("y", 6) in lab and lab[("y", 6)] == "I"
    sp = sorted((r.attribute, r.start_idx, r.end_idx, r.text) for r in c.spans_of(_anno_df(spark, rows)).collect())
    assert sp == [("x", 0, 1, "ab"), ("x", 2, 5, "cdef"), ("y", 6, 7, "gh")]


def test_decode_matches_state_machine(spark):
    rng = random.Random(5)
    seqs = [[rng.choice("BIO") for _ in range(rng.randint(0, 30))] for _ in range(300)]
    seqs += [["I"], ["O", "I", "I"], ["B", "B"], ["I", "B", "I", "O", "I"], ["O"] * 4, ["B"] * 3 + ["I"]]
    rows = [("C", i, "a", k, t, 0, k, "x", len(s)) for i, s in enumerate(seqs) for k, t in enumerate(s)]
    df = spark.createDataFrame(rows, "category string, page_id bigint, attribute string, new_char_idx bigint, bio string, "
                                     "line_id int, offset int, ch string, n_kept bigint")
    got = {(r.page_id, r.start_idx, r.end_idx) for r in spans.decode_spans(df).collect()}
    expect = {(i, s, e) for i, seq in enumerate(seqs) for s, e in model.decode(seq)}
    assert got == expect
    # the flags derived from the sparse tags are those of the dense sequence
    got = {(r.page_id, r.new_char_idx, r.insert, r.start, r.end) for r in spans.bio_transitions(df).collect()}
    expect = set()
    for i, seq in enumerate(seqs):
        for k, (prev, t) in enumerate(zip(["O"] + seq, seq)):
            flags = (prev != "O" and t in "BO", t == "B" or (prev == "O" and t == "I"), t != "O")
            if any(flags):
                expect.add((i, k, *flags))
    assert got == expect


def test_page_id_in_two_categories(spark):
    """The same page id in two categories: own text, own labels, own attribute index, own split."""
    from spanweave.operators import splits
    pages = spark.createDataFrame([("City", 1, "abc def\n"), ("Company", 1, "xyz uvw\n")], "category string, page_id bigint, text string")
    rows = [("City", 1, "name", 0, 0, 0, 3, 0), ("Company", 1, "brand", 0, 4, 0, 7, 0), ("Company", 1, "name", 0, 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, "category string, page_id bigint, attribute string, sl int, so int, el int, eo int, anno_seq bigint")
    anno = df.select("category", "page_id", F.lit(None).cast("string").alias("title"), "attribute",
                     _offset(F.col("sl"), F.col("so"), F.col("el"), F.col("eo")).alias("text_offset"), "anno_seq")
    got = {(r.category, r.attribute, r.text) for r in Corpus(pages, TextParams(header_last=-1)).spans_of(anno).collect()}
    assert got == {("City", "name", "abc"), ("Company", "brand", "uvw"), ("Company", "name", "x")}
    index = {(r.category, r.attribute): r.attr_idx for r in annotate.attribute_index(anno).collect()}
    assert index == {("City", "name"): 0, ("Company", "brand"): 0, ("Company", "name"): 1}
    sizes = splits.split_pages(annotate.annotated_pages(anno), n_train=1, n_valid=1)
    assert [r.tvt for r in sizes.collect()] == ["train", "train"]
    state = annotate.page_annotations(anno.withColumn("page_id", F.when(F.col("attribute") == "brand", 9).otherwise(F.col("page_id"))), pages)
    assert {(r.category, r.attribute, r.page_state) for r in state.collect()} == {
        ("City", "name", "found"), ("Company", "brand", "missing"), ("Company", "name", "found")}


def test_tag_strings_split_at_first_dash(spark):
    df = spark.createDataFrame([("B", "a-b-c"), ("I", "x"), ("O", "y")], "bio string, attribute string")
    r = df.select(annotate.tag_string(F.col("bio"), F.col("attribute")).alias("t")) \
        .select("t", annotate.tag_prefix(F.col("t")).alias("p")).collect()
    assert [(x.t, x.p) for x in r] == [("B-a-b-c", "B"), ("I-x", "I"), ("O", "O")]


@pytest.mark.parametrize("p", PARAMS[:3], ids=lambda p: f"{p.mode}-{p.capacity}")
def test_codepoint_blocks_from_line_segments(spark, p):
    from spanweave.operators import examples
    pages = all_pages()
    lines = chars.clean_lines(pages_df(spark, pages), p)
    got = {(r.page_id, r.block_id): r.cps for r in examples.codepoint_blocks(lines, p).collect()}
    expect = {}
    for pid, text in pages.items():
        for c in model.page_chars(text, p):
            expect.setdefault((pid, c["block_id"]), []).append(ord(c["ch"]))
    assert got == expect


@pytest.mark.parametrize("p", PARAMS[:3], ids=lambda p: f"{p.mode}-{p.capacity}")
def test_block_labels_match_model(spark, p):
    from spanweave.operators import blocks as page_rows, examples
    rng = random.Random(13)
    pages = all_pages()
    attrs = ["a-b", "c", "d"]
    rows = random_annotations(rng, pages, attrs)
    c = Corpus(pages_df(spark, pages), p)
    anno = _anno_df(spark, rows)
    made = page_rows.page_blocks(c.frame, p, anno, annotate.attribute_index(anno))
    got = {(r.page_id, r.block_id, r.attr_idx): r.labels for r in examples.block_labels(made, p).collect()}
    code = {"B": 0, "I": 1, "O": 2}
    expect = {}
    for pid, text in pages.items():
        chs = model.page_chars(text, p)
        tags = model.cells([dict(sl=r[2], so=r[3], el=r[4], eo=r[5], attribute=r[1])
                            for r in sorted(rows, key=lambda r: r[6]) if r[0] == pid])
        blocks = {}
        for ch in chs:
            blocks.setdefault(ch["block_id"], []).append(ch)
        for b, members in blocks.items():
            for ai, attr in enumerate(sorted(attrs)):
                body = [code[tags.get((m["line_id"], m["offset"], attr), "O")] for m in members]
                if p.variant == "vocab":
                    row = [-1] + body + [-1]
                else:
                    row = [-1] + body + ([-1] * 3 if len(body) <= 3 else [])
                expect[(pid, b, ai)] = row
    assert got == expect
