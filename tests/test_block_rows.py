"""Blocks in the page row, run-length tags, batch scoring with pluggable models, batches across pages, global order."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.config import TextParams
from spanweave.operators import annotate, block_model, blocks, chars, examples, order, scoring, spans
from spanweave.plans.extract import Corpus
from tests.test_pipeline import PARAMS, _anno_df, all_pages, pages_df, random_annotations


def test_runs_spell_out(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.randint(1, 12)
        tags = [rng.choice([0, 1, 2, 2]) for _ in range(n)]
        rows.append((i, n, [(p, 2 * rng.randint(0, 5) + t) for p, t in enumerate(tags) if t != 2], tags))
    df = spark.createDataFrame(rows, "id int, n int, cells array<struct<pos:int,w:bigint>>, tags array<int>")
    made = df.withColumn("runs", blocks.tag_runs(F.col("cells"))).withColumn("spelled", blocks.spell_runs(F.col("runs"), F.col("n"))).collect()
    for r in made:
        assert r.spelled == r.tags
        assert all(a.start + a.len < b.start or a.tag != b.tag for a, b in zip(r.runs, r.runs[1:]))  # runs are whole


@pytest.mark.parametrize("p", PARAMS[:3], ids=lambda p: f"{p.mode}-{p.capacity}")
def test_blocks_hold_the_characters_and_their_places(spark, p):
    pages = pages_df(spark, all_pages())
    frame = chars.page_frame(pages, p)
    got = {(r.page_id, r.first_idx + i): (r.block_id, c.line_id, c.offset, c.cp, c.before)
           for r in blocks.page_blocks(frame, p, places=True).collect() for i, c in enumerate(r.chars)}
    want = {(r.page_id, r.new_char_idx): (r.block_id, r.line_id, r.offset, ord(r.ch), ord(r.ctx_m1) if r.ctx_m1 else 0)
            for r in chars.kept_chars(chars.clean_lines(pages, p), p, context=1).collect()}
    assert got == want


class Echo:
    """Tags by the code point alone; remembers nothing, so any batching must give the same."""

    attributes = ("a", "b")

    def __call__(self, batch):
        out = np.zeros((*batch.ids.shape, 2, 3))
        for a in range(2):
            np.put_along_axis(out[:, :, a], ((batch.ids + a) % 3)[..., None], 1.0, axis=2)
        return out


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_scored_blocks_do_not_depend_on_batches(spark, batch):
    p = TextParams(max_length=8)
    made = blocks.page_blocks(chars.page_frame(pages_df(spark, all_pages()), p), p, places=True)
    rows = block_model.score_blocks(made, Echo(), batch).collect()
    assert rows
    for r in rows:
        assert r.pred == [[(c.cp + a) % 3 for c in r.chars] for a in range(2)]
    empty = block_model.score_blocks(made.where("n < 0"), Echo(), batch)
    assert empty.collect() == [] and empty.columns[-1] == "pred"


def test_pieces_are_bounded_and_whole():
    rng = random.Random(2)
    rows = pa.table({"id": list(range(200)), "_ids": [[i] * rng.choice((0, 1, 5, 30)) for i in range(200)]}).to_batches()[0].slice(3, 190)
    pieces = list(block_model._pieces(rows, 20))
    assert pa.Table.from_batches(pieces).to_pylist() == rows.to_pylist() and len(pieces) > 50
    assert all(p.num_rows == 1 or sum(map(len, p.column("_ids").to_pylist())) <= 20 for p in pieces)
    assert list(block_model._pieces(rows.slice(0, 0), 20)) == []


def test_count_tagger_is_a_scorer(spark):
    p = TextParams(header_last=-1, max_length=40)
    texts = all_pages()
    pages = pages_df(spark, texts)
    anno = _anno_df(spark, random_annotations(random.Random(3), texts, ["a-b", "c"]))
    c = Corpus(pages, p)
    ctx = chars.kept_chars(c.lines, p, context=1)
    model = scoring.train_tagger_counts(ctx, c.labels(anno))
    want = spans.decode_spans(scoring.score_with_counts(ctx, model))
    got = block_model.predict_spans(pages, p, block_model.count_scorer(model), 5).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    with pytest.raises(ValueError):
        block_model.count_scorer(model, max_rows=1)
    none = block_model.count_scorer(model.where("bio = 'none'"))
    assert block_model.predict_spans(pages, p, none).collect() == []


def test_head_scorer_matches_its_layers():
    rng = np.random.default_rng(1)
    w1, w2 = rng.normal(size=(2, 4, 5)), rng.normal(size=(2, 3, 5))
    hidden = rng.normal(size=(3, 6, 4))
    got = block_model.HeadScorer(("x", "y"), lambda b: hidden, w1, w2)(None)
    for i in range(3):
        for j in range(6):
            for a in range(2):
                inner = np.maximum(w1[a] @ np.append(hidden[i, j], 1), 0)
                assert np.allclose(got[i, j, a], w2[a] @ np.append(inner, 1))


def test_running_sum_and_rank(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("aab") + str(rng.randint(0, 3)), rng.randint(0, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(5)
    got = {r.id: (r.s, r.r) for r in order.global_rank(order.running_sum(df, [F.col("k"), F.col("id")], F.col("v"), "s"), [F.col("k"), F.col("id")], "r").collect()}
    total = 0
    for rank, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[i] == (total, rank)
        total += v
    assert order.global_rank(df.where("id < 0"), [F.col("id")], "r").collect() == []


def test_training_batches(spark):
    rows = [("c", i // 5, i % 5, [1] * (1 + i % 7), [True] * (1 + i % 7), [[0] * (1 + i % 7)]) for i in range(53)]
    df = spark.createDataFrame(rows, "category string, page_id bigint, block_id bigint, input_ids array<int>, attention_mask array<boolean>, labels array<array<int>>")
    def made(**kw):
        return examples.training_batches(df.repartition(4), 8, **kw).collect()
    one = made(seed=3)
    assert sorted((r.batch_id, r.place) for r in one) == [(i // 8, i % 8) for i in range(53)]
    assert {(r.page_id, r.block_id) for r in one} == {(i // 5, i % 5) for i in range(53)}
    for b in range(7):
        own = [r for r in one if r.batch_id == b]
        longest = max(1 + (5 * r.page_id + r.block_id) % 7 for r in own)
        for r in own:
            n = 1 + (5 * r.page_id + r.block_id) % 7
            assert r.input_ids == [1] * n + [0] * (longest - n) and r.attention_mask == [True] * n + [False] * (longest - n)
            assert r.labels == [[0] * n + [-1] * (longest - n)]
        assert len({r.page_id for r in own}) > 1  # batches mix pages
    assert sorted(map(str, one)) == sorted(map(str, made(seed=3)))
    assert sorted(map(str, one)) != sorted(map(str, made(seed=4))) and sorted(map(str, one)) != sorted(map(str, made(seed=3, epoch=1)))
