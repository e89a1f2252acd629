"""The logistic-regression tagger: gradient, weighted rows, scoring, quality against the count tagger."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanweave.config import TextParams
from spanweave.operators import chars, evaluate, scoring, spans
from spanweave.plans.extract import Corpus
from tests.test_pipeline import _anno_df, pages_df


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    w = rng.normal(size=(12, 6))  # 11 slots and the bias, two attributes
    slots, tags, n = rng.integers(0, 11, (9, 4)), rng.integers(0, 3, (9, 2)), rng.integers(1, 5, 9).astype(float)
    slots[0] = 3  # a slot hit more than once by a row
    loss, touched, gradient = scoring.lr_gradient(w, slots, tags, n)
    dense = np.zeros_like(w)
    dense[touched] = gradient
    for i in range(12):
        for c in range(6):
            step = np.zeros_like(w)
            step[i, c] = 1e-6
            slope = (scoring.lr_gradient(w + step, slots, tags, n)[0] - scoring.lr_gradient(w - step, slots, tags, n)[0]) / 2e-6
            assert abs(slope - dense[i, c]) < 1e-5


def corpus(spark, seed, n=30):
    rng = random.Random(seed)
    texts, rows = {}, []
    for page in range(n):
        words = [rng.choice(["red", "blue", "x17", "x4", "Bob", "Ann", "of", "the", "red"]) for _ in range(40)]
        texts[page] = " ".join(words) + "\n"
        at = 0
        for w in words:
            if w[0].isupper():
                rows.append((page, "name", 0, at, 0, at + len(w), len(rows)))
            if w[0] == "x":
                rows.append((page, "code", 0, at, 0, at + len(w), len(rows)))
            at += len(w) + 1
    p = TextParams(header_last=-1)
    c = Corpus(pages_df(spark, texts), p)
    return c, _anno_df(spark, rows), chars.kept_chars(c.lines, p, context=2)


def test_fit_beats_the_count_tagger_and_scores_as_its_weights_say(spark):
    c, anno, ctx = corpus(spark, 1)
    held, gold, held_ctx = corpus(spark, 2)
    model = scoring.train_tagger_lr(ctx, c.labels(anno), ["code", "name"], num_features=512, max_iter=40)
    assert len(model.losses) <= 40 and all(b <= a for a, b in zip(model.losses, model.losses[1:])) and model.losses[-1] < 0.05
    counts = scoring.train_tagger_counts(ctx, c.labels(anno))

    def f1(tags):
        both = held.spans_of(gold).select(*evaluate.SPAN_KEY, F.lit("gold").alias("set")).unionByName(spans.decode_spans(tags).select(*evaluate.SPAN_KEY, F.lit("pred").alias("set")))
        return evaluate.macro_page_f1(evaluate.page_prf(evaluate.match_sets(both), held.pages.select("category", "page_id"))).first().macro_f1

    own = f1(scoring.score_with_lr(held_ctx, model))
    assert own >= f1(scoring.score_with_counts(held_ctx, counts)) and own > 0.95

    rows = scoring.lr_rows(held_ctx, held.labels(gold), ["code", "name"], 2, 512)
    slots = held_ctx.select("new_char_idx", "page_id", F.array(*scoring._slots(2, 512)).alias("slots"))
    tags = scoring.lr_tags(held_ctx, model).select("page_id", "new_char_idx", "tags")
    for r in slots.join(tags, ["page_id", "new_char_idx"]).collect():
        z = (model.weights[r.slots].sum(axis=0) + model.weights[-1]).reshape(2, 3)
        best = z.max(axis=1)
        assert all(z[a, t] >= best[a] - 1e-9 for a, t in enumerate(r.tags))
    assert rows.agg(F.sum("n")).first()[0] == held_ctx.count() and rows.count() < held_ctx.count() / 2


def test_nothing_to_learn(spark):
    c, anno, ctx = corpus(spark, 3, 1)
    none = scoring.train_tagger_lr(ctx.where("page_id < 0"), c.labels(anno), ["name"], num_features=64)
    assert none.losses == () and not none.weights.any()
    assert scoring.score_with_lr(ctx, scoring.train_tagger_lr(ctx, c.labels(anno), [], num_features=64)).collect() == []


def test_lines_score_as_their_characters(spark, monkeypatch):
    """Tags and counts of whole lines equal those of character rows: neighbours past the line, astral characters, line mode."""
    monkeypatch.setattr(scoring, "PIECE_CHARS", 16)
    texts = {1: "aé x17\u3000𠮷b\n\n  \nBob 𠮷\u2028z\n", 2: "x", 3: "", 4: "Ann of " * 30 + "\r\nx4", 5: " \n"}
    rng = np.random.default_rng(5)
    model = scoring.LrModel(("a", "b"), 2, rng.normal(size=(129, 6)), ())
    for p in (TextParams(header_last=-1), TextParams(header_last=-1, mode="line", max_length=12)):
        lines = Corpus(pages_df(spark, texts), p).lines
        rows = []
        for df in (scoring.lr_cells(chars.kept_chars(lines, p, context=2), model), scoring.lr_line_cells(chars.kept_lines(lines), p, model)):
            got = df.collect()
            n = {}
            for r in got:
                if r.tags is None:
                    n[r.category, r.page_id] = n.get((r.category, r.page_id), 0) + r.n_scored
            rows.append((sorted(tuple(r) for r in got if r.tags is not None), n, [f.simpleString() for f in df.schema.fields]))
        assert rows[0][0] and rows[0] == rows[1]
