"""Hierarchical Pitman-Yor scoring: exact base figures, normalized predictions, better than the base."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import pitman_yor as P
from spanweave.llm import tokens
from tests.llm.data import awkward, documents


def words(text):
    return (text or "").encode().lower().split()


def test_words_and_hashes(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 40)
    texts = [r[1] for r in awkward(20)] + ["é a\x1cb\x0bc", "x" * 100 + " y"]
    got, ended, code = [[] for _ in texts], [], {}
    for h, _, doc, over in tokens.batch_words(texts):
        for value, d in zip(h.tolist(), doc.tolist()):
            got[d].append(value)
        ended += over.tolist()
    assert ended == list(range(len(texts)))
    for text, values in zip(texts, got):
        assert len(values) == len(words(text))
        for w, v in zip(words(text), values):
            assert code.setdefault(w, v) == v
    assert len(set(code.values())) == len(code)


def brute(rows):
    train = collections.Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            train.update(words(r[1]) + ["end"])
    n, v = sum(train.values()), len(train)
    return [(r[0], len(words(r[1])) + 1, sum(train[w] > 0 for w in words(r[1]) + ["end"]), n,
             round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r[1]) + ["end"]), 6)) for r in rows]


def test_base_figures_are_exact(spark):
    rows = awkward()
    got = P.score_documents(documents(spark, rows)).collect()
    have = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(have, key=str) == sorted(brute(rows), key=str)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)


def test_held_out_text_scores_above_the_base_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = P.score_documents(docs).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    again = P.score_documents(docs).toPandas()
    merged = got.merge(again, on="doc_id")
    assert np.allclose(merged.score_x, merged.score_y)


def test_predictions_sum_to_one(spark):
    texts = spark.createDataFrame([("the cat sat on the mat",), ("the dog sat on the log the end",), ("a cat",)], "text string").coalesce(1)
    model = P.fit(texts, P.Settings(sweeps=3, averaged=2))
    cells = [r.cell for r in model.cells.collect()]
    predict = P._Predictor([bytes(c) for c in cells], model.totals, model.samples, model.settings)
    rows = np.arange(-1, len(predict.words))
    for context in list(np.flatnonzero(model.totals.customers)) + [12345]:
        p = 10 ** predict(rows, np.full(len(rows), context))[0]
        assert p.sum() == pytest.approx(1.0)


def test_the_context_is_the_whole_word_before(spark):
    """The words before end alike, so a model of word endings cannot tell the pairs apart."""
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][:400]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    texts = [(i, "king rules" if k % 2 else "ring shines") for k, i in enumerate(train)]
    texts += list(zip(held, ("king rules", "ring shines", "ring rules", "king shines")))
    rows = documents(spark, [(i, text, None, None, None, None, None, None) for i, text in texts])
    for settings in (P.Settings(), P.Settings(frequent=2)):
        score = {r.doc_id: r.score for r in P.score_documents(rows, settings=settings).where("held_out").collect()}
        seen, unseen = [score[i] for i in held[:2]], [score[i] for i in held[2:]]
        assert min(seen) > max(unseen) + 1


@pytest.mark.parametrize("frequent", [1, 12, 1 << 20])
def test_rare_words_and_contexts(spark, frequent):
    """Predictions sum to one, are the scores of the texts, and the base is exact, however work is dealt."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 300), None, None, None, None, None, None) for i in range(150)]
    rows += rows[:9]
    settings = P.Settings(frequent=frequent)
    docs = documents(spark, rows)
    model = P.fit(docs.select("text"), settings)
    totals = model.totals
    predict = P._Predictor([bytes(r.cell) for r in model.cells.collect()], totals, model.samples, settings)
    assert len(predict.words) == totals.known == len({w for r in rows for w in words(r[1])}) + 1
    assert (predict.count[:-1] > 0).all() and predict.count.sum() == totals.tokens
    assert sum(s.root_customers <= s.tokens and s.root_tables <= s.root_customers for s in model.samples) == settings.averaged
    every = np.arange(-1, len(predict.words))
    for context in range(-1, len(predict.words)):
        assert (10 ** predict(every, np.full(len(every), context))[0]).sum() == pytest.approx(1.0)
    code = {int(h): i for i, h in enumerate(predict.words.tolist())}

    def expected(text):
        w = np.array([code[int(h)] for piece in P._tokens(P._Texts(pa.array([text]))) for h in piece[0]])
        return predict(w, np.concatenate([[code[int(P.END_HASH)]], w[:-1]]))[0].sum()

    got = P.score(docs, model, ("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(expected(r.text))
    scored = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in P.score_documents(docs, settings=settings).collect()]
    assert sorted(scored) == sorted(brute(rows))


def test_seating_is_bounded_and_grows_with_the_customers():
    rng = np.random.default_rng(0)
    n = np.array([1, 2, 10, 1000, 1_000_000])
    t = np.mean([P.seat(n, 0.75, np.full(5, 1.0), np.full(5, 0.1), rng) for _ in range(20)], axis=0)
    assert t[0] == 1 and (t <= n).all() and (np.diff(t) >= 0).all()


def test_seating_matches_one_by_one():
    """Mean tables of small groups against a literal restaurant."""
    rng = np.random.default_rng(1)
    fast = P.seat(np.full(4000, 30), 0.5, np.full(4000, 0.8), np.full(4000, 0.05), rng).mean()
    total = 0
    for _ in range(2000):
        t = 1
        for m in range(1, 30):
            w = 0.8 + 0.05 * t
            t += rng.random() < w / (m - 0.5 * t + w)
        total += t
    assert fast == pytest.approx(total / 2000, rel=0.05)


def test_empty_and_untrained(spark):
    assert P.score_documents(documents(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = P.score_documents(documents(spark, [(held, "a b", None, None, None, None, None, None)])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and np.isfinite(r.score)
