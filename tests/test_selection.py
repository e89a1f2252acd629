"""Two-level scan of epoch logs; the model selection loop, its log, stop and resumption."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators import evaluate, scoring, selection, spans
from spanweave.session import checkpointed
from tests.test_tagger_lr import corpus

LOG = "run long, epoch int, valid_f1 double"


def plain(log, patience):
    """Per run: (epoch, improved, best F1, best epoch, since best) up to the stop, by a loop."""
    out = []
    for run in {r for r, _, _ in log}:
        best, best_at, since = 0.0, 0, 0
        for _, epoch, f1 in sorted(x for x in log if x[0] == run):
            improved = f1 > best
            if improved:
                best, best_at, since = f1, epoch, 0
            else:
                since += 1
            out.append((run, epoch, improved, best, best_at, since, since >= patience))
            if since >= patience:
                break
    return sorted(out)


@pytest.mark.parametrize("segment", [1, 4, 1024])
def test_segments_carry_over(spark, segment):
    rng = random.Random(segment)
    log = [(0, e, round(rng.random() * rng.choice([0, 0.3, 1]), 2)) for e in range(180)]  # one run holds 90 % of the rows
    log += [(run, e + run, round(rng.random(), 1)) for run in range(1, 5) for e in range(5)]
    frame = spark.createDataFrame(log, LOG)
    for patience in (3, 10, 500):
        got = evaluate.early_stop(frame, patience, segment)
        rows = got.select("run", "epoch", "improved", "best_valid_f1", "best_epoch", "since_best", "stop").collect()
        assert sorted(map(tuple, rows)) == plain(log, patience)
    assert evaluate.run_summary(frame.limit(0), 3, segment).count() == 0


def test_null_runs_and_null_scores_keep_their_rows(spark):
    frame = spark.createDataFrame([(None, 0, 0.5), (None, 5, None), (None, 9, 0.6)], LOG)
    got = {r.epoch: (r.best_valid_f1, r.best_epoch) for r in evaluate.best_epoch(frame, 4).collect()}
    assert got == {0: (0.5, 0), 5: (0.5, 0), 9: (0.6, 9)}


def test_the_loop_stops_by_its_log_and_goes_on_after_a_break(spark):
    f1 = [0.1, 0.4, 0.3, 0.4, 0.2, 0.9]
    step = lambda s: ({"x": s["x"] + 1}, 1.0 / float(s["x"][0, 0] + 1))
    score = lambda s: f1[int(s["x"][0, 0]) - 1]
    start = {"x": np.zeros((1, 1))}
    whole = selection.select_model(spark, tempfile.mkdtemp(prefix="select-", dir="/tmp"), 3, start, step, score, patience=3)
    assert (whole.best_epoch, whole.state["x"].tolist(), whole.log.count()) == (1, [[2.0]], 5)  # stops before 0.9

    folder, calls = tempfile.mkdtemp(prefix="select-", dir="/tmp"), []

    def lost(s):
        calls.append(int(s["x"][0, 0]))
        if len(calls) == 3:
            raise RuntimeError("lost")
        return score(s)

    with pytest.raises(RuntimeError):  # the state of the third epoch is there, its row is not
        selection.select_model(spark, folder, 3, start, step, lost, patience=3)
    again = selection.select_model(spark, folder, 3, start, step, lost, patience=3)
    assert calls == [1, 2, 3, 3, 4, 5]
    assert sorted(again.log.collect()) == sorted(whole.log.collect()) and again.best_epoch == 1
    done = selection.select_model(spark, folder, 3, start, step, lost, patience=3)
    assert len(calls) == 6 and done.best_epoch == 1  # nothing runs again


def test_epochs_of_the_tagger(spark):
    c, anno, ctx = corpus(spark, 1, 12)
    held, gold, held_ctx = corpus(spark, 2, 6)
    rows = checkpointed(scoring.lr_rows(ctx, c.labels(anno), ["code", "name"], 2, 256))
    truth = checkpointed(held.spans_of(gold).select(*evaluate.SPAN_KEY, F.lit("gold").alias("set")))

    def valid_f1(state):
        model = scoring.LrModel(("code", "name"), 2, state["weights"], ())
        found = spans.decode_spans(scoring.score_with_lr(held_ctx, model)).select(*evaluate.SPAN_KEY, F.lit("pred").alias("set"))
        matches = evaluate.match_sets(truth.unionByName(found))
        return evaluate.macro_page_f1(evaluate.page_prf(matches, held.pages.select("category", "page_id"))).first().macro_f1

    got = selection.select_model(spark, tempfile.mkdtemp(prefix="select-", dir="/tmp"), 0, selection.lr_start(["code", "name"], 256),
                                 selection.lr_step(rows), valid_f1, max_epochs=6, patience=3)
    log = got.log.orderBy("epoch").collect()
    assert [r.epoch for r in log] == list(range(len(log))) and log[-1].train_loss < log[0].train_loss
    assert got.best_epoch is not None and valid_f1(got.state) == max(r.valid_f1 for r in log)
