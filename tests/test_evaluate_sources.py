"""Evaluation, training-log analytics, splits, sources/sinks and the driver contract."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spanweave.config import TextParams
from spanweave.operators import evaluate, splits
from spanweave.plans.extract import evaluate_pages
from spanweave.sources import pages as src
from tests.conftest import SF
from tests.test_pipeline import _anno_df, pages_df


def test_gold_against_itself_scores_one(spark):
    p = TextParams(header_last=-1)
    pages = {1: "abc def\nghi\n", 2: "xyz\n", 3: "nothing here\n"}
    rows = [(1, "a", 0, 0, 0, 3, 0), (1, "b", 1, 0, 1, 2, 1), (2, "a", 0, 1, 0, 3, 2), (3, "a", 0, 0, 0, 0, 3)]
    df = pages_df(spark, pages)
    a = _anno_df(spark, rows)
    prf = {r.page_id: r.f1 for r in evaluate_pages(df, a, a, p).collect()}
    assert prf[1] == 1.0 and prf[2] == 1.0
    assert prf[3] == 0.0  # no gold and no predicted span: 0, still counted
    m = evaluate.macro_page_f1(evaluate_pages(df, a, a, p)).first()
    assert m.n_pages == 3 and abs(m.macro_f1 - 2 / 3) < 1e-12


def test_partial_prediction(spark):
    p = TextParams(header_last=-1)
    pages = {1: "abcdef\n"}
    gold = _anno_df(spark, [(1, "a", 0, 0, 0, 2, 0), (1, "a", 0, 3, 0, 5, 1)])
    pred = _anno_df(spark, [(1, "a", 0, 0, 0, 2, 0), (1, "a", 0, 3, 0, 6, 1)])
    r = evaluate_pages(pages_df(spark, pages), gold, pred, p).first()
    assert (r.tp, r.n_gold, r.n_pred) == (1, 2, 2) and abs(r.f1 - 0.5) < 1e-12


def _log(spark, f1s, run=1):
    return spark.createDataFrame([(run, e, float(v)) for e, v in enumerate(f1s)], "run bigint, epoch int, valid_f1 double")


def test_best_epoch_and_early_stop(spark):
    # F1 always 0: best_epoch stays 0, stops after 10 epochs without improvement
    s = evaluate.run_summary(_log(spark, [0.0] * 30)).first()
    assert (s.best_epoch, s.stop_epoch, s.epochs_run) == (0, 9, 10)
    # improvement at epoch 8, then flat (equal values are no improvement)
    f1 = [0.1] * 8 + [0.2] + [0.2] * 20
    s = evaluate.run_summary(_log(spark, f1)).first()
    assert s.best_epoch == 8 and s.stop_epoch == 18 and abs(s.best_valid_f1 - 0.2) < 1e-12
    # runs out before patience is reached
    s = evaluate.run_summary(_log(spark, [0.1, 0.2, 0.3])).first()
    assert s.stop_epoch is None and s.epochs_run == 3 and s.best_epoch == 2
    b = {r.epoch: r.since_best for r in evaluate.best_epoch(_log(spark, [0.0, 0.5, 0.4])).collect()}
    assert b == {0: 1, 1: 0, 2: 1}


def test_split_sizes_and_determinism(spark):
    ids = spark.range(0, 2400).select(F.when(F.col("id") < 1200, "a").otherwise("b").alias("category"), (F.col("id") % 1200).alias("page_id"))
    s = splits.split_pages(ids, seed=0)
    c = {(r.category, r.tvt): r["count"] for r in s.groupBy("category", "tvt").count().collect()}
    assert c == {(k, t): n for k in "ab" for t, n in (("train", 900), ("valid", 50), ("test", 250))}
    again = splits.split_pages(ids.repartition(7), seed=0)
    assert sorted(s.collect()) == sorted(again.collect())
    other = splits.split_pages(ids, seed=1)
    assert sorted(s.collect()) != sorted(other.collect())


def test_read_pages_from_text_files(spark):
    root = tempfile.mkdtemp(prefix="spanweave-pages-", dir="/tmp")
    os.makedirs(f"{root}/City")
    with open(f"{root}/City/12.txt", "w", encoding="utf-8", newline="") as f:
        f.write("東京 - Wikipedia Dump\r\n本文\r\n")
    with open(f"{root}/City/3.txt", "w", encoding="utf-8") as f:
        f.write("")
    got = {r.page_id: (r.category, r.text) for r in src.read_pages(spark, root).collect()}
    assert got[12] == ("City", "東京 - Wikipedia Dump\r\n本文\r\n")
    # zero-length files are skipped by the file scan: an empty page has no
    # lines, characters or spans, so nothing downstream changes
    assert 3 not in got or got[3][1] == ""
    lines = src.split_lines(src.read_pages(spark, root, "City")).where("page_id = 12").orderBy("line_id").collect()
    assert [r.line for r in lines] == ["東京 - Wikipedia Dump\n", "本文\n"]


def test_annotations_and_predictions_round_trip(spark):
    root = tempfile.mkdtemp(prefix="spanweave-anno-", dir="/tmp")
    path = f"{root}/City_dist.json"
    rows = [
        {"page_id": 1, "title": "東京", "attribute": "人口",
         "text_offset": {"start": {"line_id": 2, "offset": 0}, "end": {"line_id": 2, "offset": 3}, "text": "約1"}},
        {"page_id": 2, "title": "大阪", "attribute": "別名",
         "text_offset": {"start": {"line_id": 0, "offset": 1}, "end": {"line_id": 0, "offset": 2}, "text": "阪"}},
        {"page_id": 1, "title": "東京", "attribute": "人口",
         "text_offset": {"start": {"line_id": 2, "offset": 1}, "end": {"line_id": 2, "offset": 4}, "text": "1400"}},
    ]
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
    a = src.read_annotations(spark, path)
    seq = {(r.page_id, r.text_offset.text): r.anno_seq for r in a.collect()}
    assert seq[(1, "約1")] == 0 and seq[(1, "1400")] == 1 and seq[(2, "阪")] == 0
    out = f"{root}/pred"
    from spanweave.operators.annotate import attribute_index
    assert {r.category for r in a.collect()} == {"City"}
    src.write_predictions(a.withColumn("start_idx", F.col("anno_seq")), attribute_index(a), out, "Shiba", "Char")
    out = f"{out}/out_dir=city_shiba_char"
    back = src.read_predictions(spark, out)
    assert sorted((r.page_id, r.attribute, r.text_offset.text) for r in back.collect()) == \
        sorted((r["page_id"], r["attribute"], r["text_offset"]["text"]) for r in rows)
    raw = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))
    with open(f"{root}/Broken_dist.json", "w", encoding="utf-8") as f:
        f.write("{not json\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        src.read_annotations(spark, f"{root}/Broken_dist.json").collect()
    assert "東京" in raw and '"start":' in raw and raw.index('"start"') < raw.index('"text"') < raw.index('"end"')


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 1000
    assert [f.name for f in df.schema.fields][:3] == ["page_id", "title", "attribute"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    from spanweave.plans import catalog
    own = set(catalog.queries())
    assert own == set(catalog.oracle_sql()) <= set(qs)


@pytest.mark.parametrize("name", ["blank_caret_lines", "blank_file_refs", "blank_fixed_phrases", "blank_urls", "blank_hosts"])
def test_fixture_lines_make_the_rules_fire(spark, name):
    from spanweave.plans import catalog
    from spanweave.sources.fixtures import prefixed_lines
    before = prefixed_lines(src.load_pages(spark, SF)).select("page_id", "line_id", F.col("line").alias("raw"))
    after = catalog.queries()[name](spark, SF)
    assert after.join(before, ["page_id", "line_id"]).where("line != raw").count() > 10


def test_loss_where_probabilities_underflow(spark):
    from spanweave.operators import scoring
    rows = [(0, 0, [0.0, 800.0, 0.0], 0), (0, 0, [1.0, 0.0, 0.0], 0), (1, 0, [1.0, 2.0, 3.0], -1)]
    got = {r.batch_id: r.loss for r in scoring.masked_nll(spark.createDataFrame(rows, "batch_id int, attr_idx int, logits array<double>, label int")).collect()}
    assert abs(got[0] - (800 + 0.5514447139320511) / 4) < 1e-9 and got[1] is None


def test_count_tagger_in_blocks_of_the_model(spark):
    from spanweave.operators import scoring
    kept = spark.createDataFrame([("C", 1, k, 0, k, c, "p") for k, c in enumerate("abcab")],
                                 "category string, page_id bigint, new_char_idx bigint, line_id int, offset int, ch string, ctx_m1 string")
    model = spark.createDataFrame([("C", "x", "p", c, "B") for c in "abd"] + [("D", "x", "p", "c", "B"), ("C", "y", "p", "a", "O")],
                                  "category string, attribute string, prev_ch string, ch string, bio string")
    want = [(0, "a"), (1, "b"), (3, "a"), (4, "b")]
    for most in (100, 1):
        got = scoring.score_with_counts(kept, model, max_broadcast=most).collect()
        assert sorted((r.new_char_idx, r.ch) for r in got) == want


def test_registered_queries_cover_the_smoke_tables(spark):
    from spanweave.plans import catalog
    for name in ("score_pages", "macro_page_f1", "page_annotations", "write_predictions", "reassemble_page"):
        assert catalog.queries()[name](spark, SF).count() > 0, name


def test_output_layout(spark):
    df = pages_df(spark, {1: "x"})
    r = src.output_layout(df, None, "Shiba", "Char").first()
    assert r.out_dir == "c_shiba_char"
    assert df.select(F.lit(1)).count() == 1


def test_invariants_on_driver_tables(spark):
    """Gold against itself: F1 = 1 on every page with a span.  Single-line,
    same-attribute spans separated by a kept O character decode back to
    themselves (restricted to kept characters)."""
    from spanweave.config import fixture_params
    from spanweave.plans.extract import Corpus
    from spanweave.sources.fixtures import fixture_annotations
    from spanweave.sources.pages import load_pages
    p = fixture_params()
    pages = load_pages(spark, SF)
    gold = fixture_annotations(pages)
    prf = evaluate_pages(pages, gold, gold, p).collect()
    assert prf and all(r.f1 == 1.0 for r in prf if r.n_gold > 0)
    # line spans only (the extras are multi-line / overlapping); matches of [0-9]+ never touch
    from spanweave.sources.fixtures import EXTRA_SEQ
    nums = gold.where((F.col("attribute") == "number") & (F.col("anno_seq") < EXTRA_SEQ))
    c = Corpus(pages, p)
    got = {(r.page_id, r.start_line, r.start_offset, r.end_line, r.end_offset, r.text)
           for r in c.spans_of(nums).collect()}
    exp = {(r.page_id, r.text_offset.start.line_id, r.text_offset.start.offset,
            r.text_offset.end.line_id, r.text_offset.end.offset, r.text_offset.text)
           for r in nums.withColumn("_l", F.col("text_offset.start.line_id"))
                        .join(c.lines.where("in_body").select("page_id", F.col("line_id").alias("_l"), "line"),
                              ["page_id", "_l"])
                        # spans are defined on raw lines: keep those the cleaning left intact
                        .where(F.substring("line", F.col("text_offset.start.offset") + 1,
                                           F.length("text_offset.text")) == F.col("text_offset.text"))
                        .collect()}
    assert got == exp


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from spanweave import session
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)})), "master": "spark://host:7077"})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster)
