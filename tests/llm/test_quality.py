"""Risk-controlled rules and importance resampling."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import importance, risk_rules
from tests.llm.data import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)} if len(w) < 500 else None
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, None if inside is None else len(inside)


def test_text_stats_match_brute_force():
    rng = random.Random(3)
    texts = [r[1] for r in awkward()] + ["a b c d e f g h a b c d e f g h i", "x\nx\n\n\n x\nx", "**# 日本 <b>|"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    for text in texts:
        got, want = risk_rules.text_stats(text)[:5], brute_stats(text)
        assert got[:4] == want[:4] and want[4] in (None, got[4])


def test_binomial_bound_is_exact():
    for n, k, p in ((10, 3, 0.2), (200, 0, 0.01), (500, 20, 0.05)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert risk_rules.binomial_cdf(k, n, p) == pytest.approx(want)
    u = risk_rules.upper_bound(3, 100, 0.05)
    assert risk_rules.binomial_cdf(3, 100, u) == pytest.approx(0.05) and u > 0.03


def test_cutoffs_keep_their_promise():
    """Cutoffs fitted on holdouts reject more than alpha of the good population in at most delta of the trials."""
    rng = np.random.default_rng(0)
    steps = np.arange(risk_rules.STEPS + 1)
    good_p = np.exp(-steps / 12.0)
    good_p /= good_p.sum()
    bad_p = np.roll(good_p[::-1], -40)
    broken = 0
    for _ in range(200):
        cutoff, _, _ = risk_rules.certified_cutoff(rng.multinomial(800, good_p), rng.multinomial(200, bad_p), 0.05, 0.1)
        broken += cutoff is not None and good_p[cutoff:].sum() > 0.05
    assert broken <= 0.1 * 200
    assert risk_rules.certified_cutoff(np.zeros(201, int), np.ones(201, int), 0.05, 0.1)[0] is None


def test_verdicts(spark):
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    got = risk_rules.judge_quality(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines)) for r in got) == sorted(str((x[0], *brute_stats(x[1])[:4])) for x in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed and not r.rejected_by) for r in got)
    none = risk_rules.judge_quality(documents(spark, rows), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert risk_rules.judge_quality(documents(spark, []), labels).count() == 0


def test_junk_goes_and_good_documents_stay(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        rows.append((i, " ".join(word() + ("$$$" if bad else "") for _ in range(40)), "en" if i % 2 else "de", "s", 0, "", "", ""))
        labels.append((i, 0 if bad else 1))
    got = risk_rules.judge_quality(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), alpha=0.2).collect()
    assert all(not r.kept for r in got if r.doc_id % 3 == 0)
    assert sum(not r.kept for r in got if r.doc_id % 3) <= 0.2 * 1000


def test_gumbel_top_k_matches_a_sort(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    everything = importance.resample(docs, labels, k=10**6).toPandas().sort_values("gumbel_score", ascending=False)
    assert len(everything) == docs.count()
    for k in (0, 1, 37):
        got = importance.resample(docs, labels, k=k).toPandas()
        assert set(got.doc_id) == set(everything.doc_id[:k]) and len(got) == k


def test_weights_match_counted_ngrams(spark):
    rows = [(1, "a b a", 1), (2, "a b", 0), (3, "c", 0), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    ratios = importance.log_ratios(docs.select((F.col("good") == 1).alias("target"), "text"), 4096)
    got = {r.doc_id: r.log_weight for r in importance.weigh(docs, ratios, ("doc_id",)).collect()}
    raw, target = {"a": 3, "b": 2, "c": 1, "ab": 2, "ba": 1}, {"a": 2, "b": 1, "ab": 1, "ba": 1}
    lr = {g: math.log((target.get(g, 0) + 1) / (5 + 4096)) - math.log((n + 1) / (9 + 4096)) for g, n in raw.items()}
    assert got[1] == pytest.approx(2 * lr["a"] + lr["b"] + lr["ab"] + lr["ba"])
    assert got[2] == pytest.approx(lr["a"] + lr["b"] + lr["ab"]) and got[4] == 0


def test_resampling_takes_awkward_rows(spark):
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2, 0 if i % 3 else None) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.resample(documents(spark, rows), labels, k=10).count() == 10
    tied = documents(spark, rows[:1] * 50)
    assert importance.resample(tied, labels, k=17).count() == 17
    assert importance.resample(documents(spark, []), labels).count() == 0
    assert importance.resample(documents(spark, rows), labels.limit(0)).count() == 0
