"""Quality rules with risk-controlled thresholds.

Text statistics are taken in one pass over the documents.  For every rule and
stratum the labelled documents are the holdout: cutoffs are tested from the
loosest to the tightest, each with the exact binomial test of "more than
``alpha`` of the good documents are rejected" (the Clopper-Pearson bound read as
a p-value), until the first one fails.  The level ``delta`` is divided by the
number of rules and strata (Bonferroni), and fixed-sequence testing needs no
further correction within a sequence; ``alpha`` is divided by the number of
rules, so that all rules together reject at most ``alpha`` of the good documents
of each stratum, with probability 1 - ``delta`` over the holdout.  Of the
certified cutoffs, the one that separates the labelled classes best is used; a
rule that separates nothing, or a stratum with too few labels, rejects nothing.

Statistics stay in the row (no shuffle of text).  The holdout is reduced to
counts per (stratum, rule, cutoff step), combined map-side, before any test.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct_words long, n_upper long"
STAT_NAMES = [s.split()[0] for s in STATS.split(", ")]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled = rolled * _MULTIPLIER + h[j:j + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(rolled, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of ``STATS`` for one text; all 0 for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits on exactly the six space bytes of the contract
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return (len(words), len(raw.translate(None, _SPACES + _CONTINUATION)), len(raw) - len(raw.translate(None, SYMBOLS)), duplicates,
            repeated_words(words), lines, len(set(words)), len(raw) - len(raw.translate(None, _UPPER)))


def with_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` and the text statistics; the text itself goes no further unless it is kept."""
    cols = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema[:-1]] + [STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_stats(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(STAT_NAMES))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(found[:, j]) for j in range(len(STAT_NAMES))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *STAT_NAMES])

    return cols.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: rule → (badness in [0, 1] of a document, number of cutoff steps).  A rule with
#: cutoff step c rejects documents whose badness is at least c / steps.
STEPS = 200


def badness() -> dict[str, Column]:
    per_word = lambda c, most: F.least(F.col(c) / F.greatest(F.col("n_words"), F.lit(1)) / most, F.lit(1.0))
    return {
        "symbols": per_word("n_symbols", 4.0),
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": per_word("n_repeat_words", 1.0),
        "few_distinct": F.lit(1.0) - F.col("n_distinct_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "capitals": F.least(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0)),
        "long_words": F.least(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) / 20.0, F.lit(1.0)),
    }


@functools.lru_cache(maxsize=4)
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by summing exact terms in log space."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_factorial = _log_factorials(n)
    terms = log_factorial[n] - log_factorial[i] - log_factorial[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n has probability ``delta``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def certified_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> tuple[int | None, int, float]:
    """good, bad: documents by step 0..STEPS → (cutoff step or None, good rejected, upper bound of the rate).

    Fixed-sequence testing from step STEPS down; a step passes when at the rate
    ``alpha`` so few rejections have probability ``delta`` or less.
    """
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best: tuple[float, int, int] | None = None
    if not n_good or not n_bad:
        return None, 0, 1.0
    for step in range(STEPS, 0, -1):
        k = int(good[step:].sum())
        if binomial_cdf(k, n_good, alpha) > delta:
            break
        gain = bad[step:].sum() / n_bad - 3 * k / n_good
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, step, k)
    if best is None:
        return None, 0, 1.0
    return best[1], best[2], upper_bound(best[2], n_good, delta)


CUTOFFS = "stratum string, rule string, cutoff int, n_good long, n_bad long, good_rejected long, bound double"


def fit_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs per stratum and rule: ``CUTOFFS``.

    labels(id, quality): a document is good when all its labels say quality 1, bad
    when none does, else it is left out of the holdout.
    """
    rules = badness()
    marks = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi").select("_id", (F.col("lo") > 0).alias("good"))
    # Only the labelled documents matter here; both sides are exchanged, so a repeated id can be split.
    held = stats.join(materialize(marks, "risk-labels"), F.col(id_col) == F.col("_id"))
    steps = F.array(*[F.struct(F.lit(name).alias("rule"), F.floor(v * STEPS).cast("int").alias("step")) for name, v in rules.items()])
    counts = held.select(F.col(stratum_col).cast("string").alias("stratum"), "good", F.explode(steps).alias("r")).groupBy(
        "stratum", F.col("r.rule").alias("rule"), F.col("r.step").alias("step")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    n_strata = counts.select("stratum").distinct().count()
    a, d = alpha / len(rules), delta / max(1, n_strata * len(rules))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
        at = group["step"].clip(0, STEPS).to_numpy()
        np.add.at(good, at, group["good"].to_numpy())
        np.add.at(bad, at, group["bad"].to_numpy())
        cutoff, k, bound = certified_cutoff(good, bad, a, d)
        return pd.DataFrame({"stratum": [group["stratum"].iloc[0]], "rule": [group["rule"].iloc[0]], "cutoff": pd.array([cutoff], "Int32"),
                             "n_good": [int(good.sum())], "n_bad": [int(bad.sum())], "good_rejected": [k], "bound": [bound]})

    return counts.groupBy("stratum", "rule").applyInPandas(choose, CUTOFFS)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                  alpha: float = 0.03, delta: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, stratum, statistics, base_failed, rejected_by, kept.

    ``kept`` is false when the base rules fail, else when a certified cutoff of the
    document's stratum rejects it.

    Defined results: a null text has no words and fails the base rules; null strata
    are one stratum; a document without a label is judged by its stratum's cutoffs;
    a null id has no label; repeated rows are judged each and, if labelled, count
    each; empty labels certify nothing, so only the base rules reject; an empty
    table gives no rows.  Columns not named (or in ``keep``) are dropped.
    """
    stats = with_stats(docs.select(F.col(id_col), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("_t"), *keep), "_t",
                       (id_col, "stratum", *keep))
    stats = materialize(stats, "risk-stats")
    cutoffs = materialize(fit_cutoffs(stats, labels, id_col, "stratum", alpha, delta).where("cutoff is not null"), "risk-cutoffs")
    wide = materialize(cutoffs.groupBy(F.col("stratum").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "risk-wide")
    hit = [F.when(F.floor(v * STEPS) >= F.col("cutoffs")[name], F.lit(name)) for name, v in badness().items()]
    judged = stats.join(wide, F.col("stratum").eqNullSafe(F.col("_s")), "left").withColumn("base_failed", base_failed()).withColumn(
        "rejected_by", F.array_compact(F.array(*hit)))
    return judged.select(id_col, "stratum", *keep, *STAT_NAMES, "base_failed", "rejected_by",
                         (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))
