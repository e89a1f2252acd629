"""Quality by importance resampling over hashed n-grams.

Words and word pairs of a text are hashed into 65,536 buckets.  Two generative
models, bucket frequencies of the target texts and of all texts, give each
document the log ratio of its probabilities as importance weight, and Gumbel
top-k (weight plus Gumbel noise, the k largest) samples k documents without
replacement in proportion to the weights.

The models are two vectors of 65,536 sums, the only thing that leaves the tasks;
texts are not shuffled.  The target ids are a bounded sample of the labelled
documents (``max_target``), so they may be broadcast.  The cut at k is found by
counting, not by a global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .mixing import uniform
from .selection import within_budget
from .tokens import batch_words, mix

BUCKETS = 1 << 16
MAX_TARGET = 50_000


def _features(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the text) of the words and of the pairs of neighbouring words."""
    last_hash, last_doc = np.uint64(0), -1
    for h, _, doc, _ in batch_words(texts):
        if not len(h):
            continue
        before = np.concatenate([[last_hash], h[:-1]])
        joined = np.concatenate([[last_doc], doc[:-1]]) == doc
        with np.errstate(over="ignore"):
            pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + h)[joined]
        last_hash, last_doc = h[-1], doc[-1]
        yield (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[joined]])


def target_ids(labels: DataFrame, id_col: str = "doc_id", max_target: int = MAX_TARGET) -> DataFrame:
    """Ids of good documents (every label quality 1 and toxic 0), at most ``max_target``, chosen by hash."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    return good.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_target)


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """docs(target, text) → log p_target - log p_raw per bucket, add-one smoothed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            wanted = np.array(batch.column(0).to_pylist(), bool)
            for bucket, doc in _features(batch.column(1).to_pylist(), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = docs.select("target", "text").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most ``buckets`` rows
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in sums:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` + log_weight, the sum of the log ratios of the text's n-grams (0 for a text without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    cols = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema[:-1]] + ["log_weight double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio, total = shared.value, np.zeros(batch.num_rows)
            for bucket, doc in _features(batch.column(batch.num_columns - 1).to_pylist(), len(ratio)):
                total += np.bincount(doc, weights=ratio[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=[*batch.schema.names[:-1], "log_weight"])

    return cols.mapInArrow(run, schema)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0,
             buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> DataFrame:
    """The k sampled documents: id, log_weight, gumbel_score.

    ``k`` defaults to the share of good documents among the labelled ones times
    the number of documents.  The noise is drawn from a hash of id and text, so
    reruns agree.

    Defined results: a null or text without words has weight 0; a null id is never
    a target; repeated rows share their noise and may all be sampled; without
    labels the target model is flat and k is 0 unless given; k above the number of
    documents takes them all; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ids = materialize(target_ids(labels, id_col, max_target), "importance-target")
    marked = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left")  # max_target ids
    ratios = log_ratios(marked.select(F.col("_id").isNotNull().alias("target"), "text"), buckets)

    u = uniform(seed, F.col(id_col), F.col(text_col))
    noisy = docs.select(F.col(id_col).alias("doc_id"), (-F.log(-F.log(u))).alias("gumbel"), F.col(text_col).alias("text"))
    scored = weigh(noisy, ratios, ("doc_id", "gumbel")).select(
        "doc_id", "log_weight", (F.col("log_weight") + F.col("gumbel")).alias("gumbel_score"), F.monotonically_increasing_id().alias("row_no"))
    scored = materialize(scored, "importance-scores")
    span = scored.agg(F.min("gumbel_score").alias("lo"), F.max("gumbel_score").alias("hi"), F.count("*").alias("n")).first()
    if not span.n:
        return scored.drop("row_no")
    if k is None:
        by_id = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        share = by_id.agg(F.avg(F.expr("cast(q = 1 and coalesce(t, 0) = 0 as int)"))).first()[0] or 0.0
        k = round(share * span.n)
    # Scores reach far on both sides of most of them; the arc tangent spreads their places.
    mid = scored.agg(F.percentile_approx("gumbel_score", [0.25, 0.5, 0.75], 1000)).first()[0]
    width = max(mid[2] - mid[0], 1e-9)
    place = F.lit(0.5) - F.atan((F.col("gumbel_score") - mid[1]) / width) / 3.1415927
    rows = scored.select("*", F.lit(0).alias("source"), F.lit(1).cast("long").alias("size"), (-F.col("gumbel_score")).alias("key"),
                         F.greatest(F.lit(0.0), F.least(place, F.lit(1 - 1e-9))).alias("place"))
    budget = spark.range(1).select(F.lit(0).alias("source"), F.lit(float(k)).alias("room"))
    return within_budget(rows, budget).where("within").select("doc_id", "log_weight", "gumbel_score")
