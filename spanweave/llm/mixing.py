"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / weight, u a hash of the
document, so a rerun draws the same keys.  A source's target is met by complete
epochs first; what is left is filled with documents in key order, prefix-summed
to the budget.

The prefix sum never sorts a whole source (``selection.within_budget``), so a
source holding a third of all rows costs one more aggregate row per task, not a
third of the sort.  Texts are read once, for sizes and keys; everything after
works on narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count
from .selection import within_budget

SYMBOLS = "#*$%&|<>"


def symbol_weight(text: Column, size: Column) -> Column:
    """Quality weight in [0.1, 1]: falls with the number of symbols per word."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.greatest(F.lit(0.1), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """52 bits of a hash of the document as a number in (0, 1)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """sizes(source, source_size, …) + target.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    the sum of all sizes.  A target stops at ``max_epochs`` times the source's
    size and the excess is shared again by weight: in order of cap / weight, a
    source is capped when its cap is not above its share of what is left.  One
    row per source is ordered here, no documents.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(one) - 1, len(weights)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "left_size": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("level", F.col("left_size") / F.col("left_w")).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.struct(F.col("left_w"), F.col("level")))).over(everything)["level"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level)).drop(
        "w", "cap", "left_size", "left_w", "level", "capped")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words, ``taken`` = copies × size.  A source's taken
    words differ from its target by at most half the size of one document.
    ``quality`` (a column over ``docs``, positive) scales the keys; by default the
    weight falls with symbols per word.

    Defined results: a null text has size 0 and is never taken; null sources form
    one source, last in order; a null or non-positive weight counts as 1e-6;
    repeated rows are separate documents, told apart by their place in the input;
    an empty table gives no rows; columns other than the three named are ignored.
    """
    size = word_count(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                       uniform(seed, F.col(id_col), F.col(text_col)).alias("u"),
                       (symbol_weight(F.col(text_col), size) if quality is None else quality).alias("weight"),
                       F.monotonically_increasing_id().alias("row_no"))
    base = base.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1e-6)), F.lit(1e-6)))
    base = materialize(base.withColumn("key", -F.log("u") / F.col("weight")), "mix-keys")

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("weight").alias("rate"))
    plan = source_targets(sizes, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    plan = plan.withColumn("epochs", epochs).withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")

    # A key's place among its source's keys, about evenly spread over [0, 1).
    named = plan.select(F.col("source").alias("_s"), "rate", "source_size", "target", "epochs")
    place = F.least(F.lit(1.0) - F.exp(-F.col("key") * F.col("rate")), F.lit(1 - 1e-9))
    rows = base.join(named, F.col("source").eqNullSafe(F.col("_s"))).withColumn("place", place).drop("_s")
    out = within_budget(rows, plan.select("source", "room"))
    return out.withColumn("copies", F.col("epochs").cast("long") + F.col("within").cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sql(weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 0, docs: str = "documents") -> str:
    """DuckDB statement of the query on ``docs``: one window per source over keys, shares by repeated capping."""
    values = ", ".join(str(float(x)) for x in weights)
    return f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, text FROM {docs}),
    k AS (
      SELECT doc_id, source, size,
        -ln((('0x' || substr(md5(concat('{seed}|', coalesce(doc_id::VARCHAR, 'null'), '|', coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
        / greatest(0.1, 1.0 - coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0)::DOUBLE / greatest(size, 1)) AS key
      FROM d),
    s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
    ranked AS (SELECT *, list_extract([{values}], 1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)})::INT) AS w FROM s),
    fill(round, source, source_size, w, capped) AS (
      SELECT 0, source, source_size, w, false FROM ranked
      UNION ALL
      SELECT round + 1, source, source_size, w,
        capped OR {float(max_epochs)} * source_size <= w * (sum(source_size) OVER () - coalesce(sum({float(max_epochs)} * source_size) FILTER (capped) OVER (), 0))
                                              / sum(w) FILTER (NOT capped) OVER ()
      FROM fill WHERE round < (SELECT count(*) FROM s)),
    targets AS (
      SELECT source, source_size,
        CASE WHEN capped THEN {float(max_epochs)} * source_size
             ELSE w * ((sum(source_size) OVER () - coalesce(sum({float(max_epochs)} * source_size) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER ()) END AS target
      FROM fill WHERE round = (SELECT count(*) FROM s)),
    r AS (
      SELECT k.doc_id, k.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least({max_epochs}, floor(t.target / t.source_size)) ELSE 0 END AS epochs,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size::BIGINT AS source_size, target,
      (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM r"""
