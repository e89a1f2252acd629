"""Fill budgets in key order without sorting a whole group.

Per group (``source``), sizes are summed in 1024 buckets of the key's place, the
bucket in which the budget ends is summed in 1024 parts again, and only the keys
of one such part are put in order.  Every sum is combined map-side, so a group
that holds a third of all rows costs one more aggregate row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1024


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _boundary(rows: DataFrame, by: str, budget: DataFrame) -> DataFrame:
    """The value of ``by`` in which each source's budget ends, and the sum of all sizes before it.

    budget(source, room, before); rows(source, ``by``, size) are those still in question.
    """
    sums = rows.groupBy("source", by).agg(F.sum("size").alias("s"))
    w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.join(budget.withColumnRenamed("source", "_s"), _same("source", "_s")).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("s").over(w), F.lit(0)))
    last = F.max(F.struct(F.col(by), F.col("start")))
    return materialize(run.where("start < room").groupBy("source").agg(last.alias("m"), F.first("room").alias("room")).select(
        "source", F.col(f"m.{by}").alias(by), "room", F.col("m.start").alias("before")), "budget-edge")


def within_budget(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """rows(source, size, key, place, row_no, …) + within: the row is taken when its source is filled in key order.

    budget(source, room) names what each source may take.  A row is taken when at
    least half of it fits, so a source misses its budget by at most half a row.
    ``place`` in [0, 1) rises with ``key`` and spreads the keys; ``row_no`` comes
    from ``monotonically_increasing_id`` and tells equal keys apart, which are
    counted per input partition.  ``rows`` must be materialized.
    """
    keyed = rows.select("source", "size", "key", F.floor(F.col("place") * BUCKETS).alias("b1"), F.floor(F.col("place") * BUCKETS * BUCKETS).alias("b2"))
    edge = _boundary(keyed, "b1", budget.where("room > 0").select("source", "room", F.lit(0).cast("long").alias("before")))

    def inside(by: str) -> DataFrame:
        here = edge.select(F.col("source").alias("_s"), F.col(by).alias("_b"))
        return keyed.join(here, _same("source", "_s") & (F.col(by) == F.col("_b"))).drop("_s", "_b")

    edge = _boundary(inside("b1"), "b2", edge.select("source", "room", "before"))
    edge = _boundary(inside("b2"), "key", edge.select("source", "room", "before"))
    edge = edge.select(F.col("source").alias("_s"), F.col("key").alias("edge_key"), F.col("room").alias("_room"), F.col("before").alias("_before"))

    at_edge = rows.select("source", "size", "key", "row_no").join(edge, _same("source", "_s") & (F.col("key") == F.col("edge_key"))).drop("_s").withColumn(
        "part", F.shiftright("row_no", 33))
    parts = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = at_edge.groupBy("source", "part").agg(F.count("*").alias("n")).select(
        F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("offset"))
    numbered = at_edge.withColumn("i", F.row_number().over(Window.partitionBy("source", "part").orderBy("row_no"))).join(
        offset, _same("source", "_s") & (F.col("part") == F.col("_p")))
    fits = materialize(numbered.where(F.col("_before") + (F.col("offset") + F.col("i") - 0.5) * F.col("size") <= F.col("_room"))
                       .select(F.col("row_no").alias("_r")), "budget-ties")
    out = rows.join(edge.select("_s", "edge_key"), _same("source", "_s"), "left").join(fits, F.col("row_no") == F.col("_r"), "left")
    return out.withColumn("within", F.coalesce(F.col("key") < F.col("edge_key"), F.lit(False)) | F.col("_r").isNotNull()).drop("_s", "edge_key", "_r")
