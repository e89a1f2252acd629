"""Global order without a one-task window: running sums, ranks and batches.

Rows are dealt out by ranges of the order and written once; each range sums up
its own rows, and what the ranges before hold is added from a table with one row
per range.  No task sees more than a range; ties must be broken by the order
itself, since equal rows stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.session import checkpointed

_RANGE, _BEFORE = "__range", "__before"


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` + ``name``: the sum of ``value`` over all rows before this one in ``order`` (0 for the first)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn(_RANGE, F.spark_partition_id()))
    sums = ranged.groupBy(_RANGE).agg(F.sum(value).alias("s"))  # one row per range
    before = sums.select(F.col(_RANGE), F.coalesce(F.sum("s").over(Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(_BEFORE))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, own).join(F.broadcast(before), _RANGE).withColumn(name, (F.col(name) + F.col(_BEFORE)).cast("long")).drop(_RANGE, _BEFORE)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` + ``name``: the number of rows before this one in ``order``, from 0 without gaps."""
    return running_sum(df, order, F.lit(1), name)
