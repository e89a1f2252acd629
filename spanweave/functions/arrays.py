"""Array expressions (higher-order functions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**31 elements is more than any Spark array can hold.
_SCAN_STEPS = 31


def prefix_sum(arr: Column) -> Column:
    """Inclusive running sum of an integer array, O(n log n), in one expression.

    Doubling scan: pass ``s`` adds the element ``d = 2**s`` places to the left.
    Passes past the array length return the accumulator unchanged, so short
    arrays cost a few passes only.  Keeps per-page running indices inside the
    page row, with no window and no shuffle.
    """

    def step(acc: Column, d: Column) -> Column:
        shifted = F.transform(
            acc, lambda x, i: x + F.when(i >= d, F.get(acc, i - d)).otherwise(F.lit(0).cast("bigint"))
        )
        return F.when(d < F.size(acc), shifted).otherwise(acc)

    start = F.transform(arr, lambda x: x.cast("bigint"))
    distances = F.array(*[F.lit(1 << s) for s in range(_SCAN_STEPS)])
    return F.aggregate(distances, start, step)


def softmax(logits: Column) -> Column:
    """Max-subtracted softmax of an array<double>."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / total)


def argmax(arr: Column) -> Column:
    """0-based index of the largest element; ties → first."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
