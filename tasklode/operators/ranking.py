"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.session import cut

#: Bits of ``monotonically_increasing_id`` that count within a partition.
_WITHIN = (1 << 33) - 1


def dealt(rows: DataFrame, order: list, part: str, place: str) -> DataFrame:
    """``rows`` with the number of their range of ``order`` and their place in it, from 0.

    Rows are dealt by sampled ranges of all columns of the order, so ties in the first don't gather. The
    result is a checkpoint: ranges are sampled anew in another run of the plan.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(sorted_.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))}))


def sums_before(counts: DataFrame, part: str, n: str, base: str) -> DataFrame:
    """``counts`` (one row a range) with what all ranges before it sum up to."""
    before = F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn(base, F.coalesce(before, F.lit(0)))


def places_within(rows: DataFrame, by: str, order: list[str | Column], at: str = "at") -> DataFrame:
    """``rows`` with their place in the order of their group, from 0 (long): places in the order of (group, order) less the group's first.

    No task holds a group. Groups meet their rows again in a join that adaptive execution can split. A null group is a group.
    """
    whole, first, key = free(rows, [at], wanted=["whole", "first", "key"])
    placed = positions(rows, [by, *order], whole)
    starts = placed.groupBy(F.col(by).alias(key)).agg(F.min(whole).alias(first))
    return placed.join(starts, F.col(by).eqNullSafe(F.col(key))).withColumn(at, F.col(whole) - F.col(first)).drop(whole, first, key)


def positions(rows: DataFrame, order: list[str | Column], at: str = "at") -> DataFrame:
    """``rows`` with their place in the whole order, from 0 (long). Rows equal in the order take any places among them."""
    part, place, n, base = free(rows, [at], wanted=["part", "place", "n", "base"])
    told = dealt(rows, [F.col(o) if isinstance(o, str) else o for o in order], part, place)
    before = sums_before(told.groupBy(part).agg(F.count("*").alias(n)), part, n, base).select(part, base)
    return told.join(F.broadcast(before), part).withColumn(at, F.col(base) + F.col(place)).drop(part, place, base)
