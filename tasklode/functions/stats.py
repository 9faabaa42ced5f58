"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklode.functions.text import col

#: The 97.5 % quantile of the normal distribution.
Z = 1.959963984540054


def nearest_rank(x: Column | str, q: float) -> Column:
    """Aggregate: the sorted value at index round-half-even((n - 1) q); null of nothing.

    A group's values are collected, so this is for small groups; ``profiling.nearest_ranks`` is for any.
    """
    values = F.sort_array(F.collect_list(col(x)))
    at = F.bround((F.count(col(x)) - 1).cast("double") * q, 0).cast("int") + 1
    return F.try_element_at(values, at)


def linear(x: Column | str, q: float) -> Column:
    """Aggregate: linear interpolation at (n - 1) q."""
    return F.percentile(col(x), F.lit(q))


def wilson(k: Column | str, n: Column | str) -> Column:
    """struct<rate, low, high> of k successes in n; nulls for n = 0."""
    n_ = F.nullif(col(n).cast("double"), F.lit(0.0))
    p = col(k).cast("double") / n_
    z2 = Z * Z
    middle = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = Z * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    none = F.lit(None).cast("double")
    return F.struct(
        p.alias("rate"),
        F.when(n_.isNull(), none).otherwise(F.greatest(F.lit(0.0), middle - half)).alias("low"),
        F.when(n_.isNull(), none).otherwise(F.least(F.lit(1.0), middle + half)).alias("high"),
    )


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null if b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def total_if_complete(x: Column | str) -> Column:
    """Aggregate: the sum, only if no value is null and there is one."""
    return F.when((F.count(col(x)) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(col(x)))


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))
