"""Histograms, length and price summaries, top lists and missing-field counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.stats import linear, nearest_rank
from tasklode.functions.text import col
from tasklode.operators.ranking import dealt

MISSING = "<missing>"


def histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n): null or empty counts as ``<missing>``."""
    return df.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(MISSING)).alias(key)).agg(F.count("*").alias("n"))


def linear_summary(x: Column | str, empty_as_zero: bool = False) -> list[Column]:
    """Aggregates: count, min, p50, p90, p95, p99 (interpolated), max and mean; nulls of nothing, or 0.0 each."""
    x = col(x).cast("double")
    named = {"min": F.min(x), "p50": linear(x, 0.5), "p90": linear(x, 0.9), "p95": linear(x, 0.95), "p99": linear(x, 0.99), "max": F.max(x), "mean": F.avg(x)}
    values = [(F.coalesce(v, F.lit(0.0)) if empty_as_zero else v).alias(k) for k, v in named.items()]
    return [F.count(x).alias("count"), *values]


def nearest_summary(x: Column | str) -> list[Column]:
    """Aggregates: mean, p50, p90, p95 (nearest rank, half to even) and max."""
    x = col(x).cast("double")
    return [F.avg(x).alias("mean"), nearest_rank(x, 0.5).alias("p50"), nearest_rank(x, 0.9).alias("p90"), nearest_rank(x, 0.95).alias("p95"), F.max(x).alias("max")]


def nearest_ranks(df: DataFrame, by: str | list[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, names of ``quantiles``): sorted values at index round-half-even((n - 1) q), nulls left out.

    Equal values are counted before the shuffle and dealt to sampled ranges, so no task holds a group.
    """
    return _nearest(df, [by] if isinstance(by, str) else by, x, quantiles, {})


def nearest_summaries(df: DataFrame, by: str | list[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, n, sum, mean, max, names of ``quantiles``) of groups, as ``nearest_ranks``, all from one count of equal values: ``df`` is read once. Sums are doubles."""
    times = F.col("v").cast("double") * F.col("n")
    sums = {"n": F.sum("n"), "sum": F.sum(times), "mean": F.sum(times) / F.sum("n"), "max": F.max("v")}
    return _nearest(df, [by] if isinstance(by, str) else by, x, quantiles, sums)


def _nearest(df: DataFrame, by: list[str], x: str, quantiles: dict[str, float], more: dict[str, Column]) -> DataFrame:
    """(by, names of ``more``, names of ``quantiles``): the quantiles and further aggregates of counted values (v, n)."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(x).alias("v")).agg(F.count("*").alias("n"))

    def at(q: float) -> Column:
        place = F.bround((F.col("total") - 1).cast("double") * q, 0).cast("long")
        return F.max(F.when((place < F.col("to")) & (place >= F.col("to") - F.col("n")), F.col("v")))

    told = _ranked(counts).groupBy("g").agg(*(c.alias(k) for k, c in more.items()), *(at(q).alias(name) for name, q in quantiles.items()))
    return told.select("g.*", *more, *quantiles)


def _ranked(counts: DataFrame) -> DataFrame:
    """``counts`` (g, v, n: counted values of groups) with total, the group's sum of n, and ``to``, its sum up to the value."""
    told = dealt(counts, [F.col("g"), F.col("v")], "part", "place")
    own = Window.partitionBy("g")
    parts = told.groupBy("g", "part").agg(F.sum("n").alias("s"))
    parts = parts.select("g", "part", F.sum("s").over(own).alias("total"), F.coalesce(F.sum("s").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("n").over(Window.partitionBy("part", "g").orderBy("place"))
    placed, of = told.withColumn("upto", upto).alias("a"), parts.withColumnRenamed("g", "own").alias("b")
    same = (F.col("a.part") == F.col("b.part")) & F.col("a.g").eqNullSafe(F.col("b.own"))
    return placed.join(of, same).select("g", "v", "n", "total", (F.col("base") + F.col("upto")).alias("to"))


def threshold_counts(x: Column | str, thresholds: list[int]) -> list[Column]:
    """Aggregates: how many values are over each threshold."""
    return [F.count_if(col(x) > t).alias(f"over_{t}") for t in thresholds]


def most_common(df: DataFrame, key: str, limit: int, first_seen: str | None = None) -> DataFrame:
    """(key, n): the most frequent, ties by what was seen first (or by key). Counting is combined before the shuffle."""
    order = F.min(first_seen) if first_seen else F.min(key)
    return df.groupBy(key).agg(F.count("*").alias("n"), order.alias("__first")).orderBy(F.desc("n"), "__first", key).limit(limit).select(key, "n")


def longest(df: DataFrame, size: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(size), F.asc(tie)).limit(limit)


def missing_fields(df: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates: rows whose column is null or empty."""
    return [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in columns]


def profile(df: DataFrame, view: str, lengths: dict[str, Column], numbers: dict[str, Column]) -> DataFrame:
    """One long table (view, measure, count, min, p50, ..., mean) of several views in one pass."""
    measures = {**{k: F.char_length(v) for k, v in lengths.items()}, **numbers}
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()))
    return df.select(F.col(view), F.explode(pairs).alias("m")).groupBy(view, F.col("m.measure").alias("measure")).agg(*linear_summary("m.value"))


def ranked_summaries(rows: DataFrame, by: str, x: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(by, count, min, p50, ..., max, mean) of the values ``x`` (double, nulls left out) of each group, with interpolated quantiles.

    As ``linear_summary``, for groups of any number of distinct values: equal values are counted, the counts are dealt to
    sampled ranges, and each quantile is read off the two places that it lies between. No task holds a group.
    """
    counts = rows.filter(F.col(x).isNotNull()).groupBy(F.col(by).alias("g"), F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranked = _ranked(counts)

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("to")) & (place >= F.col("to") - F.col("n")), F.col("v")))

    where = {q: (F.col("total") - 1).cast("double") * q for q in quantiles}
    ends = [c for k, p in enumerate(where.values()) for c in (at(F.floor(p)).alias(f"low{k}"), at(F.ceil(p)).alias(f"high{k}"), F.max(p - F.floor(p)).alias(f"part{k}"))]
    found = ranked.groupBy("g").agg(F.sum("n").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), *ends)
    between = [(F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * F.col(f"part{k}")).alias(f"p{round(q * 100)}") for k, q in enumerate(quantiles)]
    return found.select(F.col("g").alias(by), "count", "min", *between, "max", "mean")
