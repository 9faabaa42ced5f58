"""Strata, largest-remainder allocation, hash-ranked samples, schedules and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.hashing import salted
from tasklode.functions.names import free
from tasklode.functions.text import col
from tasklode.operators.ranking import places_within, positions

MISSING = "<missing>"


def stratum_of(*parts: Column | str) -> Column:
    """The parts joined by a bar; null or empty is ``<missing>``."""
    return F.concat_ws("|", *(F.coalesce(F.nullif(col(p).cast("string"), F.lit("")), F.lit(MISSING)) for p in parts))


def domain_of(domain_zh: Column | str, domain: Column | str) -> Column:
    """The first that is there, even if empty; then ``<missing>`` for null or empty."""
    return F.coalesce(F.nullif(F.when(col(domain_zh).isNotNull(), col(domain_zh)).otherwise(col(domain)), F.lit("")), F.lit(MISSING))


def largest_remainder(counts: DataFrame, target: int, key: str = "stratum", size: str = "n", capped: bool = True) -> DataFrame:
    """``counts`` with quota: target shared out in proportion, the rest to the largest remainders, ties by key.

    One row per stratum reaches the ranking window, not one per item. ``capped`` refuses a target
    over the pool (checked where the plan runs); without it quotas may exceed the sizes.
    """
    every = Window.partitionBy(F.lit(0))
    total = F.sum(size).over(every)
    if capped:
        total = F.when(total >= target, total).otherwise(F.raise_error(F.lit(f"target {target} exceeds the pool")).cast("long"))
    raw = F.lit(float(target)) * F.col(size) / total
    floors = counts.withColumn("__raw", raw).withColumn("__floor", F.floor("__raw"))
    rank = F.row_number().over(every.orderBy((F.col("__raw") - F.col("__floor")).desc(), F.col(key)))
    left = F.lit(target) - F.sum("__floor").over(every)
    return floors.withColumn("quota", (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("__raw", "__floor")


def stratified_sample(df: DataFrame, target: int, id_col: str, strata: list[str], seed: str = "1") -> DataFrame:
    """(id, stratum): a deterministic sample of ``target`` rows, in proportion to the strata.

    Within a stratum rows rank by a salted hash. The constant bound on the rank lets Spark keep only
    the first ``target`` of a stratum in each task before the shuffle, so a hot stratum isn't gathered.
    """
    rows = df.select(F.col(id_col), stratum_of(*strata).alias("stratum"))
    quota = largest_remainder(rows.groupBy("stratum").agg(F.count("*").alias("n")), target)
    hashed = rows.withColumn("h", salted(F.lit(seed), "stratum", id_col))
    ranked = hashed.withColumn("p", F.row_number().over(Window.partitionBy("stratum").orderBy("h", id_col))).filter(F.col("p") <= target)
    return ranked.join(quota.select("stratum", "quota"), "stratum").filter("p <= quota").select(id_col, "stratum")


def reserve_queue(pool: DataFrame, primary: DataFrame, id_col: str, strata: list[str], seed: str, first_only: bool = False) -> DataFrame:
    """(id, stratum, place): what isn't primary, by a salted hash within its stratum.

    Places come from sampled ranges of (stratum, hash, id) less the stratum's first, so no task holds a stratum. ``first_only``
    keeps the first of each; Spark then drops the others before the shuffle.
    """
    left = pool.join(primary.select(id_col), id_col, "left_anti").select(F.col(id_col), stratum_of(*strata).alias("stratum"))
    hashed = salted(F.lit(seed), "stratum", id_col)
    if first_only:
        place = F.row_number().over(Window.partitionBy("stratum").orderBy(hashed, id_col))
        return left.withColumn("place", place.cast("long")).filter("place <= 1")
    return places_within(left, "stratum", [hashed, id_col], "place").select(id_col, "stratum", (F.col("place") + 1).alias("place"))


@dataclass(frozen=True)
class TaskInputs:
    """What a collection starts from: its tasks in order, the pool, and the reserves of each stratum."""

    primary: DataFrame
    train: DataFrame
    reserve: DataFrame


def task_inputs(train: DataFrame, primary: DataFrame, id_col: str, strata: list[str], seed: str, selected: DataFrame | None = None, order: str = "position", allow_other: bool = False) -> TaskInputs:
    """Inputs of a collection from its two manifests and, if given, an explicit selection (id, order) in place of the primary.

    A selected id twice, outside the train manifest, or (unless ``allow_other``) outside the primary one is an error;
    an empty selection is an empty primary. The reserves are what the whole primary manifest leaves of train, also where a selection is smaller.
    """
    chosen = primary
    if selected is not None:
        many, pool, own = free(selected, train, primary, wanted=["many", "pool", "own"])
        wanted = selected.groupBy(id_col).agg(F.count("*").alias(many))
        marked = wanted.join(train.select(id_col).distinct().withColumn(pool, F.lit(True)), id_col, "left")
        marked = marked.join(primary.select(id_col).distinct().withColumn(own, F.lit(True)), id_col, "left")
        wrong = {"twice": F.col(many) > 1, "not in train": F.col(pool).isNull(), "not in primary": F.lit(not allow_other) & F.col(own).isNull()}
        found = marked.agg(*(F.count_if(c).alias(n) for n, c in wrong.items())).first().asDict()
        if any(found.values()):
            raise ValueError(f"selected tasks: {', '.join(f'{n} {k}' for k, n in found.items() if n)}")
        chosen = train.drop(order).join(selected.select(id_col, order), id_col)
    return TaskInputs(chosen, train, reserve_queue(train, primary, id_col, strata, seed))


def task_schedule(tasks: DataFrame, id_col: str, length: int, epochs: int, seed: str) -> DataFrame:
    """(position, epoch, id): epochs of all tasks, each in its own hash order, up to ``length``.

    The place in an epoch is a count within it, so epochs are ranked apart from each other. The constant
    bound on the place lets each task drop all but its first ``length`` before the shuffle.
    """
    rows = tasks.select(F.col(id_col)).crossJoin(F.broadcast(tasks.sparkSession.range(epochs).select(F.col("id").alias("epoch"))))
    place = F.row_number().over(Window.partitionBy("epoch").orderBy(salted(F.lit(seed), "epoch", id_col), id_col))
    first = rows.withColumn("__place", place).filter(F.col("__place") <= length)
    sized = first.crossJoin(F.broadcast(tasks.agg(F.count("*").alias("__n"))))  # one row
    placed = sized.withColumn("position", (F.col("epoch") * F.col("__n") + F.col("__place") - 1).cast("long"))
    return placed.filter(F.col("position") < length).select("position", "epoch", id_col)


def quantile_selection(rows: DataFrame, size: str, id_col: str, count: int = 32) -> DataFrame:
    """(id, size, roles): the longest, p50, p90, p99 and a grid of quantiles, filled up from the shortest.

    Positions round half to even; a row taken twice keeps both roles. The order of the input doesn't matter.
    Places come from sampled ranges; only the rows at the positions in question, at most three for each
    that is chosen, meet in a task.
    """
    ranked = positions(rows.select(id_col, size), [size, id_col], "__at")
    total = rows.agg(F.count("*").alias("__n"))
    last = F.col("__n") - 1

    def place(q: float) -> Column:
        return F.bround(last.cast("double") * q, 0).cast("long")

    names = ((last, "longest"), (place(0.5), "p50"), (place(0.9), "p90"), (place(0.99), "p99"))
    grid = F.array(*(place(i / count) for i in range(1, count)))
    told = ranked.crossJoin(F.broadcast(total))  # one row
    told = told.filter(F.array_contains(grid, F.col("__at")) | F.col("__at").isin([at for at, _ in names]) | (F.col("__at") < 2 * count + len(names)))
    named = F.array(*(F.when(F.col("__at") == at, F.lit(label)) for at, label in names))
    step = F.array_position(grid, F.col("__at"))
    told = told.withColumn("roles", F.array_compact(named)).withColumn("step", F.when(step > 0, step))
    # those with a name first, then the grid in its order, then from the shortest
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.size("roles") == 0).cast("int"), F.when(F.size("roles") == 0, F.coalesce("step", F.lit(count))), size, id_col))
    chosen = told.withColumn("rank", rank).filter(F.col("rank") <= count)
    # the grid stops when the selection is full: a named row has the grid's role only if its step came before that
    stop = F.max(F.when(F.size("roles") == 0, F.col("step"))).over(Window.partitionBy(F.lit(0)))
    also = F.col("step").isNotNull() & (F.size("roles") > 0) & (F.col("step") <= F.coalesce(stop, F.lit(0)))
    roles = F.when(F.size("roles") == 0, F.array(F.lit("stratified"))).when(also, F.concat("roles", F.array(F.lit("stratified")))).otherwise(F.col("roles"))
    return chosen.withColumn("roles", roles).select(id_col, size, "roles")


def split_by_tag(df: DataFrame, tag: str, names: dict[str, str]) -> DataFrame:
    """``df`` with split by its tag; a tag outside ``names`` is an error."""
    expr = F.raise_error(F.concat(F.lit("unexpected tag: "), F.coalesce(F.col(tag), F.lit("null")))).cast("string")
    for value, name in names.items():
        expr = F.when(F.col(tag) == value, name).otherwise(expr)
    return df.withColumn("split", expr)


def split_by_range(df: DataFrame, position: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """``df`` with split by half-open ranges of positions; rows outside all are left out."""
    expr = F.lit(None).cast("string")
    for name, (low, high) in ranges.items():
        expr = F.when((F.col(position) >= low) & (F.col(position) < high), name).otherwise(expr)
    return df.withColumn("split", expr).filter("split IS NOT NULL")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def missing(wanted: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """The wanted keys that the pool lacks; empty if wanted is a subset."""
    return wanted.select(key).distinct().join(pool.select(key), key, "left_anti")
