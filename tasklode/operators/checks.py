"""Small contracts between tables: equal sets, unique matches, fixed lists, role plans, pools and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklode.functions.hashing import ordered_hash
from tasklode.functions.names import free

#: The roles of a selection that each phase takes; the third takes all.
PHASES = {"A": ("longest",), "B": ("p50", "p90", "p99")}


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one of the two has; empty if the sets are equal. Repeats don't count, a null is a value."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    found = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a <> b")
    return found.select(key, F.when(F.col("a") == 1, "left").otherwise("right").alias("side"))


def sets_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether both have the same keys."""
    return set_difference(a, b, key).agg((F.count("*") == 0).alias("equal"))


def unique_match(tasks: DataFrame, products: DataFrame, task: str, product: str) -> DataFrame:
    """Tasks with their one product (as struct ``match``); a task with none or several is an error where its row is read."""
    k, n = free(tasks, ["match"], wanted=["key", "n"])
    counted = products.groupBy(F.col(product).cast("string").alias(k)).agg(F.count("*").alias(n), F.any_value(F.struct(*products.columns)).alias("match"))
    told = tasks.join(counted, F.col(task).cast("string") == F.col(k), "left")
    wrong = F.raise_error(F.concat(F.lit("task product not unique: "), F.coalesce(F.col(task).cast("string"), F.lit("null"))))
    checked = F.when(F.col(n) == 1, F.col("match")).otherwise(wrong.cast(products.schema))
    return told.withColumn("match", checked).drop(n, k)


def enriched(rows: DataFrame, meta: DataFrame, key: str, fields: list[str], order: list[str] | None = None) -> DataFrame:
    """``rows`` with the fields of their task's metadata; empty text where there are none.

    Of repeated keys one whole row counts, never fields of several: the first by ``order``, else by the fields
    themselves, nulls first.
    """
    (found,) = free(rows, meta, wanted=["found"])
    texts = [F.col(f).cast("string").alias(f) for f in fields]
    one = meta.groupBy(key).agg(F.min_by(F.struct(*texts), F.struct(*(order or texts))).alias(found))
    told = rows.join(one, key, "left")
    return told.withColumns({f: F.coalesce(F.col(found)[f], F.lit("")) for f in fields}).drop(found)


def fixed_set(tasks: DataFrame, position: str, task: str, count: int, digest: str) -> DataFrame:
    """One row (n, task_ids_sha256, holds): whether the list has ``count`` tasks whose hash in order is ``digest``. For lists of a fixed size."""
    out = tasks.agg(F.count("*").alias("n"), ordered_hash(task, position).alias("task_ids_sha256"))
    return out.withColumn("holds", (F.col("n") == count) & F.col("task_ids_sha256").eqNullSafe(F.lit(digest)))


def phase_plan(selection: DataFrame, key: str, roles: str = "roles", count: int = 32) -> DataFrame:
    """(phase, key): A the longest, B the quantiles, C all. The whole selection is an error if a role isn't there
    exactly once, or if it hasn't ``count`` distinct keys."""
    names = [r for phase in PHASES.values() for r in phase]
    once = [F.count_if(F.array_contains(roles, r)) == 1 for r in names]
    fine = (F.count("*") == count) & (F.count_distinct(key) == count)
    for ok in once:
        fine = fine & ok
    checked = selection.agg(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("selection must have one of each role")).cast("boolean")).alias("__fine"))
    phases = F.array_compact(F.array(*(F.when(F.arrays_overlap(roles, F.array(*map(F.lit, own))), phase) for phase, own in PHASES.items()), F.lit("C")))
    return selection.crossJoin(F.broadcast(checked)).filter("__fine").select(F.explode(phases).alias("phase"), key)  # one row


def longest_of(selection: DataFrame, size: str) -> DataFrame:
    """One row: the number of rows and the longest of them, as struct; the first of equals by all columns."""
    order = F.struct(F.col(size), *(F.col(c) for c in selection.columns if c != size))
    return selection.agg(F.count("*").alias("count"), F.max_by(F.struct(*selection.columns), order).alias("longest"))


def coverage(attempts: DataFrame, task: str = "task_id", status: str = "status") -> DataFrame:
    """One row: attempts, distinct tasks touched, distinct unsolved tasks, successes."""
    return attempts.agg(
        F.count("*").alias("attempts"),
        F.count_distinct(task).alias("touched"),
        F.count_distinct(F.when(F.col(status) == "profile_unsolved", F.col(task))).alias("terminal"),
        F.count_if(F.col(status) == "success").alias("successes"),
    )


def pool_problems(pools: DataFrame, expected: list[tuple[str, str]] | None = None) -> DataFrame:
    """(scenario, split, problem) of the official pools (task_id, scenario, split, want_scenario, want_split): an item in the wrong
    pool or without an id, an id twice in a pool, or in the train and the test pool of a scenario; of the
    ``expected`` (scenario, split), a pool without items. Empty if all is well."""
    empty = F.coalesce("task_id", F.lit("")) == ""
    wrong = empty | ~F.col("scenario").eqNullSafe(F.col("want_scenario")) | ~F.col("split").eqNullSafe(F.col("want_split"))
    scenario, split = F.col("want_scenario").alias("scenario"), F.col("want_split").alias("split")
    invalid = pools.filter(wrong).select(scenario, split, F.lit("invalid official split manifest").alias("problem"))
    by = pools.filter(~empty).groupBy("want_scenario", "task_id").agg(
        *(F.count_if(F.col("want_split") == s).alias(s) for s in ("train", "test"))
    )
    twice = [by.filter(F.col(s) > 1).select(scenario, F.lit(s).alias("split"), F.lit("duplicate task IDs").alias("problem")) for s in ("train", "test")]
    both = by.filter("train > 0 AND test > 0").select(scenario, F.lit(None).cast("string").alias("split"), F.lit("official train/test overlap").alias("problem"))
    if expected:
        wanted = pools.sparkSession.createDataFrame(expected, "want_scenario string, want_split string")
        empty_pools = wanted.join(pools.select("want_scenario", "want_split").distinct(), ["want_scenario", "want_split"], "left_anti")
        invalid = invalid.unionByName(empty_pools.select(scenario, split, F.lit("invalid official split manifest").alias("problem")))
    return invalid.unionByName(twice[0]).unionByName(twice[1]).unionByName(both).distinct()


def success_records(ledger: DataFrame, artifacts: DataFrame, task: str = "task_id") -> DataFrame:
    """Artifacts of the ledger's successes that say so themselves, in the ledger's order of their task (``place``)."""
    done = ledger.filter("status = 'success'").select("artifact_path", F.col("rowid").alias("place"))
    return artifacts.filter("profiling_status = 'success'").join(done, "artifact_path").select(task, "place", *(c for c in artifacts.columns if c != task))


def open_slots(slots: DataFrame, states: DataFrame, first: int, workers: int, active: list[str] | None = None) -> DataFrame:
    """(slot, task_id, attempt): the first ``workers`` slots to work on. A slot is neither fulfilled nor exhausted, and its
    task isn't active and has tries left; one whose task has none needs a reserve first (``scheduling.replacements``)."""
    free = slots.filter(~F.coalesce("fulfilled", F.lit(False)) & ~F.coalesce("exhausted", F.lit(False)) & ~F.col("task_id").isin(active or [""]))
    able = free.join(states.select("task_id", "first_attempts"), "task_id").filter(F.col("first_attempts") < first)
    return able.orderBy("slot").limit(workers).select("slot", "task_id", (F.col("first_attempts") + 1).alias("attempt"))


def terminal_payload(metrics: Column, query_match: Column, purchase: Column, goal: Column) -> Column:
    """What is kept of an episode's end."""
    return F.struct(metrics.alias("metrics"), query_match.alias("query_match"), purchase.alias("purchase"), goal.alias("goal"))


def action_is_valid(name: Column | str, argument: Column | str, clickables: Column | str) -> Column:
    """Whether an action can be taken: a search for something, or a click on what can be clicked. Null for neither kind or without an argument."""
    n, a, c = (F.col(x) if isinstance(x, str) else x for x in (name, argument, clickables))
    arg = F.lower(F.coalesce(a, F.lit("")))
    on = (arg != "search") & F.coalesce(F.array_contains(c, arg), F.lit(False))
    return F.when(~F.coalesce(n.isin("search", "click"), F.lit(False)) | (arg == ""), F.lit(None).cast("boolean")).otherwise((n == "search") | on)


def bounded_map(items: DataFrame, worker: Callable[[dict[str, Any]], Any], workers: int, schema: str = "value string") -> DataFrame:
    """``items`` with the worker's value and error, by at most ``workers`` tasks at once.

    The first error of a task cancels what it has left: those rows have the error ``cancelled``. A worker is
    any picklable function of a row; it runs again if its task does.
    """
    if not 1 <= workers <= 10_000:
        raise ValueError("workers must be between 1 and 10000")
    name = schema.split()[0]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for batch in batches:
            values, errors = [], []
            for item in batch.to_dict("records"):
                value, error = None, "cancelled" if stopped else None
                if not stopped:
                    try:
                        value = worker(item)
                    except Exception as e:
                        stopped, error = True, str(e)
                values.append(value)
                errors.append(error)
            yield batch.assign(**{name: values, "error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.repartition(workers).mapInPandas(rows, f"{fields}, {schema}, error string")
