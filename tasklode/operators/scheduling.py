"""Bounded collection in three passes, as folds over the ordered outcomes of each task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.functions.stats import ratio
from tasklode.functions.text import col, displayed
from tasklode.operators.ranking import places_within, positions
from tasklode.operators.sampling import largest_remainder

OUTCOMES = ("accepted", "failure", "exact_duplicate", "hygiene_reject")


@dataclass(frozen=True)
class Budgets:
    """Tries for a first success, tries after it, accepted per task, and the target over all tasks."""

    first: int = 2
    after: int = 3
    accepted: int = 3
    target: int = 6000


def next_action(attempts: Column | str, succeeded: Column | str, reserve_left: Column | str, budgets: Budgets = Budgets()) -> Column:
    """What the slot of a task does next in the first pass."""
    return (
        F.when(col(attempts) < 0, F.raise_error(F.lit("attempts are negative")).cast("string"))
        .when(col(succeeded), "covered")
        .when(col(attempts) < budgets.first, "retry_current_task")
        .when(col(reserve_left), "same_stratum_reserve")
        .otherwise("reserve_exhausted")
    )


def after_success(outcomes: Column | str, budgets: Budgets = Budgets(), initial: int = 1) -> Column:
    """struct<accepted, used, left> after the ordered outcomes that follow a first success.

    Outcomes beyond the budget don't count; an unknown one within it is an error.
    """
    used = F.slice(col(outcomes), 1, budgets.after)
    fine = F.forall(used, lambda o: F.coalesce(o.isin(*OUTCOMES), F.lit(False)))
    got = F.least(F.lit(budgets.accepted), F.lit(initial) + F.size(F.filter(used, lambda o: o == "accepted")))
    state = F.struct(F.greatest(got, F.lit(initial)).alias("accepted"), F.size(used).alias("used"), (F.lit(budgets.after) - F.size(used)).alias("left"))
    return F.when(fine, state).otherwise(F.raise_error(F.lit("unknown outcome")).cast("struct<accepted: int, used: int, left: int>"))


def terminal_status(accepted: Column | str, capacity: Column | str, budgets: Budgets = Budgets(), exhausted: str = "bounded_capacity_exhausted") -> Column:
    return F.when(col(accepted) >= budgets.target, "complete").when(col(capacity) <= 0, exhausted).otherwise("in_progress")


def task_states(attempts: DataFrame, task: str, order: list[str], outcome: str, budgets: Budgets = Budgets()) -> DataFrame:
    """(task, first_attempts, first_success, accepted, used, left) from the whole ledger of genuine outcomes.

    The replay of what a stream keeps per task: both give the same states. No more than the first tries of both budgets
    count, so only these are listed; Spark limits each task's rows by their rank before it deals them out.
    """
    place = F.row_number().over(Window.partitionBy(task).orderBy(*order, outcome))
    rows = attempts.select(F.col(task), *(F.col(o) for o in order), F.col(outcome).alias("__o"), place.alias("__place")).filter(F.col("__place") <= budgets.first + budgets.after)
    listed = rows.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("__place", "__o"))).alias("__all"))
    told = listed.withColumn("__o", F.transform("__all", lambda s: s["__o"]))
    at = F.array_position(F.slice("__o", 1, budgets.first), F.lit("accepted"))
    rest = F.when(at > 0, F.slice("__o", at.cast("int") + 1, F.greatest(F.size("__o"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    state = after_success(rest, budgets, 1)
    return told.select(
        task,
        F.when(at > 0, at.cast("int")).otherwise(F.least(F.size("__o"), F.lit(budgets.first))).alias("first_attempts"),
        (at > 0).alias("first_success"),
        F.when(at > 0, state["accepted"]).otherwise(0).alias("accepted"),
        state["used"].alias("used"),
        state["left"].alias("left"),
    )


@dataclass(frozen=True)
class ProfileTries:
    """Tries of a profile for a task's first success, and for a second demonstration after it."""

    first: int = 3
    second: int = 2


def profile_states(attempts: DataFrame, task: str, status: str, phase: str, tries: ProfileTries = ProfileTries(), tasks: DataFrame | None = None) -> DataFrame:
    """(task, first_attempts, second_attempts, successes, next, attempt): what a profile does next with each task.

    next is first_success or second_demo (``attempt`` is its number), profile_unsolved when the first tries are used up without a
    success, or done. Interrupted attempts count as no try; a null phase is the first. With ``tasks`` those without
    attempts have a row too. Counts are combined before the shuffle.
    """
    genuine = ~F.col(status).eqNullSafe(F.lit("infrastructure_interrupted"))
    later = F.col(phase).eqNullSafe(F.lit("second_demo"))
    counts = {"first_attempts": genuine & ~later, "second_attempts": genuine & later, "successes": F.col(status) == "success"}
    told = attempts.groupBy(task).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    if tasks is not None:
        told = tasks.select(task).distinct().join(told, task, "left").select(task, *(F.coalesce(n, F.lit(0)).alias(n) for n in counts))
    first = F.when(F.col("first_attempts") < tries.first, "first_success").otherwise("profile_unsolved")
    second = F.when(F.col("second_attempts") < tries.second, "second_demo").otherwise("done")
    then = F.when(F.col("successes") == 0, first).otherwise(second)
    number = F.when(then == "first_success", F.col("first_attempts") + 1).when(then == "second_demo", F.col("second_attempts") + 1)
    return told.select(task, *counts, then.alias("next"), number.alias("attempt"))


def mark_unsolved(attempts: DataFrame, states: DataFrame, task: str, key: str, order: list[str], status: str = "status", success: str = "success", reason: str = "termination_reason") -> DataFrame:
    """``attempts`` in which the last genuine attempt of each unsolved task of ``states`` has status and reason
    profile_unsolved, and no success. ``key`` is unique; marking twice changes nothing.

    One key a task is found by partial maxima and joined on the key, so a task with many attempts isn't gathered.
    """
    (last,) = free(attempts, wanted=["last"])
    unsolved = states.filter(F.col("next") == "profile_unsolved").select(task)
    genuine = attempts.filter(~F.col(status).eqNullSafe(F.lit("infrastructure_interrupted")))
    keys = genuine.groupBy(task).agg(F.max_by(key, F.struct(*order)).alias(key)).join(unsolved, task, "left_semi").select(key, F.lit(True).alias(last))
    told = attempts.join(keys, key, "left")
    values = {status: F.lit("profile_unsolved"), success: F.lit(False), reason: F.lit("profile_unsolved")}
    return told.withColumns({c: F.when(F.col(last), v).otherwise(F.col(c)) for c, v in values.items()}).drop(last).select(*attempts.columns)


def initial_slots(primary: DataFrame, position: str, task: str) -> DataFrame:
    """(slot, task): the primary tasks in their order, from 0."""
    return positions(primary.select(position, task), [position], "slot").select("slot", task)


def replacements(failed: DataFrame, queue: DataFrame, stratum: str = "stratum", slot: str = "slot") -> DataFrame:
    """(slot, stratum, reserve): exhausted slots take the next unused reserve of their stratum, in order of the slots.

    Both sides rank within the stratum, in sampled ranges, and join on the rank; a slot without a reserve has null, as has one without a stratum.
    """
    (rank,) = free(failed, ["reserve"], wanted=["rank"])
    need = places_within(failed.select(slot, stratum), stratum, [slot], rank)
    have = places_within(queue.select(F.col("task_id").alias("reserve"), F.col("stratum").alias(stratum), "place"), stratum, ["place"], rank)
    return need.join(have.drop("place"), [stratum, rank], "left").drop(rank)


def deficits(accepted: DataFrame, population: DataFrame, target: int, stratum: str = "stratum") -> DataFrame:
    """(stratum, target, accepted, deficit): accepted per stratum against its (uncapped) share of the target."""
    share = largest_remainder(population.groupBy(stratum).agg(F.count("*").alias("n")), target, stratum, capped=False)
    have = accepted.groupBy(stratum).agg(F.sum("accepted_count").alias("accepted"))
    return share.join(have, stratum, "left").select(stratum, F.col("quota").alias("target"), F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.col("quota") - F.coalesce("accepted", F.lit(0))).alias("deficit"))


def progress(slots: DataFrame, genuine: DataFrame, accepted: DataFrame, target: int) -> DataFrame:
    """One row: tasks and accepted trajectories by number and in percent (0 where there is nothing to divide by), and ``line``, which says so.

    ``slots`` has fulfilled and exhausted (null: neither); ``genuine`` and ``accepted`` are counted.
    """
    done = F.coalesce("fulfilled", F.lit(False)) | F.coalesce("exhausted", F.lit(False))
    one = slots.agg(F.count_if(done).alias("completed"), F.count("*").alias("tasks"))
    for name, rows in (("trajectories", genuine), ("accepted", accepted)):
        one = one.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    parts = {"task_pct": ("completed", F.col("tasks")), "success_rate": ("accepted", F.col("trajectories")), "target_pct": ("accepted", F.lit(target))}
    told = one.withColumn("target", F.lit(target).cast("long")).withColumns({k: F.coalesce(ratio(F.col(a) * 100, b), F.lit(0.0)) for k, (a, b) in parts.items()})
    task, rate, goal = (displayed(k, 2, "%") for k in parts)
    line = F.format_string("tasks=%s/%s (%s) | accepted=%s | trajectories=%s | success_rate=%s | target=%s/%s (%s)", "completed", "tasks", task, "accepted", "trajectories", rate, "accepted", "target", goal)
    return told.withColumn("line", line)


def third_pass(states: DataFrame, shortfall: DataFrame, quota_left: int, budgets: Budgets = Budgets()) -> DataFrame:
    """Tasks for the third pass: fewest accepted, then largest deficit, then slot, at most ``quota_left``."""
    able = states.filter(F.col("first_success") & (F.col("accepted") < budgets.accepted) & (F.col("left") > 0))
    return able.join(shortfall.select("stratum", "deficit"), "stratum", "left").orderBy("accepted", F.desc_nulls_last("deficit"), "slot", "task_id").limit(quota_left)


def stale_as_interrupted(attempts: DataFrame, active: Sequence[str] = ()) -> DataFrame:
    """Attempts in progress that no worker holds are infrastructure interruptions."""
    stale = (F.col("status") == "in_progress") & ~F.col("attempt_id").isin(list(active) or [""])
    return attempts.withColumn("status", F.when(stale, "infrastructure_interrupted").otherwise(F.col("status")))


def segments(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """``attempts`` with segment: the latest run of the scheduler whose row boundary is before them.

    Boundaries are few (one per restart) and fold into one array, so the join has no key and one row.
    """
    (all_,) = free(attempts, wanted=["bounds"])
    bounds = runs.groupBy().agg(F.array_sort(F.collect_list(F.struct("boundary", "segment"))).alias(all_))
    before = F.filter(all_, lambda b: b["boundary"] < F.col("rowid"))
    return attempts.crossJoin(F.broadcast(bounds)).withColumn("segment", F.when(F.size(before) > 0, F.element_at(before, -1)["segment"])).drop(all_)


def recoverable(failures: DataFrame) -> DataFrame:
    """One row: whether an invocation may resume; something recoverable and nothing permanent."""
    return failures.agg((F.coalesce(F.bool_or("recoverable"), F.lit(False)) & ~F.coalesce(F.bool_or("permanent"), F.lit(False))).alias("resume"))
