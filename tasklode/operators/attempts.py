"""Attempts: which count, first successes, pairs, loops, latest rows, concurrency and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.functions.similarity import fingerprint_of
from tasklode.functions.stats import ratio, wilson
from tasklode.functions.text import col, normalize_action
from tasklode.operators.profiling import nearest_summaries
from tasklode.operators.ranking import dealt, places_within, positions, sums_before

# Statuses that say something about the infrastructure, and those of genuine failures.
INFRA = ("infrastructure_interrupted", "provider_config_error", "provider_model_mismatch", "environment_fatal_error", "cancelled")
GENUINE_FAILURES = (
    "teacher_failure", "teacher_empty_response", "malformed_action", "invalid_action", "terminal_unsuccessful", "max_steps", "hygiene_reject",
    "rejected_exact_duplicate", "rejected_acceptance_integrity",
)

#: Rows of a group that one window looks at.
STRETCH = 1 << 16


def is_genuine(status: Column | str, infra: tuple[str, ...] = INFRA) -> Column:
    return ~F.coalesce(col(status), F.lit("")).isin(*infra)


def ordinals(attempts: DataFrame, by: list[str], order: list) -> DataFrame:
    """``attempts`` with ordinal, from 1 in each group."""
    return attempts.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def first_success(genuine: DataFrame, task: str, success: str, order: list, tasks: DataFrame | None = None) -> DataFrame:
    """(task, attempts, first_success): per task, all its attempts, and the ordinal of the first success.

    With ``tasks`` every task has a row; one without attempts has 0. The first success in order is a partial minimum, and the
    attempts before it are counted, so a task with many attempts isn't gathered. Attempts equal in ``order`` are one place.
    """
    at, first, key = free(genuine, wanted=["at", "first", "key"])
    rows = genuine.withColumn(at, F.struct(*order))
    won = rows.filter(success).groupBy(F.col(task).alias(key)).agg(F.min(at).alias(first))
    before = rows.join(won, F.col(task).eqNullSafe(F.col(key)), "left").groupBy(task).agg(F.count("*").alias("attempts"), F.count_if(F.col(first).isNotNull() & (F.col(at) < F.col(first))).alias(first), F.count(key).alias(key))
    out = before.select(task, "attempts", F.when(F.col(key) > 0, F.col(first) + 1).alias("first_success"))
    if tasks is not None:
        out = tasks.select(task).distinct().join(out, task, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return out


def success_summary(outcomes: DataFrame) -> DataFrame:
    """One row: tasks, solved, within 1, 2 and 3, mean ordinal over the solved, burden (all attempts by the solved), and the Wilson interval."""
    rate = wilson("solved", "tasks")
    return outcomes.agg(
        F.count("*").alias("tasks"),
        F.count("first_success").alias("solved"),
        *(F.count_if(F.col("first_success") <= k).alias(f"within_{k}") for k in (1, 2, 3)),
        F.avg("first_success").alias("mean_ordinal"),
        F.sum("attempts").alias("attempts"),
    ).select("*", ratio("attempts", "solved").alias("burden"), rate["low"].alias("low"), rate["high"].alias("high"))


def pairs(rows: DataFrame, task: str, order: str) -> DataFrame:
    """(task, a, b): each two rows of a task, a the later, as structs, for tasks of few rows whose pairs are wanted
    themselves. Counts of pairs come from ``pairs.pair_statistics``, which makes none."""
    whole = F.struct(*rows.columns)
    a, b = rows.select(F.col(task), whole.alias("a")), rows.select(F.col(task), whole.alias("b"))
    return a.join(b, task).filter(F.col(f"a.{order}") > F.col(f"b.{order}"))


def with_fingerprint(attempts: DataFrame, actions: str, purchase: str, stored: str | None = None) -> DataFrame:
    """``attempts`` with fingerprint: the stored one, else from the actions."""
    (done,) = free(attempts, wanted=["done"])
    made = fingerprint_of(F.col(done), purchase)
    told = attempts.withColumn(done, F.transform(actions, normalize_action))
    return told.withColumn("fingerprint", F.coalesce(F.col(stored), made) if stored else made).drop(done)


def no_progress(actions: Column | str, observations: Column | str, threshold: int = 3) -> Column:
    """Whether ``threshold`` consecutive actions and the observations before them are the same.

    Observations are one for each action, or one more (the last is after the last action); else it is an error, as is a threshold under 2.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    act, obs = F.transform(col(actions), normalize_action), col(observations)
    n = F.size(act)
    aligned = (F.size(obs) == n) | (F.size(obs) == n + 1)
    before = F.slice(obs, 1, F.greatest(n, F.lit(0)))
    both = F.arrays_zip(act.alias("a"), before.alias("o"))
    ends = F.sequence(F.lit(threshold), F.greatest(n, F.lit(threshold)))
    found = F.exists(ends, lambda i: (i <= n) & (F.size(F.array_distinct(F.slice(both, i - threshold + 1, threshold))) == 1))
    return F.when(aligned, found).otherwise(F.raise_error(F.lit("observations are not aligned with actions")).cast("boolean"))


def repeats_in_rows(rows: DataFrame, by: str, order: list, value: str, threshold: int = 3) -> DataFrame:
    """(by): groups in which ``threshold`` consecutive rows have an equal value; a null value equals none.

    Rows are looked at in stretches of a group, which overlap by what a repeat needs, so no task sorts a whole group.
    """
    if threshold < 2:
        raise ValueError("threshold must be at least 2")
    at, stretch, same = free(rows, wanted=["at", "stretch", "same"])
    placed = places_within(rows, by, order, at)
    stretches = F.array_distinct(F.array(*(F.floor((F.col(at) - back) / STRETCH).cast("long") for back in (0, threshold - 1))))
    w = Window.partitionBy(by, stretch).orderBy(at)
    equal = reduce(lambda a, b: a & b, (F.coalesce(F.lag(value, k).over(w) == F.col(value), F.lit(False)) for k in range(1, threshold)))
    return placed.withColumn(stretch, F.explode(stretches)).withColumn(same, equal).filter(F.col(same)).select(by).distinct()


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each group. max_by is combined before the shuffle, where a window would sort whole groups."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(by).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")


def overlay(base: DataFrame, repair: DataFrame, key: str) -> DataFrame:
    """``base`` without the keys of ``repair``, and ``repair``."""
    return base.join(repair.select(key).distinct(), key, "left_anti").unionByName(repair, allowMissingColumns=True)


def most_at_once(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """(peak): the most intervals open at one time; one that ends when another starts doesn't overlap it.

    Times are dealt to sampled ranges; a range's running sum starts from the sum of those before it, so no
    task sorts all events, however they bunch.
    """
    a, b = (F.unix_micros(F.col(x).cast("timestamp")) for x in (start, end))
    events = intervals.select(F.explode(F.array(F.struct(a.alias("t"), F.lit(1).alias("d")), F.struct(b.alias("t"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    placed = dealt(events.groupBy("t").agg(F.sum("d").alias("d")), [F.col("t")], "k", "place")
    before = sums_before(placed.groupBy("k").agg(F.sum("d").alias("s")), "k", "s", "base")
    running = F.sum("d").over(Window.partitionBy("k").orderBy("place"))
    return placed.withColumn("run", running).join(F.broadcast(before.select("k", "base")), "k").agg(F.max(F.col("run") + F.col("base")).cast("long").alias("peak"))


def wall_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two ISO times; null if one can't be read or the end is before the start."""
    a, b = (F.unix_micros(F.try_to_timestamp(F.regexp_replace(col(x), "Z$", "+00:00"))) for x in (start, end))
    return F.when(b >= a, (b - a) / 1e6)


def cost_projection(summary: DataFrame, targets: tuple[int, ...] = (3000, 6000, 12000)) -> DataFrame:
    """One row: expected solved tasks and attempts, scaled linearly to each target."""
    columns = [(ratio("solved", "tasks") * t).alias(f"solved_{t}") for t in targets] + [(F.col("burden") * t).alias(f"attempts_{t}") for t in targets]
    return summary.select("tasks", "solved", *columns)


def _retry_columns(diagnostics: str) -> dict[str, Column]:
    """Each attempt's calls, retries, 429s, 5xxs and whether every retry has its event, from its arrays: nothing is exploded."""
    d = F.col(diagnostics)
    events = F.flatten(F.transform(d, lambda x: F.coalesce(x["retry_events"], F.array().cast("array<struct<status_code:int>>"))))
    codes = F.transform(events, lambda e: e["status_code"])
    return {
        "calls": F.size(d),
        "retries": F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["retries"], F.lit(0))),
        "http_429": F.size(F.filter(codes, lambda c: c == 429)),
        "http_5xx": F.size(F.filter(codes, lambda c: (c >= 500) & (c <= 599))),
        "complete": F.forall(d, lambda x: (F.coalesce(x["retries"], F.lit(0)) == 0) | (F.size(x["retry_events"]) > 0)),
    }


def _retry_totals(columns: dict[str, Column]) -> list[Column]:
    return [F.bool_and(c).alias(n) if n == "complete" else F.sum(c).alias(n) for n, c in columns.items()]


def retry_telemetry(attempts: DataFrame, diagnostics: str) -> DataFrame:
    """One row: calls, retries, HTTP 429 and 5xx codes, and whether every retry has its event."""
    return attempts.agg(*_retry_totals(_retry_columns(diagnostics)))


def observed_retries(attempts: DataFrame, diagnostics: str, observation: Observation | str) -> DataFrame:
    """``attempts`` as they are; what ``retry_telemetry`` counts is told to ``observation`` while another plan reads them.

    An ``Observation`` has the totals (``get``) once the first action over the result has ended, without a pass of its
    own. A name instead of one makes them part of a stream's progress, for listeners, batch by batch.
    """
    return attempts.observe(observation, *_retry_totals(_retry_columns(diagnostics)))


def group_statistics(attempts: DataFrame) -> DataFrame:
    """(group, measure, n, mean, p50, p90, p95, max, api_share) for successful, genuine_failed and infra attempts.

    Measures: api_call and environment_step (each latency of the diagnostics), wall, api_total and the
    tokens input, output and total. api_share is the group's API seconds by its wall seconds. Every
    group has all measures; nulls of nothing. A value is exploded once, so nothing is counted twice.
    """
    readable = F.try_to_timestamp(F.regexp_replace("finished_at", "Z$", "+00:00")).isNotNull()
    wall = wall_seconds("started_at", F.when(readable, F.col("finished_at")).otherwise(F.col("saved_at")))
    api, ins, outs = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("api_latency_total_s", "total_input_tokens", "total_output_tokens"))
    genuine = is_genuine("status")
    group = F.when(genuine & F.coalesce("success", F.lit(False)), "successful").when(genuine, "genuine_failed").otherwise("infra")

    def one(name: str, x: Column) -> Column:
        return F.struct(F.lit(name).alias("measure"), x.cast("double").alias("x"))

    def each(name: str, diagnostics: str) -> Column:
        none = F.array().cast("array<struct<measure: string, x: double>>")
        return F.coalesce(F.transform(diagnostics, lambda d: one(name, d["latency_s"])), none)

    rows = {"wall": wall, "api_total": api, "input": ins, "output": outs, "total": ins + outs}
    steps = {"api_call": "api_diagnostics", "environment_step": "environment_diagnostics"}
    values = F.concat(F.array(*(one(k, x) for k, x in rows.items())), *(each(k, c) for k, c in steps.items()))
    told = attempts.select(group.alias("group"), F.explode(values).alias("v")).select("group", "v.*").filter("x IS NOT NULL")
    quantiles = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    told = nearest_summaries(told, ["group", "measure"], "x", quantiles).select("group", "measure", "n", "mean", *quantiles, "max", F.col("sum").alias("s"))
    share = told.groupBy("group").agg(ratio(F.max(F.when(F.col("measure") == "api_total", F.col("s"))), F.max(F.when(F.col("measure") == "wall", F.col("s")))).alias("api_share"))
    names = [(g, m) for g in ("successful", "genuine_failed", "infra") for m in (*rows, *steps)]
    every = attempts.sparkSession.createDataFrame(names, "group string, measure string")
    out = every.join(told.drop("s"), ["group", "measure"], "left").join(share, "group", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def run_summary(attempts: DataFrame, slots: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: slots completed and in all, tasks with a first success, and API calls, retries, codes and tokens of the attempts."""
    codes = F.transform("retry_events", lambda e: e["status_code"])
    zero = F.lit(0)
    sums = attempts.select(
        F.coalesce(F.array_size("api_diagnostics"), zero).alias("api_calls"),
        F.col("infrastructure_retries").alias("retries"),
        F.array_size(F.filter(codes, lambda c: c == 429)).alias("http_429"),
        F.array_size(F.filter(codes, lambda c: (c >= 500) & (c <= 599))).alias("http_5xx"),
        F.col("total_input_tokens").alias("input_tokens"),
        F.col("total_output_tokens").alias("output_tokens"),
    )
    sums = sums.agg(*(F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in sums.columns))
    done = slots.agg(F.count_if(F.coalesce("fulfilled", F.lit(False)) | F.coalesce("exhausted", F.lit(False))).alias("slots_completed"), F.count("*").alias("slots_total"))
    unique = tasks.agg(F.count_if("first_success").alias("unique_successful_tasks"))
    return done.crossJoin(F.broadcast(unique)).crossJoin(F.broadcast(sums))  # one row each


def concurrency(attempts: DataFrame, start: str, end: str, wall: str, outcome: str) -> DataFrame:
    """One row: makespan and summed wall seconds, speedup, successful trajectories an hour, and the peak of ``most_at_once``."""
    a, b = (F.unix_micros(F.col(x).cast("timestamp")) for x in (start, end))
    told = attempts.agg(
        ((F.max(b) - F.min(a)) / 1e6).alias("makespan_s"),
        F.coalesce(F.sum(F.col(wall).cast("double")), F.lit(0.0)).alias("wall_s"),
        F.count_if(F.col(outcome) == "success").alias("succeeded"),
    )
    told = told.select("makespan_s", "wall_s", ratio("wall_s", "makespan_s").alias("speedup"), F.coalesce(ratio("succeeded", "makespan_s") * 3600, F.lit(0.0)).alias("trajectories_per_hour"))
    return told.crossJoin(F.broadcast(most_at_once(attempts, start, end)))  # one row each


def hard_tasks(attempts: DataFrame, task: str, status: str, actions: str, reward: str, order: list[str]) -> DataFrame:
    """Tasks with an unsolved or max_steps attempt: outcomes, repeats, and the last reward.

    Actions (letters count in either case) are counted by (task, action) before they meet, so no row holds a task's actions;
    a task without any has zero and false. outcomes are sorted, one an attempt.
    """
    said = attempts.select(F.col(task), F.explode(F.transform(actions, lambda a: F.lower(a))).alias("said"))
    own = F.contains("said", F.lower(F.col(task).cast("string")))
    counted = said.groupBy(task, "said").agg(F.count("*").alias("n")).groupBy(task).agg(
        F.sum("n").alias("action_count"),
        (F.max("n") > 1).alias("twice"),
        *(F.coalesce(F.sum(F.when(F.startswith("said", F.lit(f"{k}[")), F.col("n"))), F.lit(0)).alias(k) for k in ("search", "click")),
        F.coalesce(F.bool_or(own), F.lit(False)).alias("target_clicked"),
    )
    found = attempts.groupBy(task).agg(
        F.bool_or(F.col(status).isin("profile_unsolved", "max_steps")).alias("hard"),
        F.count_if(F.col(status) == "max_steps").alias("max_steps_attempts"),
        F.collect_list(status).alias("outcomes"),
        F.max_by(reward, F.struct(*order)).alias("last_reward"),
    )

    def many(kind: str) -> Column:
        return F.coalesce(F.col("twice") & (F.col(kind) > 1), F.lit(False)).alias(f"repeated_{kind}")

    return found.filter("hard").join(counted, task, "left").select(
        task, F.array_sort("outcomes").alias("outcomes"), "max_steps_attempts", many("search"), many("click"),
        F.coalesce("action_count", F.lit(0)).alias("action_count"), F.coalesce("target_clicked", F.lit(False)).alias("target_clicked"), "last_reward",
    )


def one_of_each_task(attempts: DataFrame, task: str, order: list, count: int) -> DataFrame:
    """The first attempt of each task in order, for the first ``count`` tasks: a sample for reading."""
    whole = F.struct(*attempts.columns)
    first = attempts.groupBy(task).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")
    return first.orderBy(*order).limit(count)


def progress_marks(accepted: DataFrame, order: str, every: int = 25) -> DataFrame:
    """(order, accepted): the rows at which the number of accepted reaches a multiple of ``every``."""
    counted = positions(accepted.select(order), [order]).withColumn("accepted", F.col("at") + 1)
    return counted.filter(F.col("accepted") % every == 0).select(order, "accepted")
