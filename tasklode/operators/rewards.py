"""Reward components, evaluation and rollout rollups, groups and their advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.functions.stats import ratio, total_if_complete
from tasklode.functions.text import col

#: The metrics of an episode.
METRICS = ("r_loose", "r_strict", "r_succ", "r_finish", "r_category", "r_attribute", "r_option", "r_price")


def combined(strict: Column | str, loose: Column | str, alpha: float) -> Column:
    """alpha * strict + (1 - alpha) * loose."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    return F.lit(alpha) * col(strict) + F.lit(1 - alpha) * col(loose)


def components(detail: Column, loose: Column, finished: Column, zero_unfinished: bool = True) -> dict[str, Column]:
    """The eight metrics from a detail struct (r_type or r_category, r_att or r_attribute, r_option, r_price).

    Strict is the product in a fixed order; success is strict equal to 1. Unfinished episodes are all
    zero unless ``zero_unfinished`` is off (the profiler's way).
    """
    done = F.coalesce(finished, F.lit(False))

    def value(x: Column) -> Column:
        kept = F.coalesce(x.cast("double"), F.lit(0.0))
        return F.when(done, kept).otherwise(0.0) if zero_unfinished else kept

    category, attribute = value(F.coalesce(detail["r_category"], detail["r_type"])), value(F.coalesce(detail["r_attribute"], detail["r_att"]))
    option, price = value(detail["r_option"]), value(detail["r_price"])
    strict = category * attribute * option * price
    return {
        "r_loose": value(loose),
        "r_strict": strict,
        "r_succ": F.when(strict == 1.0, 1.0).otherwise(0.0),
        "r_finish": F.when(done, 1.0).otherwise(0.0),
        "r_category": category,
        "r_attribute": attribute,
        "r_option": option,
        "r_price": price,
    }


def score_episodes(episodes: DataFrame, detail: str, loose: str, finished: str, alpha: float = 1.0) -> DataFrame:
    """``episodes`` with the eight metrics and r_alpha = alpha * r_strict + (1 - alpha) * r_loose.

    An episode that didn't finish (or null) is zero in all. An alpha outside [0, 1] is an error.
    """
    told = episodes.withColumns(components(F.col(detail), F.col(loose), F.col(finished)))
    return told.withColumn("r_alpha", combined("r_strict", "r_loose", alpha))


def evaluation_summary(episodes: DataFrame, expected: int, diagnostics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of the metrics over all episodes; of a diagnostic, the mean over what is there and the total only if all is."""
    columns = [F.avg(m).alias(f"mean_{m}") for m in METRICS]
    for d in diagnostics:
        columns += [F.avg(d).alias(f"mean_{d}"), total_if_complete(d).alias(f"total_{d}")]
    out = episodes.groupBy(*(by or [])).agg(
        F.count("*").alias("episodes"),
        *columns,
        F.count_if(F.col("r_finish") == 1).alias("finish_count"),
        F.count_if(F.col("r_succ") == 1).alias("success_count"),
        F.count_if(F.col("status") == "max_steps").alias("max_steps_count"),
        F.count_if(F.col("status") == "context_limit").alias("context_limit_count"),
        F.sum("wall_time_s").alias("wall"),
        F.sum("generation_time_s").alias("generation"),
        total_if_complete("generated_tokens").alias("tokens"),
    )
    return out.select(
        "*",
        (F.col("episodes") == expected).alias("complete"),
        (ratio("episodes", "wall") * 3600).alias("trajectories_per_hour"),
        ratio("tokens", "generation").alias("tokens_per_second"),
    ).drop("wall", "generation", "tokens")


def chunks(rows: DataFrame, position: str, size: int) -> DataFrame:
    """``rows`` with chunk: consecutive positions (from 0) in groups of ``size``; no window is needed."""
    return rows.withColumn("chunk", F.floor(F.col(position) / size).cast("long"))


def contiguity_problems(rows: DataFrame, size: int, meta: list[str]) -> DataFrame:
    """(chunk): groups that aren't complete or whose metadata differ; empty if all is well."""
    checked = rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct(*meta)).alias("low"), F.max(F.struct(*meta)).alias("high"))
    return checked.filter((F.col("n") != size) | ~F.col("low").eqNullSafe(F.col("high"))).select("chunk")


def rollout_metrics(rows: DataFrame, reward: str) -> DataFrame:
    """One row over chunked rows: mean and sample deviation, mean of the groups' deviations, share without any.

    Partial sums are combined per group, then over groups.
    """
    groups = rows.groupBy("chunk").agg(F.stddev_samp(reward).alias("sd"))
    whole = rows.agg(F.avg(reward).alias("reward_mean"), F.stddev_samp(reward).alias("reward_std"), F.count("*").alias("n"))
    per = groups.agg(F.avg("sd").alias("group_reward_std"), ratio(F.count_if(F.col("sd") == 0), F.count("*")).alias("zero_variance_group_fraction"), F.count("*").alias("groups"))
    return whole.crossJoin(F.broadcast(per))  # one row each


def rollout_rates(rows: DataFrame, metrics: tuple[str, ...] = ()) -> DataFrame:
    """One row over episodes: means of ``metrics`` and steps, rates of statuses, tokens, seconds and throughput.

    Columns: status, steps, env_mask, generated_tokens, generation_time_s, environment_wait_s, wall_time_s.
    """
    def total(x: str) -> Column:
        return F.coalesce(F.sum(x), F.lit(0))

    rates = {"invalid_rate": "invalid_action", "malformed_rate": "malformed_action", "context_limit_rate": "context_limit"}
    return rows.withColumn("__policy", F.aggregate("env_mask", F.lit(0).cast("long"), lambda a, x: a + x)).agg(
        *(F.avg(m).alias(m) for m in metrics),
        F.avg("steps").alias("episode_steps"),
        *(ratio(F.count_if(F.col("status") == s), F.count("*")).alias(n) for n, s in rates.items()),
        total("__policy").alias("generated_policy_tokens"),
        total("generated_tokens").alias("generated_tokens"),
        total("generation_time_s").alias("generation_wall_s"),
        total("environment_wait_s").alias("environment_wait_s"),
        ratio(total("generated_tokens"), total("generation_time_s")).alias("generated_tokens_per_second"),
        (ratio(F.count("*"), total("wall_time_s")) * 3600).alias("trajectories_per_hour"),
        total("wall_time_s").alias("rollout_wall_s"),
    )


def advantages(rows: DataFrame, group: str, reward: str, epsilon: float = 1e-4) -> DataFrame:
    """``rows`` with advantage: (r - mean) / (sample deviation + epsilon) in its group; null in a group of one.

    The group's mean and deviation are aggregated and joined back, so a hot group isn't gathered in a task.
    """
    m, s = free(rows, wanted=["m", "s"])
    stats = rows.groupBy(group).agg(F.avg(reward).alias(m), F.stddev_samp(reward).alias(s))
    return rows.join(stats, group).withColumn("advantage", (F.col(reward) - F.col(m)) / (F.col(s) + epsilon)).drop(m, s)


def trace_is_valid(ids: str, logprobs: str, mask: str) -> Column:
    """Aligned arrays; log probabilities finite and at most 1e-5; mask of zeros and ones."""
    n = F.size(ids)
    fine = F.forall(logprobs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x <= 1e-5))
    return (n == F.size(logprobs)) & (n == F.size(mask)) & fine & F.forall(mask, lambda x: x.isin(0, 1))


def generation_budget(prompt: Column | str, window: int, cap: int) -> Column:
    """struct<budget, capped_by_window>: tokens that may be generated within the window."""
    room = F.lit(window) - col(prompt)
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(cap), room)).alias("budget"), (room < cap).alias("capped_by_window"))


def ordered_prefix(saved: DataFrame, manifest: DataFrame, position: str, key: str) -> DataFrame:
    """(rows, is_prefix): whether the saved rows are the first of the manifest, in its order."""
    m = manifest.select(F.col(position), F.col(key).alias("__key"))
    told = saved.select(position, key).join(m, position, "left")
    top = F.coalesce(F.max(position) + 1, F.lit(0))
    return told.agg(F.count("*").alias("rows"), (F.coalesce(F.bool_and(F.col(key).eqNullSafe(F.col("__key"))), F.lit(True)) & (top == F.count("*"))).alias("is_prefix"))


def status_of(steps: Column | str, max_steps: int) -> Column:
    """Terminal status of an episode from its steps (struct<malformed, invalid, looped, done, success, over_context>).

    The first step that ends it decides; without one it is max_steps or in_progress.
    """
    s = col(steps)
    ends = F.filter(
        F.transform(
            s,
            lambda x: F.when(x["malformed"], "malformed_action")
            .when(x["invalid"], "invalid_action")
            .when(x["looped"], "no_progress_loop")
            .when(x["done"], F.when(x["success"], "success").otherwise("terminal_unsuccessful"))
            .when(x["over_context"], "context_limit"),
        ),
        lambda e: e.isNotNull(),
    )
    return F.coalesce(F.get(ends, F.lit(0)), F.when(F.size(s) >= max_steps, "max_steps").otherwise("in_progress"))
