"""Seeds, identities of runs, resume rules, policies and recorded answers of services."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.hashing import canonical, canonical_hash, canonical_json_hash, ordered_hash
from tasklode.functions.names import free
from tasklode.functions.text import col
from tasklode.operators.ranking import positions
from tasklode.session import cut

#: Seconds before the first, second and further retries.
BACKOFF = (2.0, 5.0, 10.0)


def episode_seeds(manifest: DataFrame, position: str, base: int) -> DataFrame:
    """``manifest`` with episode_seed: base + the place in order. Seeds are below 2 ** 32."""
    if type(base) is not int or base < 0:
        raise ValueError("the base seed must be a non-negative integer")
    seed = F.lit(base) + F.col("__at")
    fine = F.when(seed < 2**32, seed).otherwise(F.raise_error(F.lit("seed is too large")).cast("long"))
    return positions(manifest, [position], "__at").withColumn("episode_seed", fine).drop("__at")


def remaining(manifest: DataFrame, position: str, task: str, completed: DataFrame, base: int) -> DataFrame:
    """What a resumed run still does: ``manifest`` with episode_seed, without the items that are done.

    ``completed`` (task, ``position``) must be the first items of the manifest in its order, each once; anything else is an
    error where the result is read. An item that was begun and not completed has its old seed again, as a seed hangs on the
    item's place alone.
    """
    names = free(manifest, completed, wanted=["n", "place", "done", "fine"])
    n, place, done, fine = names
    told = positions(episode_seeds(manifest, position, base), [position], place)
    given = completed.groupBy(F.col(position).alias(position), F.col(task).alias(done)).agg(F.count("*").alias(n))
    total = completed.agg(F.count("*").alias(n))
    matched = told.join(given.drop(n), position).filter(F.col(task).eqNullSafe(F.col(done)))
    prefix = matched.agg(F.count("*").alias("found"), F.coalesce(F.max(place) + 1, F.lit(0)).alias("end")).crossJoin(total)  # one row each
    whole = (F.col("found") == F.col(n)) & (F.col("end") == F.col(n))
    checked = prefix.select("end", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("completed items are not the first of the manifest")).cast("boolean")).alias(fine))
    out = told.crossJoin(F.broadcast(checked.withColumnRenamed("end", n))).filter(F.col(fine) & (F.col(place) >= F.col(n)))  # one row
    return out.select(*manifest.columns, "episode_seed")


def stream_key(strategy: str, seed: int, scope: str, scenario: Column | str, task: Column | str) -> Column:
    """The digest that names a random stream: SHA-256 of the compact JSON list of its identity (ASCII only)."""
    head = json.dumps([strategy, seed, scope], separators=(",", ":"))[:-1]

    def quoted(x: Column | str) -> Column:
        return F.when(col(x).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(col(x).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))

    return F.sha2(F.concat(F.lit(head + ","), quoted(scenario), F.lit(","), quoted(task), F.lit("]")), 256)


def stream(strategy: str, seed: int, scope: str, scenario: str | None = None, task: str | None = None) -> random.Random:
    """The random stream of an identity, independent of order, thread and restart."""
    if type(seed) is not int or not 0 <= seed < 2**32:
        raise ValueError("the seed must be an integer in [0, 2**32)")
    text = json.dumps([strategy, seed, scope, scenario, task], separators=(",", ":"))
    return random.Random(int(hashlib.sha256(text.encode()).hexdigest(), 16))


def strata_offsets(strata: DataFrame, key: str) -> DataFrame:
    """``strata`` with offset: its place among the sorted keys. One row per stratum is ranked."""
    keys = strata.select(key).distinct().withColumn("offset", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).cast("long"))
    return strata.join(keys, key)


def same_on(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, differs): runs of ``a`` whose immutable fields differ from those in ``b``, null-safe; empty if all may resume."""
    names = dict(zip(fields, free(a, b, wanted=fields), strict=True))
    other = b.select(key, *(F.col(f).alias(n) for f, n in names.items()))
    wrong = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(n)), F.lit(f)) for f, n in names.items())), lambda x: x.isNotNull())
    return a.join(other, key).select(key, wrong.alias("differs")).filter(F.size("differs") > 0)


def run_manifests(tasks: DataFrame, runs: DataFrame, run: str, position: str, task: str, purpose: str, limits: Mapping[str, int], most: int = 100_000) -> DataFrame:
    """``runs`` (run, scenario, seed and columns of provenance) with what a run's manifest says of its tasks.

    Adds purpose, profiling_limits (canonical JSON), selected_tasks, selected_task_ids in order, selected_task_list_hash, and
    collection_config_hash: of the object {limits, purpose, scenario, seed, task_ids} alone, so provenance such as endpoints and times doesn't
    change it. A run without tasks has an empty list. A manifest is one document: more than ``most`` tasks are an error,
    raised from the counts, before any list is made.
    """
    counts = tasks.groupBy(run).agg(F.count("*").alias("selected_tasks"))
    many = F.raise_error(F.concat(F.lit("too many tasks for a manifest: "), F.col("selected_tasks"))).cast("long")
    checked = runs.join(counts, run, "left").withColumn("selected_tasks", F.when(F.coalesce("selected_tasks", F.lit(0)) <= most, F.coalesce("selected_tasks", F.lit(0))).otherwise(many))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(task).cast("string").alias("v")))), lambda s: s["v"])
    fine = cut(checked).select(run, *(c for c in checked.columns if c != run))
    listed = tasks.join(fine.select(run), run, "left_semi").groupBy(run).agg(ids.alias("selected_task_ids"), ordered_hash(task, position).alias("selected_task_list_hash"))
    told = fine.join(listed, run, "left")
    own = F.coalesce("selected_task_ids", F.array().cast("array<string>"))
    part = F.struct(F.lit(purpose).alias("purpose"), "scenario", "seed", own.alias("task_ids"), F.struct(*(F.lit(v).alias(k) for k, v in limits.items())).alias("limits"))
    return told.withColumns(
        {
            "selected_task_ids": own,
            "selected_task_list_hash": F.coalesce("selected_task_list_hash", F.sha2(F.lit(""), 256)),
            "purpose": F.lit(purpose),
            "profiling_limits": F.lit(canonical(dict(limits))),
            "collection_config_hash": canonical_json_hash(F.to_json(part, {"ignoreNullFields": "false"})),
        }
    )


def resumed_manifest(new: Mapping[str, Any], old: Mapping[str, Any] | None, kept: tuple[str, ...] = ("api_style", "sanitized_request_config_hash")) -> dict[str, Any]:
    """The manifest of a resumed run: what says how its first session asked stays as it was written then."""
    return {**new, **{k: old[k] for k in kept if old and k in old}}


def valid_runs(runs: DataFrame, marker: str = "invalidated") -> DataFrame:
    """Runs without a marker of invalidation or abort."""
    return runs.filter(~F.coalesce(F.col(marker), F.lit(False)))


def canonical_runs(runs: DataFrame, scenario: str, created: str, run: str, base: str, repair: str) -> DataFrame:
    """``runs`` with role: per scenario the latest complete base, the latest complete repair, or excluded."""
    (kind,) = free(runs, wanted=["kind"])
    told = runs.withColumn(kind, F.when(F.col(base), "base").when(F.col(repair), "repair"))
    place = F.row_number().over(Window.partitionBy(scenario, kind, "complete").orderBy(F.desc(created), F.desc(run)))
    picked = F.col("complete") & F.col(kind).isNotNull() & (place == 1)
    return told.withColumn("role", F.when(picked, F.col(kind)).otherwise("excluded")).drop(kind)


def auto_resumable(kind: Column | str, retryable: Column | str, network: Column | str) -> Column:
    """Only retryable infrastructure or protocol errors of a provider, or network errors of an environment."""
    provider = col(retryable) & col(kind).isin("infrastructure", "provider_protocol_error")
    return F.coalesce(F.when(col(kind) == "environment", col(network)).otherwise(provider), F.lit(False))


#: Parts of a run's inputs that may grow with it: they are compared apart from the rest.
GROWING = {"scheduled_groups", "task_schedule_sha256", "task_schedule_prefix_sha256", "config_sha256"}


def immutable_part(identity: Mapping[str, Any], counter: tuple[str, str]) -> dict[str, Any]:
    """What an extension must leave as it is: the configuration without its step counter, and the inputs without ``GROWING``."""
    section, field = counter
    fixed = {k: v for k, v in identity["config"].items() if k != section}
    steps = {k: v for k, v in identity["config"].get(section, {}).items() if k != field}
    return {"config": fixed, section: steps, "inputs": {k: v for k, v in identity["inputs"].items() if k not in GROWING}}


def may_extend(old: Mapping[str, Any], new: Mapping[str, Any], counter: tuple[str, str] = ("grpo", "max_steps")) -> bool:
    """Whether a run's identity may become another: equal, or only further along the same schedule.

    An extension needs admission_mode in both, a larger counter, more scheduled groups, and a
    schedule whose prefix is the old one.
    """
    if old == new:
        return True
    section, field = counter

    def reached(identity: Mapping[str, Any]) -> tuple[int, int | None]:
        return int(identity["config"].get(section, {}).get(field, 0)), identity["inputs"].get("scheduled_groups")

    (steps, groups), (more_steps, more_groups) = reached(old), reached(new)
    admitted = all(x["config"].get("admission_mode") is True for x in (old, new))
    longer = more_steps > steps and isinstance(groups, int) and groups < (more_groups or 0)
    same_schedule = old["inputs"].get("task_schedule_sha256") == new["inputs"].get("task_schedule_prefix_sha256")
    return admitted and longer and same_schedule and immutable_part(old, counter) == immutable_part(new, counter)


def policy_problems(policy: Mapping[str, Any], expected: Mapping[str, Any], forbidden: Iterable[str] = (), self_hash: str = "policy_sha256") -> list[str]:
    """What a policy gets wrong: values at dotted paths, forbidden keys at any depth, addresses, and its own hash."""
    out = []
    for path, want in expected.items():
        value: Any = policy
        for part in path.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        if value != want:
            out.append(f"{path} is {value!r}")
    todo: list[Any] = [policy]
    bad = set(forbidden)
    while todo:
        x = todo.pop()
        if isinstance(x, Mapping):
            out += [f"forbidden key {k}" for k in x if k in bad]
            todo += x.values()
        elif isinstance(x, (list, tuple)):
            todo += x
        elif isinstance(x, str) and "://" in x:
            out.append("an address")
    if self_hash in policy and policy[self_hash] != canonical_hash({k: v for k, v in policy.items() if k != self_hash}):
        out.append("own hash differs")
    return out


def retry_delay(attempt: int, retry_after: str | None, now: datetime | None = None, jitter: Callable[[], float] = float) -> float:
    """Seconds to wait: what the service asks for (seconds or a date), else the schedule; and what ``jitter`` adds, by default nothing."""
    return _asked_delay(attempt, retry_after, now) + jitter()


def _asked_delay(attempt: int, retry_after: str | None, now: datetime | None) -> float:
    default = BACKOFF[min(attempt, len(BACKOFF) - 1)]
    if not retry_after:
        return default
    try:
        return float(retry_after)
    except ValueError:
        pass
    try:
        return max(0.0, (parsedate_to_datetime(retry_after) - (now or datetime.now(timezone.utc))).total_seconds())
    except (TypeError, ValueError):
        return default


def answer_text(body: Column | str) -> Column:
    """The text of a recorded answer (JSON) of either style: chat choices or output items; null if neither is there."""
    chat = F.from_json(col(body), "choices array<struct<message: struct<content: string>>>, output_text string, output array<struct<content: array<struct<text: string>>>>")
    content = F.get(chat["choices"], F.lit(0))["message"]["content"]
    parts = F.from_json(content, "array<struct<text: string>>")
    listed = F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), ""))
    chunks = F.filter(F.flatten(F.transform(chat["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<text: string>>")))), lambda c: c["text"].isNotNull())
    items = F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, lambda c: c["text"]), ""))
    return F.coalesce(listed, content, chat["output_text"], items)


def first_count(usage: Column | str, *names: str) -> Column:
    """The first of the names that is a whole number in a JSON object."""
    values = [F.get_json_object(col(usage), f"$.{n}") for n in names]
    return F.coalesce(*(F.when(v.rlike(r"^-?\d+\z"), v.cast("long")) for v in values))
