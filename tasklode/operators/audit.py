"""Audit of stored attempts against the ledger, and of clicks that were called invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.functions.text import action_kind, audit_action, casefold, col, contains_argument


def against_ledger(artifacts: DataFrame, ledger: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Full outer join: every attempt with source (both, artifact_only or ledger_only) and status_conflict.

    An attempt only in the ledger gets its columns from there (a placeholder).
    """
    here, there = free(artifacts, ledger, wanted=["here", "there"])
    a, b = artifacts.withColumn(here, F.lit(True)), ledger.withColumn(there, F.lit(True))
    shared = [c for c in artifacts.columns if c in ledger.columns and c != key]
    for c in ledger.columns:
        if c != key:
            b = b.withColumnRenamed(c, f"ledger_{c}")
    told = a.join(b, key, "full_outer")
    source = F.when(F.col(here) & F.col(there), "both").when(F.col(here), "artifact_only").otherwise("ledger_only")
    conflict = F.col(here) & F.col(there) & ~F.col(status).eqNullSafe(F.col(f"ledger_{status}"))
    told = told.withColumn("source", source).withColumn("status_conflict", F.coalesce(conflict, F.lit(False)))
    for c in shared:
        told = told.withColumn(c, F.coalesce(c, f"ledger_{c}"))
    return told.drop(here, there)


def transitions(attempts: DataFrame, key: str, actions: str, observations: str) -> DataFrame:
    """(key, step, action, before, after): each action with the observation before and after it, by position."""
    rows = attempts.select(key, F.posexplode(actions).alias("p", "action"), F.col(observations).alias("__o"))
    return rows.select(key, (F.col("p") + 1).alias("step"), "action", F.get("__o", F.col("p")).alias("before"), F.get("__o", F.col("p") + 1).alias("after"))


def positional(attempts: DataFrame, key: str, responses: str, actions: str) -> DataFrame:
    """(key, step, response, action): responses with the action at the same place, if there is one."""
    rows = attempts.select(key, F.posexplode(responses).alias("p", "response"), F.col(actions).alias("__a"))
    return rows.select(key, (F.col("p") + 1).alias("step"), "response", F.get("__a", F.col("p")).alias("action"))


def invalid_candidate(actions: Column | str, observations: Column | str, responses: Column | str, was_invalid: Column | str) -> Column:
    """Kind of an attempt that was called invalid, by its last action and the observations around it."""
    act, obs = col(actions), col(observations)
    n = F.size(act)
    last = audit_action(F.element_at(act, -1))
    before, after = contains_argument(last["argument"], F.get(obs, n - 1)), contains_argument(last["argument"], F.get(obs, n))
    return (
        F.when((n == 0) & (F.size(col(responses)) > 0), "genuine_malformed_action")
        .when(n == 0, "unresolved")
        .when(~F.coalesce(col(was_invalid), F.lit(False)), "not-invalid-labelled")
        .when(~F.coalesce((last["name"] == "click") & (last["argument"] != ""), F.lit(False)), "unresolved")
        .when(before & ~after, "false_invalid_diagnostic")
        .when(~before, "genuinely_illegal_click_candidate")
        .otherwise("unresolved")
    )


def run_audit(attempts: DataFrame, run: str, key: str, actions: str, observations: str) -> DataFrame:
    """Per run: actions by kind, and clicks whose argument was seen before and is gone or still there after."""
    steps = transitions(attempts.select(run, key, actions, observations).withColumn("__k", F.struct(run, key)), "__k", actions, observations)
    parsed = audit_action("action")
    told = steps.select(
        F.col(f"__k.{run}").alias(run),
        action_kind(parsed["name"], parsed["argument"]).alias("kind"),
        (parsed["name"] == "click").alias("click"),
        contains_argument(parsed["argument"], "before").alias("seen"),
        contains_argument(parsed["argument"], "after").alias("left"),
    )
    return told.groupBy(run).agg(
        F.count("*").alias("actions"),
        F.count_if("click").alias("clicks"),
        F.count_if(F.col("click") & F.col("seen")).alias("seen_before"),
        F.count_if(F.col("click") & F.col("seen") & ~F.col("left")).alias("gone_after"),
        F.count_if(F.col("kind") == "malformed/other").alias("malformed"),
        F.count_if(F.col("kind") == "search").alias("searches"),
    )


def audit_counters(attempts: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, counter, label, n): all counters of the audit of old labels; label is null for plain numbers.

    Columns: status, ledger_status, legacy, termination_reason, invalid_action_count,
    malformed_action_count, actions, observations, visible_responses, and api_diagnostics (structs with
    http_status, model and retries); null lists are empty. An attempt's entries are made in its row and summed
    before the shuffle, so no attempt is read twice. A counter without entries has no row.
    """

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(attempts.schema[name].dataType))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("long"), F.lit(0))

    def entry(counter: str, n: Column | int = 1, label: Column | None = None) -> Column:
        told = (F.lit(None) if label is None else label).cast("string")
        return F.struct(F.lit(counter).alias("counter"), told.alias("label"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n"))

    acts, obs, said, api = (listed(x) for x in ("actions", "observations", "visible_responses", "api_diagnostics"))
    old = (F.col("status") == "invalid_action") | (number("invalid_action_count") > 0)
    ended = (F.col("status") == "malformed_action") | F.coalesce(F.col("termination_reason") == "malformed_action", F.lit(False))
    malformed = ended | (number("malformed_action_count") > 0)
    last = audit_action(F.get(acts, F.size(acts) - 1))

    def step(a: Column, i: Column) -> Column:
        parsed = audit_action(a)
        clicked = (parsed["name"] == "click") & (F.coalesce(parsed["argument"], F.lit("")) != "")
        return F.struct(
            action_kind(parsed["name"], parsed["argument"]).alias("kind"),
            F.coalesce(clicked, F.lit(False)).alias("click"),
            *(contains_argument(parsed["argument"], F.get(obs, i + k)).alias(x) for k, x in enumerate(("pre", "post"))),
        )

    def same(response: Column, i: Column) -> Column:
        own, recorded = audit_action(response), audit_action(F.get(acts, i))
        alike = own["name"].eqNullSafe(recorded["name"]) & casefold(own["argument"]).eqNullSafe(recorded["argument"])
        return F.when(F.get(acts, i).isNotNull(), alike)

    told = attempts.select("*", F.transform(acts, step).alias("__steps"), F.transform(said, same).alias("__same"))
    clicks = F.filter("__steps", lambda x: x["click"])

    def clicked(when: str, value: bool | None) -> Column:
        return F.size(F.filter(clicks, lambda x: x[when].isNull() if value is None else x[when] == value))

    calls = F.size(api)
    single = [
        entry("statuses", 1, F.col("status")),
        entry("calls", 1, calls),
        entry("total_attempts"),
        entry("total_requests", calls),
        entry("retry_total", F.aggregate(api, F.lit(0).cast("long"), lambda t, d: t + F.coalesce(d["retries"].cast("long"), F.lit(0)))),
        entry("status_discrepancies", (F.col("legacy") & (F.coalesce("ledger_status", F.lit("unknown")) != "unknown")).cast("int")),
        entry("classification", (old | malformed).cast("int"), invalid_candidate(acts, obs, said, old)),
        entry("old_invalid_attempts", old.cast("int")),
        entry("invalid_calls", old.cast("int"), calls),
        entry("invalid_steps", (old & (F.size(acts) > 0)).cast("int"), F.size(acts)),
        entry("final_invalid_kinds", (old & (F.size(acts) > 0)).cast("int"), action_kind(last["name"], last["argument"])),
        entry("malformed_visible", ended.cast("int")),
        entry("malformed_field_count", number("malformed_action_count")),
        entry("click_transitions", F.size(clicks)),
        *(entry(f"pre_{x}", clicked("pre", v)) for x, v in (("true", True), ("false", False), ("unknown", None))),
        *(entry(f"post_{x}", clicked("post", v)) for x, v in (("present", True), ("missing", False), ("unknown", None))),
        entry("parser_checked", F.size("__same")),
        entry("parser_mismatches", F.size(F.filter("__same", lambda x: ~x))),
    ]
    many = [
        F.transform("__steps", lambda x: entry("action_kinds", 1, x["kind"])),
        F.transform(F.filter(api, lambda d: d["http_status"].isNotNull()), lambda d: entry("api_statuses", 1, d["http_status"])),
        F.transform(F.filter(api, lambda d: F.coalesce(d["model"], F.lit("")) != ""), lambda d: entry("api_models", 1, d["model"])),
    ]
    rows = told.select(run, F.explode(F.concat(F.array(*single), *many)).alias("e")).select(run, "e.*").filter("n > 0")
    return rows.groupBy(run, "counter", "label").agg(F.sum("n").alias("n"))


def reset_problems(rows: DataFrame) -> DataFrame:
    """Reset records (prompt, prompt_sha256, provenance, persona, scenario) with problem: the first rule they break."""
    persona = F.col("scenario") == "single_persona"
    return rows.withColumn(
        "problem",
        F.when(F.coalesce("provenance", F.lit("")) == "", "missing provenance")
        .when(~F.sha2("prompt", 256).eqNullSafe(F.col("prompt_sha256")), "prompt hash differs")
        .when(persona & F.col("persona").isNull(), "missing persona")
        .when(~persona & F.col("persona").isNotNull(), "unexpected persona"),
    )
