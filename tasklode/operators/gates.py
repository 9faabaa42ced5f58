"""Ordered gates: the first that fails is the reason; first-wins duplicates; selections against artifacts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklode.functions.names import free
from tasklode.functions.text import col
from tasklode.operators import conversations
from tasklode.operators.graph import components
from tasklode.session import cut


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; null if none. A null condition doesn't hold."""
    out = None
    for name, failed in gates:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias(reason)).agg(F.count("*").alias("n"))


#: The reasons of the freeze gates, in their order.
FREEZE_REASONS = (
    "duplicate_or_missing_sqlite_acceptance", "duplicate_task_id", "wrong_scenario", "not_pass_a", "not_accepted", "non_success_record",
    "invalid_terminal", "not_train", "target_id_exploitation",
)


#: Rounds of ``first_wins`` go on while each leaves at most this share of the rows.
SHRINKS = 0.7


def _first_rounds(left: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rows (id, task, at) that pass because they are the first of all that is left for both their keys, and what is then left.

    A key's other rows go with its first one, so hot keys end here. Rounds go on only while they shrink what is left
    by a fixed share, so their number grows with the logarithm of the rows.
    """
    passed, n = [], left.count()
    while n:
        of_id, of_task = (left.groupBy(k).agg(F.min("at").alias("at"), F.min_by(other, "at").alias(other)) for k, other in (("id", "task"), ("task", "id")))
        passed.append(cut(of_id.join(of_task.select("at"), "at").select("id", "task", "at")))
        left = cut(left.join(passed[-1].select("id"), "id", "left_anti").join(passed[-1].select("task"), "task", "left_anti"))
        n, before = left.count(), n
        if n > SHRINKS * before:
            break
    return passed, left


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that pass, of rows sorted by their group and order: a sequential pass that keeps one group's keys at a time."""
    group, ids, tasks = None, set(), set()
    for batch in batches:
        keep = []
        for g, i, t in zip(*(batch.column(c).to_pylist() for c in ("root", "id", "task")), strict=True):
            if g != group:
                group, ids, tasks = g, set(), set()
            keep.append(i not in ids and t not in tasks)
            if keep[-1]:
                ids.add(i)
                tasks.add(t)
        yield batch.filter(pa.array(keep)).select(["id", "task", "at"])


def first_through(keys: DataFrame) -> DataFrame:
    """The rows of (id, task, at) that a sequential pass in order of ``at`` (unique) lets through: each of its keys for the first time.

    First come rounds of rows that nothing before them can stop (``_first_rounds``). What they leave, chains in
    which each row hangs on the one before, is dealt by its connected groups of ids and tasks, and each group is
    passed once in order. So a chain of n rows takes rounds in the logarithm of n; a pass holds the keys of one group.
    """
    passed, left = _first_rounds(keys.select("id", "task", "at"))
    if not left.isEmpty():
        # nodes are hashes: two that clash would only join two groups, which changes no row's fate
        told = left.withColumn("a", F.xxhash64(F.lit("id"), "id")).withColumn("b", F.xxhash64(F.lit("task"), "task"))
        roots = components(told).withColumnRenamed("node", "a")
        grouped = told.join(roots, "a").select("root", "id", "task", "at").repartition("root").sortWithinPartitions("root", "at")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select("id", "task", "at").schema)
        passed.append(cut(grouped.mapInArrow(_fold, fields)))
    return reduce(DataFrame.unionByName, passed) if passed else keys.limit(0).select("id", "task", "at")


def first_wins(rows: DataFrame, accepted: str, task: str, order: str, known: DataFrame) -> DataFrame:
    """``rows`` with shadow_reason of the two sequential duplicate gates; ``order`` has no ties.

    In order, a row passes if its id is in ``known`` and neither its id nor its task has passed before;
    only rows that pass both gates shadow later ones (a later gate may still reject them). See ``first_through``.
    Null tasks are one task, null ids are unknown.
    """
    text = F.coalesce(F.col(task).cast("string"), F.lit(""))
    keys = rows.select(F.col(accepted).alias("id"), text.alias("task"), F.col(order).alias("at"))
    through = first_through(keys.join(known.select(F.col(accepted).alias("id")).distinct(), "id", "left_semi"))
    i, i_at, t, t_at, k = free(rows, wanted=["id", "id_at", "task", "task_at", "known"])
    told = rows.join(through.select(F.col("id").alias(i), F.col("at").alias(i_at)), F.col(accepted) == F.col(i), "left")
    told = told.join(through.select(F.col("task").alias(t), F.col("at").alias(t_at)), text == F.col(t), "left")
    told = told.join(known.select(F.col(accepted).alias(k)).distinct(), F.col(accepted) == F.col(k), "left")
    reason = F.when(F.col(k).isNull() | (F.col(i_at) < F.col(order)), FREEZE_REASONS[0]).when(F.col(t_at) < F.col(order), FREEZE_REASONS[1])
    return told.withColumn("shadow_reason", reason).drop(i, i_at, t, t_at, k)


def freeze(records: DataFrame, known: DataFrame, train: DataFrame, scenario: str, order: str = "file") -> DataFrame:
    """``records`` with reason: the first freeze gate that a record fails, null if it stays; and messages as exported.

    Columns: accepted_id, task_id, scenario, pass, accepted, r_succ, r_finish, done, purchase, target
    (both product ids), actions, messages, visible_responses, and ``order`` (unique). After the nine
    gates come the reasons of ``conversations.problem_of`` and the leak check.
    """
    told = first_wins(records, "accepted_id", "task_id", order, known.select("accepted_id"))
    in_train, policy_ = free(records, ["reason", "shadow_reason"], wanted=["train", "policy"])
    trained = train.select(F.col("task_id").alias(in_train)).distinct()
    told = told.join(trained, F.col("task_id") == F.col(in_train), "left")

    def unless(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    gates = [
        unless(F.col("scenario") == scenario),
        unless(F.col("pass") == "A"),
        unless(F.col("accepted")),
        unless((F.col("r_succ") == 1) & (F.col("r_finish") == 1) & F.col("done")),
        ~F.col("purchase").eqNullSafe(F.col("target")),
        F.col(in_train).isNull(),
        exploits_target("target", "actions", "messages"),
    ]
    reason = first_failure(list(zip(FREEZE_REASONS[2:], gates, strict=True)))
    problem = conversations.problem_of("messages", F.col("visible_responses"), F.col("scenario"))
    policy = conversations.sanitized("messages", F.col("scenario"))
    leak = F.when(conversations.leaks(policy_), "evaluator-only field in messages")
    told = told.withColumn(policy_, policy).withColumn("reason", F.coalesce("shadow_reason", reason, problem, leak))
    return told.withColumn("messages", F.when(F.col("reason").isNull(), F.col(policy_))).drop("shadow_reason", policy_, in_train)


def exploits_target(target: Column | str, actions: Column | str, messages: Column | str) -> Column:
    """Whether a search names the target, or an assistant names it with an identifier phrase."""
    t = F.coalesce(col(target), F.lit(""))
    searched = F.exists(col(actions), lambda a: F.lower(a).startswith("search[") & F.contains(a, t))

    def told(m: Column) -> Column:
        phrase = F.contains(m["content"], F.lit("用户ID")) | F.contains(F.lower(m["content"]), F.lit("user id"))
        return (m["role"] == "assistant") & F.contains(m["content"], t) & phrase

    return (t != "") & (F.coalesce(searched, F.lit(False)) | F.coalesce(F.exists(col(messages), told), F.lit(False)))


def acceptance(rows: DataFrame, history: DataFrame, task: str, key: str, attempt: str) -> DataFrame:
    """``rows`` with rejection_reason: done and bought, all rewards there, success, hygiene, then exact duplicates.

    Columns used: done, purchase, rewards (array of the eight, nulls for missing), r_succ, hygiene
    (null or a reason). A candidate is a duplicate of an accepted one of the same task with the same
    fingerprint key, or of an earlier candidate that passes.
    """
    gates = first_failure(
        [
            ("terminal_unsuccessful", ~F.coalesce(F.col("done") & (F.coalesce("purchase", F.lit("")) != ""), F.lit(False))),
            ("missing_reward_metrics", F.exists("rewards", lambda x: x.isNull()) | (F.size("rewards") != 8)),
            ("terminal_unsuccessful", ~F.coalesce(F.col("r_succ") == 1.0, F.lit(False))),
            ("hygiene_reject", F.col("hygiene").isNotNull()),
        ]
    )
    gate, had, place = free(rows, history, ["rejection_reason"], wanted=["gate", "had", "place"])
    told = rows.withColumn(gate, gates)
    before = history.select(F.col(task), F.col(key), F.lit(True).alias(had)).distinct()
    in_order = F.row_number().over(Window.partitionBy(task, key, F.col(gate).isNull()).orderBy(attempt))
    told = told.join(before, [task, key], "left").withColumn(place, in_order)
    again = F.col(gate).isNull() & (F.coalesce(had, F.lit(False)) | (F.col(place) > 1))
    return told.withColumn("rejection_reason", F.coalesce(gate, F.when(again, "exact_duplicate"))).drop(gate, had, place)


def selection_problems(selection: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(path, problem): selected artifacts whose path, file, hash, id, scenario or uniqueness is wrong; empty if all is well.

    selection: path, sha256, accepted_id, scenario; artifacts: path, sha256, accepted_id, scenario.
    """
    a = artifacts.select("path", *(F.col(c).alias(f"own_{c}") for c in ("sha256", "accepted_id", "scenario")))
    (twice,) = free(selection, a, wanted=["twice"])
    repeated = selection.filter("accepted_id IS NOT NULL").groupBy("accepted_id").agg((F.count("*") > 1).alias(twice)).filter(twice)
    told = selection.join(a, "path", "left").join(repeated, "accepted_id", "left")

    def differs(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"own_{c}"))

    problem = first_failure(
        [
            ("path escapes", ~F.col("path").rlike(r"^[^/]+\.json$") | F.col("path").startswith("..")),
            ("missing artifact", F.col("own_accepted_id").isNull()),
            ("hash differs", differs("sha256")),
            ("id differs", differs("accepted_id")),
            ("scenario differs", differs("scenario")),
            ("duplicate id", F.coalesce(F.col(twice), F.lit(False))),
        ]
    )
    return told.select("path", problem.alias("problem")).filter("problem IS NOT NULL")
