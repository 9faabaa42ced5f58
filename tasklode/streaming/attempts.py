"""Append-only attempt logs as streams: upserts, per-task budgets, and a global quota."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tasklode.operators.scheduling import Budgets
from tasklode.sources.accepted import BUCKETS, accept, writer_of

STATE = "task_id string, first_attempts int, first_success boolean, accepted int, used int, left int, ids int"


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def step(state: tuple[int, bool, int, int], outcome: str, budgets: Budgets) -> tuple[int, bool, int, int]:
    """(first attempts, first success, accepted, used) after one more genuine outcome."""
    first, success, accepted, used = state
    if not success:
        if first < budgets.first:
            return first + 1, outcome == "accepted", int(outcome == "accepted"), 0
    elif used < budgets.after:
        return first, True, min(budgets.accepted, accepted + (outcome == "accepted")), used + 1
    return state


class _Fold(StatefulProcessor):
    """Keeps a task's state and the ids of its attempts that were seen, so that a replayed row counts once.

    With a bound an id leaves the store when the watermark has passed its row's time: from then on Spark itself drops the row
    as late, so the store holds the ids of the bound's length, not those of the whole run. One timer for each task is set, for
    its oldest id; it is set anew for the next one when it goes off.
    """

    def __init__(self, budgets: Budgets, bound: bool) -> None:
        self.budgets, self.bound = budgets, bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "first int, success boolean, accepted int, used int")
        self.seen = handle.getMapState("seen", "attempt_id string", "until long")

    def _told(self, key, now: tuple, kept: int) -> pd.DataFrame:
        return pd.DataFrame([{"task_id": key[0], "first_attempts": now[0], "first_success": now[1], "accepted": now[2], "used": now[3], "left": self.budgets.after - now[3], "ids": kept}])

    def _oldest(self) -> tuple[int, int | None]:
        """The number of ids in store and when the first of them may go."""
        times = [int(v[0]) for v in self.seen.values()]
        return len(times), min(times, default=None)

    def _wake(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.state.get()) if self.state.exists() else (0, False, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["seq", "attempt_id"])
        until = batch["at"].astype("int64") if self.bound else [0] * len(batch)
        for attempt, outcome, at in zip(batch["attempt_id"], batch["outcome"], until, strict=True):
            if not self.seen.containsKey((attempt,)):
                self.seen.updateValue((attempt,), (int(at),))
                now = step((int(now[0]), bool(now[1]), int(now[2]), int(now[3])), outcome, self.budgets)
        self.state.update(now)
        kept, oldest = self._oldest()
        if self.bound:
            self._wake(oldest)
        yield self._told(key, now, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone = timerValues.getCurrentWatermarkInMs()
        for (attempt,), (until,) in list(self.seen.iterator()):
            if until <= gone:
                self.seen.removeKey((attempt,))
        kept, oldest = self._oldest()
        self._wake(oldest)
        now = self.state.get()
        yield self._told(key, (int(now[0]), bool(now[1]), int(now[2]), int(now[3])), kept)

    def close(self) -> None:
        pass


def task_states(attempts: DataFrame, budgets: Budgets = Budgets(), time: str | None = None, bound: str = "1 day") -> DataFrame:
    """The states of tasks with new attempts (task_id, attempt_id, seq, outcome), and how many ids each keeps; output mode update.

    Without ``time`` the ids of all attempts are kept. With the name of a timestamp column an attempt that is replayed
    within ``bound`` of the latest time counts once, and one that comes later than that is dropped, so the store
    stays as large as the attempts of ``bound``.
    """
    if time is None:
        return attempts.groupBy("task_id").transformWithStateInPandas(_Fold(budgets, False), STATE, "update", "none")
    told = attempts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, bound)
    told = told.select("task_id", "attempt_id", "seq", "outcome", time, F.unix_millis(time).alias("at"))
    return told.groupBy("task_id").transformWithStateInPandas(_Fold(budgets, True), STATE, "update", "eventTime")


DISPATCHED = "run_id string, position long, in_flight int, stopped boolean"


class _Refill(StatefulProcessor):
    """One key for a run: the places in flight (at most ``workers``), the next place, the length of the queue, and the stop."""

    def __init__(self, workers: int) -> None:
        self.workers = workers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, length long, stopped boolean")
        self.flying = handle.getMapState("flying", "position long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, length, stopped = tuple(self.state.get()) if self.state.exists() else (0, 0, False)
        at, length, stopped = int(at), int(length), bool(stopped)
        flying = {int(k[0]) for k in self.flying.keys()}
        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        for event, value in zip(events["event"], events["value"], strict=True):
            if event == "queue":  # the queue is so long from now on
                length = max(length, int(value))
            elif event == "done" and int(value) in flying:  # one that isn't in flight is a replay
                flying.discard(int(value))
                self.flying.removeKey((int(value),))
            elif event == "stop":
                stopped = True
            while not stopped and at < length and len(flying) < self.workers:
                flying.add(at)
                self.flying.updateValue((at,), (1,))
                out.append((key[0], at, len(flying), stopped))
                at += 1
        self.state.update((at, length, stopped))
        if stopped and not out:
            out.append((key[0], None, len(flying), True))
        yield pd.DataFrame(out, columns=["run_id", "position", "in_flight", "stopped"]).astype({"position": "Int64"})

    def close(self) -> None:
        pass


def refills(events: DataFrame, workers: int) -> DataFrame:
    """What to dispatch next, as completions come in: (run_id, position, in_flight, stopped); output mode append.

    Events (run_id, seq, event, value) are ``queue`` (the queue has that many places from now on), ``done`` (that
    place has ended, in whichever way) and ``stop``. At most ``workers`` places are in flight; a completion frees one and
    the next of the queue takes it, without waiting for others. After a stop nothing is dispatched: a row without a
    position tells how many are still to be joined, once for each batch. The store holds what is in flight.
    """
    if not 1 <= workers <= 10_000:
        raise ValueError("workers must be between 1 and 10000")
    return events.groupBy("run_id").transformWithStateInPandas(_Refill(workers), DISPATCHED, "append", "none")


def upsert_into(path: str, checkpoint: str, key: str = "attempt_id", order: str = "accepted_at", buckets: int = BUCKETS) -> Callable[[DataFrame], StreamingQuery]:
    """A sink that adds each key once, also when a batch is replayed or fails half way; ``accepted.accepted`` reads what it wrote."""
    writer = writer_of(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        accept(batch, path, key, order, writer, number, buckets)

    def start(stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start


def within_quota(candidates: DataFrame, accepted: int, in_flight: int, target: int, order: list[str]) -> DataFrame:
    """As many candidates, in order, as accepted and in flight leave of the target: for a single writer."""
    return candidates.orderBy(*order).limit(max(0, target - accepted - in_flight))


def rollup(episodes: DataFrame) -> DataFrame:
    """Counts and means of episodes by status so far; output mode complete."""
    return episodes.groupBy("status").agg(F.count("*").alias("episodes"), F.avg("r_succ").alias("r_succ"), F.avg("steps").alias("steps"))
