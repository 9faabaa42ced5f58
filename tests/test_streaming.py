import json

import pytest
from tasklode.operators import scheduling
from tasklode.sources import accepted
from tasklode.streaming import attempts

SCHEMA = "attempt_id string, task_id string, seq int, outcome string"
BUDGETS = scheduling.Budgets(first=2, after=3, accepted=3)


def batches():
    out = [[("a1", "t", 1, "failure"), ("b1", "u", 1, "accepted")], [("a2", "t", 2, "accepted"), ("b2", "u", 2, "exact_duplicate"), ("b1", "u", 1, "accepted")], [("a3", "t", 3, "accepted"), ("b3", "u", 3, "accepted"), ("b4", "u", 4, "accepted"), ("b5", "u", 5, "accepted")]]
    return [[dict(zip(("attempt_id", "task_id", "seq", "outcome"), r, strict=True)) for r in b] for b in out]


def test_batch_replay(spark):
    rows = {r["attempt_id"]: tuple(r.values()) for b in batches() for r in b}
    df = spark.createDataFrame(list(rows.values()), SCHEMA)
    out = {r.task_id: (r.first_attempts, r.first_success, r.accepted, r.used, r.left) for r in scheduling.task_states(df, "task_id", ["seq"], "outcome", BUDGETS).collect()}
    assert out == {"t": (2, True, 2, 1, 2), "u": (1, True, 3, 3, 0)}
    for task in ("t", "u"):
        state = (0, False, 0, 0)
        for r in sorted((r for r in rows.values() if r[1] == task), key=lambda r: r[2]):
            state = attempts.step(state, r[3], BUDGETS)
        assert state == out[task][:4]


@pytest.fixture
def stateful(spark):
    pytest.importorskip("google.protobuf")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def drained(df, mode, checkpoint, take):
    """Runs a stream over all there is, from where the last run ended."""
    q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: take(batch.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_stream_equals_replay_after_a_restart(spark, tmp_path, stateful):
    folder, seen = tmp_path / "in", {}
    folder.mkdir()
    for i, rows in enumerate(batches()):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        states = attempts.task_states(attempts.read_log(spark, str(folder), SCHEMA), BUDGETS)
        drained(states, "update", tmp_path / "state", lambda rows: seen.update({r.task_id: tuple(r)[1:6] for r in rows}))
    assert seen == {"t": (2, True, 2, 1, 2), "u": (1, True, 3, 3, 0)}


def test_ids_leave_the_store_and_late_replays_count_once(spark, tmp_path, stateful):
    folder, seen = tmp_path / "in", {}
    folder.mkdir()

    def run(i, *rows):
        told = [{"attempt_id": a, "task_id": t, "seq": s, "outcome": o, "time": f"2024-01-01T{h:02}:{m:02}:00Z"} for a, t, s, o, h, m in rows]
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, told)))
        log = attempts.read_log(spark, str(folder), SCHEMA + ", time timestamp")
        drained(attempts.task_states(log, BUDGETS, "time", "30 minutes"), "update", tmp_path / "state", lambda rows: seen.update({r.task_id: tuple(r)[1:] for r in rows}))

    run(0, ("a1", "t", 1, "failure", 1, 0), ("b1", "u", 1, "accepted", 1, 0))
    assert seen["t"] == (1, False, 0, 0, 3, 1)
    run(1, ("a1", "t", 1, "failure", 1, 0), ("a2", "t", 2, "accepted", 1, 20))  # a replay within the bound
    assert seen["t"] == (2, True, 1, 0, 3, 2)
    run(2, ("x1", "v", 1, "failure", 3, 0))  # the watermark goes on to 2:30
    run(3, ("a1", "t", 1, "accepted", 1, 0), ("a2", "t", 2, "accepted", 1, 20), ("a3", "t", 3, "accepted", 2, 50))  # two replays that are too late
    assert seen["t"] == (2, True, 2, 1, 2, 1) and seen["u"][5] == 0


def test_refills_follow_completions_and_obey_the_stop(spark, tmp_path, stateful):
    folder, log = tmp_path / "in", []
    folder.mkdir()
    seq = iter(range(1000))

    def run(i, *events):
        rows = [{"run_id": "r", "seq": next(seq), "event": e, "value": v} for e, v in events]
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = attempts.read_log(spark, str(folder), "run_id string, seq long, event string, value long")
        got = []
        drained(attempts.refills(stream, 3), "append", tmp_path / "state", lambda rows: got.extend(sorted(tuple(r)[1:] for r in rows)))
        log.extend(got)
        return [g[0] for g in got]

    assert run(0, ("queue", 7)) == [0, 1, 2]
    assert run(1, ("done", 1)) == [3]  # others needn't end first
    assert run(2, ("done", 1), ("done", 0), ("done", 3)) == [4, 5]  # the first is a replay
    assert run(3, ("done", 2), ("stop", 0), ("done", 4)) == [6]
    assert run(4, ("done", 5)) == [None] and log[-1] == (None, 1, True)
    assert run(5, ("queue", 9), ("done", 6)) == [None] and log[-1] == (None, 0, True)
    assert max(n for _, n, _ in log) == 3
    with pytest.raises(ValueError, match="workers"):
        attempts.refills(spark.range(1), 0)


def test_upserts_write_each_key_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    start = attempts.upsert_into(out, str(tmp_path / "cp"), order="seq")
    for i, rows in enumerate(batches()):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        assert start(attempts.read_log(spark, str(folder), SCHEMA)).awaitTermination(120)
    pool = accepted.accepted(spark, out)
    assert sorted(r.attempt_id for r in pool.collect()) == ["a1", "a2", "a3", "b1", "b2", "b3", "b4", "b5"]
    assert [r.attempt_id for r in attempts.within_quota(pool, 3, 2, 7, ["attempt_id"]).collect()] == ["a1", "a2"]


def rows_of(spark, *keys, order=0):
    return spark.createDataFrame([(k, order) for k in keys], "attempt_id string, accepted_at int")


def test_replayed_and_broken_batches_add_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="nothing is committed"):
        accepted.accepted(spark, out)

    def add(number, *keys, writer="w", order=0):
        return accepted.accept(rows_of(spark, *keys, order=order), out, "attempt_id", "accepted_at", writer, number, 4)

    def keys():
        return sorted(r.attempt_id for r in accepted.accepted(spark, out).collect())

    assert add(0, "a", "b", "b") and not add(0, "z") and keys() == ["a", "b"]
    assert add(1, "b", "c") and keys() == ["a", "b", "c"]
    # a batch that dies before its mark is not seen, and is written again
    real = accepted.json.dumps
    monkeypatch.setattr(accepted.json, "dumps", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        add(2, "c", "d")
    assert keys() == ["a", "b", "c"]
    monkeypatch.setattr(accepted.json, "dumps", real)
    assert add(2, "c", "d") and not add(2, "c", "d") and not add(1, "y") and keys() == ["a", "b", "c", "d"]
    # another stream, whose batches have the same numbers
    assert add(0, "a", "e", writer="v") and keys() == ["a", "b", "c", "d", "e"]
    with pytest.raises(Exception, match="without a key"):
        add(9, None)


def test_a_batch_reads_only_its_own_buckets(spark, tmp_path, monkeypatch):
    out, read = str(tmp_path / "out"), []
    for number in range(6):
        accepted.accept(rows_of(spark, *(f"k{number}-{i}" for i in range(40))), out, "attempt_id", "accepted_at", "w", number, 8)
    reader = type(spark.read)
    real = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **b: read.extend(paths) or real(self, *paths, **b))
    assert accepted.accept(rows_of(spark, "k3-7", "new"), out, "attempt_id", "accepted_at", "w", 6, 8)
    assert 1 <= len(read) <= 2 and all("/keys/bucket=" in p for p in read)
    monkeypatch.undo()
    # one snapshot a bucket for each kept record at most, each of a file or none
    for bucket in (tmp_path / "out" / "keys").iterdir():
        assert len(list(bucket.iterdir())) <= accepted.KEPT + 1
        assert all(len(list(at.glob("*.parquet"))) == 1 for at in bucket.iterdir())
    assert len(list((tmp_path / "out" / "commits").iterdir())) == accepted.KEPT
    assert accepted.accepted(spark, out).count() == 241 and accepted.accepted(spark, out).distinct().count() == 241
